"""Spelling variants: words within one edit of each other, found by a scan of sorted lists with shared rows of the edit matrix.

Rows: null and empty texts have no words. Repeated rows count as often as they are. A null doc_id is spelt as nothing, so its
runs hash as ":run". Texts and words are read whole, whatever their length. Extra columns are ignored, whatever their names; an
empty table gives an empty result. Of several near words with the largest count the smallest in code-point order is the form.

Dealing. Of two near words the longer (of equal ones, either) is looked up by the other. One edit touches one of PARTS parts of
the looked-up word, and the pair agrees on all its code points before and after that part. So a word is sent once for each part
under its length, the part and the rest of it, and as a question under the same and under those of words one longer. A key that
many words share is dealt out again by twice as many parts, so that a beginning or an ending that a large share of the
vocabulary has makes no large task.

Scanning. A task sorts its words; words that share a prefix are a range of the list, which ends where the common prefix (LCP)
of neighbours is shorter. A question walks down the ranges with a band of three cells of the edit matrix's row. A range's row
is made from that of the range it lies in, once for all its words, and a range is left as soon as all cells exceed one edit.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import HOT_SHARE, follow, let
from corpusloom.sources.scratch import written

#: The runs, the letters that are lower-cased, and the changes, lengths and counts of the contract.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHANGED, LEAST_LENGTH, LEAST_COUNT, TIMES = 199, 6, 5, 5
#: Parts of a word, and words that may share a key, whatever the vocabulary, before they are dealt again.
PARTS, HOT = 2, 2000
#: Rows of words and questions that a task gets, about, and questions that walk down the ranges at once.
DEAL_ROWS = 60_000
FRONTIER = 1 << 16


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run) of every run of letters, A-Z lower-cased."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))


def changed(doc_id: Column, run: Column) -> Column:
    """A run with the code point deleted that its hash names, if it names one."""
    hash_ = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = lambda h: (h % F.length(run)).cast("int")
    cut = lambda h: F.concat(F.substring(run, F.lit(1), at(h)), F.substring(run, at(h) + 2, F.length(run)))
    return let(hash_, lambda h: F.when(h % CHANGED == 0, cut(h)).otherwise(run))


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all documents; counts are summed before the shuffle."""
    words = runs(docs).where(F.length("run") >= least_length).select(changed(F.col("doc_id"), F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def edges_of(length, parts: int) -> list:
    """Where the parts of a word begin, and where the last one ends."""
    return [length * i // parts for i in range(parts + 1)]


def finer(rows: DataFrame, parts: int, times: int) -> DataFrame:
    """rows (length, part, ask, word, n) of so many parts, each sent for the times parts in it that are not empty, and with rest.

    length is that of the looked-up word; rest is what word has before and after the part.
    """
    edge = lambda k: F.floor(F.col("length") * (F.col("part") * times + k) / F.lit(parts * times)).cast("int")
    piece = lambda k: F.struct((F.col("part") * times + k).alias("part"), edge(k).alias("begin"), (F.col("length") - edge(k + 1)).alias("tail"))
    sent = rows.select("length", F.explode(F.array(*map(piece, range(times)))).alias("p"), "ask", "word", "n").where("p.begin + p.tail < length")
    rest = F.concat(F.substring("word", F.lit(1), F.col("p.begin")), F.substring(F.col("word"), F.length("word") - F.col("p.tail") + 1, F.col("p.tail")))
    return sent.select("length", F.col("p.part").alias("part"), "ask", "word", "n", rest.alias("rest"))


def as_rows(words: DataFrame) -> DataFrame:
    """(length, part, ask, word, n): each word to be looked up, and as a question among words of its length and one more."""
    own = F.length("word")
    kinds = [F.struct((own + k).alias("length"), F.lit(0).alias("part"), F.lit(ask).alias("ask")) for ask, k in ((False, 0), (True, 0), (True, 1))]
    return words.select(F.explode(F.array(*kinds)).alias("k"), "word", "n").select("k.*", "word", "n")


class Found:
    """For each word of a list: how many near words it has, and the one with the largest count, ties to the smallest."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.words, self.counts = words, counts
        self.n = np.zeros(len(words), np.int64)
        self.best = np.full(len(words), -1)
        # Places of the words by count, the largest first, and then by code point: the lower, the better.
        order = np.lexsort((words, -counts))
        self.place = np.empty(len(words), np.int64)
        self.place[order] = np.arange(len(words))
        self.at_place = order

    def add(self, of: np.ndarray, near: np.ndarray) -> None:
        self.n += np.bincount(of, minlength=len(self.n))
        best = np.where(self.best >= 0, self.place[self.best], len(self.words))
        np.minimum.at(best, of, self.place[near])
        self.best = np.where(best < len(self.words), self.at_place[np.minimum(best, len(self.words) - 1)], -1)


def scan(listed: np.ndarray, asked: np.ndarray, low: np.ndarray, high: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (question, place in the list) one edit apart, the edit within [begin, end) of the listed word.

    listed: code points [word, place], distinct, sorted within the ranges [low, high) that the questions start from, whose words agree with them
    on all places before begin and after end. asked: code points [question, place] of words as long, or one shorter.
    """
    shorter = listed.shape[1] - asked.shape[1]
    # The common prefix of neighbours, and for each depth the places where a range of that depth begins.
    differ = listed[1:, begin:end] != listed[:-1, begin:end]
    lcp = np.r_[0, np.where(differ.any(axis=1), differ.argmax(axis=1), end - begin)] if len(listed) else np.zeros(0, int)
    starts = [np.flatnonzero(lcp <= d) for d in range(end - begin)]
    ends = [np.r_[x[1:], len(listed)] for x in starts]
    padded = np.zeros((len(asked), asked.shape[1] + 4), asked.dtype)  # no listed word has a zero
    padded[:, 1 : asked.shape[1] + 1] = asked
    met: list[tuple[np.ndarray, np.ndarray]] = []
    some = high > low
    full = lambda v: np.full(int(some.sum()), v, np.int8)
    # A state: question, range, and the row of the matrix at depth d: cells d - 1, d and d + 1.
    stack = [(begin, np.flatnonzero(some), low[some], high[some], full(1), full(0), full(1))]
    while stack:
        d, q, lo, hi, a, b, c = stack.pop()
        if len(q) > FRONTIER:
            stack.append((d, *(x[FRONTIER:] for x in (q, lo, hi, a, b, c))))
            q, lo, hi, a, b, c = (x[:FRONTIER] for x in (q, lo, hi, a, b, c))
        if d == end:
            # Where both agree up to here, a shorter word's edit lies further on, and is met there.
            hit = (a == 1) & (b != 0) if shorter else b == 1
            n = (hi - lo)[hit]
            which = np.repeat(np.flatnonzero(hit), n)
            met.append((q[which], lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)))
            continue
        # Ranges of the next depth: those of a state's range that begin within it.
        begins = starts[d - begin]
        first, last = np.searchsorted(begins, lo, side="right") - 1, np.searchsorted(begins, hi)
        n = last - first
        of = np.repeat(np.arange(len(q)), n)
        k = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        lo2 = np.maximum(begins[k], lo[of])
        hi2 = np.minimum(ends[d - begin][k], hi[of])
        q, sign = q[of], listed[lo2, d]
        a, b, c = a[of], b[of], c[of]
        a2 = np.minimum(b + 1, a + (padded[q, d] != sign))
        b2 = np.minimum(np.minimum(c, a2) + 1, b + (padded[q, d + 1] != sign))
        c2 = np.minimum(b2 + 1, c + (padded[q, d + 2] != sign))
        alive = np.minimum(np.minimum(a2, b2), c2) <= 1
        stack.append((d + 1, *(x[alive] for x in (q, lo2, hi2, *(x.astype(np.int8) for x in (a2, b2, c2))))))
    return tuple(np.concatenate(x) for x in zip(*met)) if met else (np.zeros(0, int), np.zeros(0, int))


def _codes(words: np.ndarray, length: int) -> np.ndarray:
    return np.frombuffer("".join(words.tolist()).encode("utf-32-le"), dtype=np.uint32).reshape(-1, length)


def near_words(table: pa.Table, parts: int) -> pa.Table:
    """(word, n_near, best, best_n) of the words of one deal: what its pairs add to each of them. Pairs lie in one deal only."""
    rows = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("length", "part", "ask", "n")}
    word = np.array([*table.column("word").to_pylist(), ""], dtype=object)[:-1]
    names, which = np.unique(word, return_inverse=True)
    counts = np.zeros(len(names), np.int64)
    counts[which] = rows["n"]
    found = Found(names, counts)
    kind = rows["length"].astype(np.int64) * parts + rows["part"]
    order = np.argsort(kind, kind="stable")
    for pick in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1) if len(order) else []:
        length, part = int(rows["length"][pick[0]]), int(rows["part"][pick[0]])
        begin, end = edges_of(length, parts)[part : part + 2]
        ask = rows["ask"][pick]
        held, asks = pick[~ask], pick[ask]
        if not len(held) or not len(asks):
            continue
        rest = lambda of: np.array([w[:begin] + w[len(w) - length + end :] for w in word[of].tolist()])
        sorted_by = np.lexsort((word[held].astype(str), rest(held)))
        held = held[sorted_by]
        keys, listed = rest(held), _codes(word[held], length)
        sizes = np.array([len(w) for w in word[asks].tolist()])
        for size in (length, length - 1):
            own = asks[sizes == size]
            if len(own):
                wanted = rest(own)
                q, at = scan(listed, _codes(word[own], size), np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, side="right"), begin, end)
                a, b = which[own[q]], which[held[at]]
                found.add(a, b)
                if size < length:
                    found.add(b, a)
    met = np.flatnonzero(found.n)
    best = found.best[met]
    return pa.table({"word": pa.array(names[met].tolist(), pa.string()), "n_near": found.n[met], "best": pa.array(names[best].tolist(), pa.string()), "best_n": counts[best]})


def _within(parts: int):
    def run(deal: pa.Table) -> pa.Table:
        return near_words(deal, parts)

    return run


def near_counts(words: DataFrame, n_words: int, parts: int = PARTS, hot: int = HOT) -> DataFrame:
    """(word, n_near, best, best_n) of those of the written words (word, n) that have near words; each pair is found once.

    Keys of more than hot words, and of more than a HOT_SHARE-th of them, are dealt out again. There are few, whatever the
    vocabulary, so they are broadcast; parts of one code point have no more words to a key than there are letters.
    """
    key, found, times = ["length", "part", "rest"], [], parts
    rows, parts = as_rows(words), 1
    while True:
        sent = finer(rows, parts, times)
        parts *= times
        sizes = sent.where("not ask").groupBy(*key).agg(F.count("*").alias("held"))
        crowded = written(sizes.where(F.col("held") > max(hot, n_words // HOT_SHARE)).select(*key), "crowded")
        last = crowded.isEmpty()
        here = sent if last else sent.join(F.broadcast(crowded), key, "left_anti")
        deals = max(16, -(-6 * n_words // DEAL_ROWS))
        dealt = here.select("length", "part", "ask", "word", "n", F.pmod(F.xxhash64(*key), F.lit(deals)).alias("deal"))
        found.append(dealt.groupBy("deal").applyInArrow(_within(parts), "word string, n_near long, best string, best_n long"))
        if last:
            break
        rows, times = sent.join(F.broadcast(crowded), key, "left_semi").select("length", "part", "ask", "word", "n"), 2
    best = F.min_by("best", F.struct(-F.col("best_n"), F.col("best")))
    return reduce(DataFrame.unionByName, found).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"), F.max("best_n").alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of written forms (word, form): the end of each word's chain. Steps double, and counts grow along a chain, so it is short."""
    up = forms.select("word", F.col("form").alias("root"))
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = written(follow(up, "root", on), "roots")
        if met.where("next is not null").isEmpty():
            return met.select("word", "root")
        up = met.select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n, one row for each word of the vocabulary."""
    words = written(vocabulary(docs), "words")
    near = near_counts(words, words.count())
    met = words.join(near, "word", "left")
    close = F.col("best_n") >= times * F.col("n")
    judged = written(met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(close, F.col("best")).alias("form"), F.when(close, F.col("best_n")).alias("form_n")), "forms")
    ends = roots(judged.where("form is not null").select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# CRC-32 is spelt out: eight steps make the table's entry of a byte, and a letter from U+00C0 on is two bytes, the first of which is 195.
_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
ORACLE = rf"""
WITH RECURSIVE made AS (SELECT b, 0 AS k, b::BIGINT AS c FROM range(256) t(b) UNION ALL SELECT b, k + 1, {_STEP.format("c")} FROM made WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS tab FROM made WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{RUN}')) AS run FROM documents) GROUP BY ALL
), bytes AS (
  SELECT run, times, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b
  FROM runs WHERE length(run) >= {LEAST_LENGTH}
), hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, b::BIGINT[]), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc
), spelt AS (
  SELECT CASE WHEN h % {CHANGED} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed
), w AS (SELECT word, sum(times)::BIGINT AS n FROM spelt WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (
  SELECT a.word AS word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word
), near AS (SELECT word, count(*) AS n_near, max(m) AS best_n FROM pairs GROUP BY word),
best AS (SELECT word, n_near, best_n, min(other) AS other FROM near JOIN pairs USING (word) WHERE m = best_n GROUP BY ALL),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= {TIMES} * n THEN other END AS form, CASE WHEN best_n >= {TIMES} * n THEN best_n END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS k FROM forms UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM forms JOIN ends USING (word)
"""
