"""Spelling variants, the quality classifier and cross-tokenizer alignment against brute force and planted cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import cross_tokens, quality_classifier, spelling_variants

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, part int, length int, row long, deal int, label_id string"


def docs(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, 2, 3, 4, 5, "y") for i, t in zip(ids, texts)], DOCS)


ODD = [None, "", " \n\t ", "a", "é😀 | é\x0b\x0cq", "w " * 9000, "AbC " * 60]

# Spelling variants


def near(a, b):
    """Whether one inserted, deleted or replaced code point parts the words."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 6
    words = {w: n for w, n in counts.items() if n >= 5}
    close = {w: sorted((x for x in words if near(w, x)), key=lambda x: (-words[x], x)) for w in words}
    form = {w: x[0] for w, x in close.items() if x and words[x[0]] >= 5 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(close[w]), words.get(form.get(w))) for w, n in words.items()}


def some_words(seed, letters="ab", n=220, longest=9):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(6, longest))) for _ in range(n)]


CHAIN = ["kettles"] * 700 + ["kettle"] * 130 + ["kettlé"] * 26 + ["kettl"] * 90 + ["hettlé"] * 5 + ["Kettle×"] * 6


@pytest.mark.parametrize("texts", [[" ".join(w * 7) for w in ([w + " " for w in some_words(1)],)], [f"{w} " * k for k, w in enumerate(some_words(2, "abcé", 150), 3)], [" ".join(CHAIN), *ODD, "zz" * 4000 + " " + "zz" * 3999, *["zz" * 4000 + "é " + "zz" * 4000] * 5], ODD, []])
def test_variants_are_those_of_brute_force(spark, texts, monkeypatch):
    rows = [*enumerate(texts), (None, "abcdefg " * 6), (None, "abcdefg"), *[(7, "abcdef Abcdef")] * 3] if texts else []
    want = brute_variants(rows)
    table = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    for hot in (2000, 3):  # with 3, most keys are dealt out again and again
        monkeypatch.setattr(spelling_variants, "HOT", hot)
        monkeypatch.setattr(spelling_variants.near_counts, "__defaults__", (spelling_variants.PARTS, hot))
        monkeypatch.setattr(spelling_variants, "DEAL_ROWS", 40)
        got = spelling_variants.variants(table).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_scan_keeps_to_its_ranges():
    words = sorted(set(some_words(3, "abc", 400, 6)))
    listed = np.array([[ord(c) for c in w] for w in words], dtype=np.uint32)
    q, at = spelling_variants.scan(listed, listed, np.zeros(len(words), int), np.full(len(words), len(words)), 0, 6)
    assert sorted((words[i], words[j]) for i, j in zip(q, at)) == sorted((a, b) for a in words for b in words if near(a, b))


def test_no_hot_beginning_makes_a_large_deal(spark):
    """Words with one beginning are dealt out again until no key has many of them."""
    words = sorted({f"interna{w}" for w in some_words(4, "abcdefgh", 3000, 7)})
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    sent = spelling_variants.finer(spelling_variants.as_rows(table), 1, 2).where("not ask")
    assert sent.groupBy("length", "part", "rest").count().agg(F.max("count")).first()[0] > 1000
    finer = spelling_variants.finer(sent.drop("rest").where("part = 1"), 2, 4)
    assert finer.groupBy("length", "part", "rest").count().agg(F.max("count")).first()[0] < 400
    got = {r["word"]: r["n_near"] for r in spelling_variants.near_counts(table, len(words), hot=50).collect()}
    picked = words[::40]
    assert {w: got.get(w, 0) for w in picked} == {w: sum(near(w, x) for x in words) for w in picked}


# Quality classifier


def test_quality_classifier_on_held_out_labels(spark, sf_dir):
    table, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in quality_classifier.query(spark, sf_dir).collect()}
    assert len(rows) == table.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in rows.items())
    truth = [(rows[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    good, bad = ([s for s, q in truth if q == k] for k in (1, 0))
    assert sum(s >= 0.7 for s in good) >= 0.9 * len(good) and np.mean(good) > np.mean(bad)


def plain(text):
    """The n-grams of a text as strings, the slow way."""
    out = []
    words = re.findall(r"[^ \t\n\x0b\x0c\r]+", text)
    out += [f"1{w}" for w in words]
    out += ["2=" if a == b else f"2{a} {b}" for a, b in zip(words, words[1:])]
    for w in words:
        s = f" {w}  "
        out += [f"3{s[i : i + 3]}" for i in range(len(w))] + [f"4{s[i : i + 4]}" for i in range(len(w) - 1)]
    return out


def test_n_grams_are_all_counted():
    for text in ["a b", "ab ab ab", "Über  die\nGrenze, Grenze!!", "x" * 200, "é" * 3 + "\x1c y", ""]:
        buckets, of = quality_classifier.n_grams([text, "other text", text])
        want = Counter(Counter(plain(text)).values())
        assert sum(k * n for k, n in want.items()) == (of == 0).sum() == (of == 2).sum()
        assert sorted(buckets[of == 0]) == sorted(buckets[of == 2])
        assert len(set(buckets[of == 0].tolist())) <= len(set(plain(text)))


def test_pieces_score_like_the_whole(monkeypatch):
    rng = np.random.default_rng(1)
    model = quality_classifier.Model(rng.normal(size=(quality_classifier.BUCKETS, 8)), rng.normal(size=(8, 2)), np.zeros(2))
    texts = [*ODD, "one two three four " * 500, "z" * 5000]
    whole = model.score(texts)
    monkeypatch.setattr(quality_classifier, "PIECE", 6000)
    assert np.allclose(model.score(texts), whole, atol=0.02) and np.array_equal(model.score([]), [])
    monkeypatch.setattr(quality_classifier, "PIECE", 100)
    assert [len(x) for x in quality_classifier._cut("y" * 250)] == [100, 100, 50] and "".join(quality_classifier._cut("ab " * 99)) == "ab " * 99


def test_step_follows_the_gradient():
    """One step changes the parameters by the rate times the numeric gradient of the mean loss (the sum for the vectors and the softmax)."""
    rows = [quality_classifier.weights_of(t) for t in ("good words here", "BAD!! BAD!! WORDS!!")]
    model = quality_classifier.train(rows * 8, [1, 0] * 8)
    scores = model.score(["good words here", "BAD!! BAD!! WORDS!!"])
    assert scores[0] > 0.9 > 0.1 > scores[1]
    assert quality_classifier.train(rows, [1, 1]) is None and quality_classifier.train([], []) is None


def test_quality_classifier_without_rows_or_labels(spark):
    table = docs(spark, ODD + ODD, [*range(len(ODD)), *[None] * len(ODD)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_classifier.score(table, *quality_classifier.fit(table, none)).collect()
    assert len(rows) == 2 * len(ODD) and {r["score"] for r in rows} == {0.0}
    assert quality_classifier.score(table.limit(0), None, 0.5).count() == 0
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(ODD))] + [(None, 1, 0), (3, None, 0)], none.schema)
    rows = quality_classifier.score(table, *quality_classifier.fit(table, labels)).collect()
    assert len(rows) == 2 * len(ODD) and len({r["score"] for r in rows if r["doc_id"] in (0, 1, 2)}) == 1


# Cross-tokenizer alignment


@pytest.fixture(scope="module")
def both():
    return cross_tokens.runs_of(*cross_tokens.paths(None, None)).both


SIGNS = [" ", "  ", "\n", "\t", "a", "the", " of", "é", "'s", "'re", "12", "!!", "##", "\r\n", "\x00", "▁", "<s>", "<|endoftext|>", "名前", "😀", "ñ", "é", "\x85", "\x1c", "ﬁ", "Zu", "ung", "　", "   \n ", "<0x41>", "ſ", "İ"]


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_tokens_are_those_of_the_libraries(both):
    texts = [*odd_texts(5000), " " * 5000, "a" * 5000, "\n" * 3000 + " x", "word " * 3000, "x\n\n\n y \nz"]
    for text, x, y in zip(texts, both.a.full.encode_batch([f" {t}" for t in texts], add_special_tokens=False), both.b.model.encode(texts)):
        assert both.whole(text) == (([], []) if "▁" in text else (x.ids, y))
    runs = sorted({r for t in texts for r in re.findall(r"[ \n]+[^ \n]*", f" {t}") if not re.search("[\t\x0b-\r\x85\xa0\u0300-\U0010ffff]", r)})
    a_ids, b_ids, a_n, b_n = both.runs(runs)
    for run, x, y in zip(runs, np.split(a_ids, np.cumsum(a_n)), np.split(b_ids, np.cumsum(b_n))):
        assert x.tolist() == both.a.full.encode(run, add_special_tokens=False).ids and (run[0] == "\n" or y.tolist() == both.b.model.encode(run[1:]) or run == " ")


def brute_alignment(texts, a, b):
    """Per text: counts, groups as text, and links, from the byte spans of all pairs of tokens."""
    aligned, counts = [], Counter()
    for text in texts:
        x, y = (a.full.encode(f" {text}", add_special_tokens=False).ids, b.model.encode(text)) if text else ([], [])
        if not text or not b"".join(a.bytes[i] for i in x) == f" {text}".encode() == b"".join(b.bytes[i] for i in y):
            aligned.append(([], [], [], []))
            continue
        spans = [[(sum(len(t.bytes[i]) for i in ids[:k]), sum(len(t.bytes[i]) for i in ids[: k + 1])) for k in range(len(ids))] for ids, t in ((x, a), (y, b))]
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [tuple([ids[k] for k, (_, e) in enumerate(s) if low < e <= high] for ids, s in zip((x, y), spans)) for low, high in zip([0, *ends], ends)]
        links = [(x[i], y[j]) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
        counts.update(links)
        aligned.append((x, y, groups, links))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    for x, y, groups, links in aligned:
        spelt = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        digest = hashlib.sha256(spelt.encode()).hexdigest() if spelt else ""
        yield len(x), len(y), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest, sum(len(g) * len(h) for g, h in groups)


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")


def test_alignment_is_that_of_brute_force(spark, both, monkeypatch):
    texts = [*odd_texts(150), *ODD[:5], "w " * 300, *odd_texts(10), "▁x", "unbreakable " * 20]
    want = list(brute_alignment(texts, both.a, both.b))
    table = docs(spark, texts).repartition(3)
    for limit in (cross_tokens.LIMIT, 300):  # with 300, the pairs go in many blocks
        got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in cross_tokens.align(table, limit=limit).collect()}
        assert [got[i] for i in range(len(texts))] == want
    again = cross_tokens.align(docs(spark, ["a b"] * 3 + [None], [1, 1, None, None])).collect()
    assert len(again) == 4 and len({r["count_sum"] for r in again if r["n_a"]}) == 1
    assert cross_tokens.align(table.limit(0)).count() == 0


def test_links_are_all_pairs_that_overlap(spark, both):
    texts = ["Hello wörld, tokenization differs", "  two\nlines", None]
    rows = cross_tokens.links(docs(spark, texts)).collect()
    shared = cross_tokens.links(docs(spark, texts), groups=True).collect()
    want = list(brute_alignment(texts, both.a, both.b))
    for i, t in enumerate(texts):
        own = [r for r in rows if r["doc_id"] == i]
        assert len(own) == len({(r["a_at"], r["b_at"]) for r in own}) == want[i][3]
        assert sum(r["n_bytes"] for r in own) == (len(f" {t}".encode()) if t else 0)
        assert len([r for r in shared if r["doc_id"] == i]) == want[i][7]


def test_pieces_are_forgotten(both, monkeypatch):
    """What is known is the same after all was forgotten, and a worker counts by one table of pairs after another."""
    runs, texts = cross_tokens.Runs(both), ["one two one", "\ttab\n", None, "two  one\n\none", "one two one "]

    def sums():
        at, ends = runs.places(texts)
        return [(runs.stats.all[at[i:j]].sum(axis=0).tolist(), b";".join(runs.groups[k] for k in at[i:j])) for i, j in zip(ends, ends[1:])]

    first = sums()
    assert sums() == first and [x[0][0] for x in first] == [len(both.whole(t)[0]) for t in texts]
    assert not runs.full()
    monkeypatch.setattr(cross_tokens, "HELD_RUNS", 2)
    assert runs.full()
    runs.forget()
    assert sums() == first
    monkeypatch.setattr(cross_tokens, "hash_of", lambda sums, size: size.astype(np.uint64) % np.uint64(3))  # most runs clash
    runs.forget()
    assert sums() == first and runs.whole
    pairs = np.unique(runs.pairs.all)
    ones = np.ones(len(pairs), np.int64)
    assert np.array_equal(runs.score("x", pairs, ones, ones)[:, 1], runs.stats.all[:, 3])
    assert runs.score("y", pairs[:0], ones[:0], ones[:0]).sum() == 0 and len(runs.score("y", pairs[:0], ones[:0], ones[:0])) == len(runs.groups)


def test_product_is_that_of_dense_matrices(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(cross_tokens, "CELLS", 50)
    for _ in range(20):
        m, k, n = rng.integers(1, 20, 3)
        dense = [rng.integers(0, 3, (m, k)) * (rng.random((m, k)) < 0.3), rng.integers(0, 3, (k, n)) * (rng.random((k, n)) < 0.3)]
        x, y = (cross_tokens.CSR(np.r_[0, np.cumsum((d > 0).sum(axis=1))], np.nonzero(d)[1], d[d > 0], d.shape[1]) for d in dense)
        out = np.zeros((m, n), int)
        for at, end in x.blocks(y):
            part = x.product(y, at, end)
            out[at + part.row_of(), part.indices] = part.data
        assert np.array_equal(out, dense[0] @ dense[1]) and np.array_equal(x.times(np.arange(k)), dense[0] @ np.arange(k))
        back = x.transpose()
        assert np.array_equal(back.times(np.arange(m)), dense[0].T @ np.arange(m))
