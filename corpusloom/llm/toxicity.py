"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters, in numpy.

Rows: null and empty texts are scored like a window without words. Repeated rows score alike; a null doc_id has no label and
is not held out. Extra columns are ignored; an empty table gives an empty result. Without labels of both kinds every score
is the share of toxic labels. Every word of every text lies in a window; a text scores as its highest window.

A word's input is the sum of a vector of the word (for words of the training vocabulary) and the mean of the vectors of its
character trigrams, hashed, which all words have. A network of few units reads windows of words in both directions; its
attention weighs the positions. Training uses a bounded sample of labelled documents on the driver; scoring runs in the
tasks on whole texts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import crc_of_id
from corpusloom.sources.scratch import written

#: Windows of words, and how far apart they begin: each shares WINDOW - STRIDE words with the next.
WINDOW, STRIDE = 64, 48
#: Sizes of the model.
INPUT, HIDDEN, TRIGRAMS, VOCABULARY = 16, 8, 1 << 13, 1 << 13
#: Training: labelled documents and characters in all of them at most, passes, step length.
MAX_DOCS, MAX_CHARS = 3000, 6_000_000
PASSES, RATE, BATCH = 5, 0.02, 256
THRESHOLD = 0.3
SEED = 11
#: Characters that are read and windows that are scored at once.
READ_CHARS, SCORE_WINDOWS = 1 << 21, 2048
#: Fixed odd multipliers of the trigram hash, and a bit pattern for each place in a word.
MULTIPLIERS = (2654435761, 2246822519, 3266489917)
PLACES = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


@lru_cache(maxsize=1)
def _is_word() -> np.ndarray:
    """Whether a code point below 2 ** 16 is a letter or digit; those above count as letters."""
    return np.array([chr(c).isalnum() for c in range(1 << 16)])


class Tokens:
    """The words of many texts as arrays: a hash for each word, and its character trigrams, hashed, one after another.

    A word is a run of letters and digits in lower case. A trigram is a character with its two neighbours, where what lies
    outside the word counts as 0. first: place of each text's first word, and of the end.
    """

    def __init__(self, texts: list[str | None]):
        lower = [(t or "").lower() for t in texts]
        codes = np.frombuffer("".join(f"\n{t}" for t in lower).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", dtype=np.uint32)
        inside = np.where(codes < 1 << 16, _is_word()[np.minimum(codes, (1 << 16) - 1)], True)
        c = np.where(inside, codes, 0).astype(np.uint32)
        at = np.flatnonzero(inside)
        h = c[at - 1] * np.uint32(MULTIPLIERS[0]) ^ c[at] * np.uint32(MULTIPLIERS[1]) ^ c[at + 1] * np.uint32(MULTIPLIERS[2])
        self.trigrams = ((h ^ h >> np.uint32(15)) % np.uint32(TRIGRAMS)).astype(np.int32)
        begins = np.flatnonzero(inside[at] & ~inside[at - 1])
        self.begins = np.r_[begins, len(at)]
        self.sizes = np.diff(self.begins)
        place = np.arange(len(at)) - np.repeat(begins, self.sizes)
        self.hashes = np.add.reduceat(c[at].astype(np.uint64) * PLACES[place % 64] + (place >> 6).astype(np.uint64), begins) if len(begins) else np.zeros(0, np.uint64)
        edges = np.cumsum([0, *(len(t) + 1 for t in lower)])
        self.first = np.searchsorted(at[begins] if len(begins) else at, edges)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and text of every window; a text without words has one window of length 0."""
        n = np.diff(self.first)
        count = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
        owner = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = self.first[:-1][owner] + k * STRIDE
        return start, np.minimum(WINDOW, self.first[1:][owner] - start), owner


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters p and the sorted word hashes of the vocabulary; forward() scores windows, gradients() is its derivative."""

    def __init__(self, vocabulary: np.ndarray, params: dict[str, np.ndarray] | None = None, seed: int = SEED):
        self.vocabulary = vocabulary
        if params is None:
            rng = np.random.default_rng(seed)
            draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
            params = {"word": draw(len(vocabulary) + 1, INPUT) * np.float32(0.3), "tri": draw(TRIGRAMS, INPUT) * np.float32(0.3), "pool": draw(2 * HIDDEN), "out": draw(2 * HIDDEN + INPUT), "bias": np.full(1, -2.0, np.float32)}
            for d in "fb":
                params |= {f"w{d}": draw(INPUT, 3 * HIDDEN), f"u{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
            params["word"][len(vocabulary)] = 0
        self.p = params

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the vocabulary; its length for words outside."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(len(self.vocabulary) - 1, 0))
        return np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary)) if len(self.vocabulary) else np.zeros(len(hashes), np.int64)

    def vectors(self, t: Tokens) -> np.ndarray:
        """The input of each word, and one row of zeros."""
        out = np.zeros((len(t.sizes) + 1, INPUT), np.float32)
        for a in range(0, len(t.sizes), 1 << 16):
            b = min(a + (1 << 16), len(t.sizes))
            rows = self.p["tri"][t.trigrams[t.begins[a] : t.begins[b]]]
            out[a:b] = np.add.reduceat(rows, t.begins[a:b] - t.begins[a], axis=0) / t.sizes[a:b, None]
            out[a:b] += self.p["word"][self.word_ids(t.hashes[a:b])]
        return out

    def _run(self, wx: np.ndarray, ids: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states [step, row, HIDDEN] of one direction; padded steps hand the state on."""
        h = np.zeros((ids.shape[1], HIDDEN), np.float32)
        out = np.empty((*ids.shape, HIDDEN), np.float32)
        u = self.p[f"u{d}"]
        for t in range(len(ids)) if d == "f" else range(len(ids) - 1, -1, -1):
            a, b = wx[ids[t]], h @ u
            g = sigmoid(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])
            r, z = g[:, :HIDDEN], g[:, HIDDEN:]
            n = np.tanh(a[:, 2 * HIDDEN :] + r * b[:, 2 * HIDDEN :])
            m = mask[t][:, None]
            new = h + (m - m * z) * (n - h)
            if keep is not None:
                keep.append((t, h, r, z, n, b[:, 2 * HIDDEN :], m))
            h = out[t] = new
        return out

    def forward(self, vectors: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: dict | None = None, wx: dict | None = None) -> np.ndarray:
        """Logits of windows: ids [step, row] of vectors, mask [step, row] (1 where there is a word)."""
        p = self.p
        wx = wx or self.projected(vectors)
        tapes = {d: [] if keep is not None else None for d in "fb"}
        f, b = (self._run(wx[d], ids, mask, d, tapes[d]) for d in "fb")
        e = f @ p["pool"][:HIDDEN] + b @ p["pool"][HIDDEN:] + (mask - 1) * 1e4
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0) * mask
        x = vectors[ids]
        pooled = np.concatenate([np.einsum("trk,tr->rk", v, weight) for v in (f, b, x)], axis=1)
        if keep is not None:
            keep |= {"tapes": tapes, "h": (f, b), "weight": weight, "pooled": pooled, "x": x}
        return pooled @ p["out"] + p["bias"][0]

    def projected(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        return {d: vectors @ self.p[f"w{d}"] + self.p[f"c{d}"] for d in "fb"}

    def gradients(self, k: dict, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the dense parameters and of the windows' inputs, from the tape of forward()."""
        p, weight, x = self.p, k["weight"], k["x"]
        g = {"out": k["pooled"].T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * p["out"]
        parts = [dpool[:, :HIDDEN], dpool[:, HIDDEN : 2 * HIDDEN], dpool[:, 2 * HIDDEN :]]
        dweight = sum(np.einsum("trk,rk->tr", v, dp) for v, dp in zip((*k["h"], x), parts))
        de = weight * (dweight - (weight * dweight).sum(axis=0))
        g["pool"] = np.concatenate([np.einsum("trk,tr->k", v, de) for v in k["h"]])
        dx = weight[:, :, None] * parts[2][None]
        for i, d in enumerate("fb"):
            dh = weight[:, :, None] * parts[i][None] + de[:, :, None] * p["pool"][i * HIDDEN : (i + 1) * HIDDEN]
            u = p[f"u{d}"]
            du, da = np.zeros_like(u), np.empty((*x.shape[:2], 3 * HIDDEN), np.float32)
            carry = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h0, r, z, n, bn, m in reversed(k["tapes"][d]):
                up = dh[t] + carry
                dn = up * m * (1 - z) * (1 - n * n)
                dz = up * m * (h0 - n) * z * (1 - z)
                dr = dn * bn * r * (1 - r)
                db = np.concatenate([dr, dz, dn * r], axis=1)
                da[t] = np.concatenate([dr, dz, dn], axis=1)
                du += h0.T @ db
                carry = up * (1 - m * (1 - z)) + db @ u.T
            flat = da.reshape(-1, 3 * HIDDEN)
            g |= {f"u{d}": du, f"w{d}": x.reshape(-1, INPUT).T @ flat, f"c{d}": flat.sum(axis=0)}
            dx += da @ p[f"w{d}"].T
        return g, dx


def _padded(start: np.ndarray, length: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """ids [step, row] of words and mask of windows; steps beyond a window's length hold pad."""
    step = np.arange(max(1, int(length.max(initial=1))))[:, None]
    mask = step < length[None]
    return np.where(mask, start[None] + step, pad), mask.astype(np.float32)


def score_windows(net: Network, t: Tokens, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Logits of windows, a bounded number at a time; windows of like length are scored together."""
    vectors = net.vectors(t)
    wx = net.projected(vectors)
    out = np.empty(len(start), np.float32)
    order = np.argsort(length, kind="stable")
    for at in range(0, len(order), SCORE_WINDOWS):
        pick = order[at : at + SCORE_WINDOWS]
        out[pick] = net.forward(vectors, *_padded(start[pick], length[pick], len(vectors) - 1), wx=wx)
    return out


def score_texts(net: Network, texts: list[str | None]) -> np.ndarray:
    """For each text, the chance that it is toxic: that of its highest window."""
    out = np.empty(len(texts))
    at = 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and (to == at or chars + len(texts[to] or "") <= READ_CHARS):
            chars += len(texts[to] or "")
            to += 1
        t = Tokens(texts[at:to])
        start, length, owner = t.windows()
        logit = np.full(to - at, -np.inf, np.float32)
        np.maximum.at(logit, owner, score_windows(net, t, start, length))
        out[at:to] = sigmoid(logit.astype(np.float64))
        at = to
    return out


def train(texts: list[str], labels: list[int], seed: int = SEED) -> Network | None:
    """A network from labelled texts: each pass takes, of every text, the window that scores highest so far, and of clean texts one more at random."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    t = Tokens(texts)
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    of_text = np.repeat(np.arange(len(y)), np.diff(t.first))
    met = np.unique(np.stack([t.hashes, of_text.astype(np.uint64)]), axis=1)
    words, where, count = np.unique(met[0], return_inverse=True, return_counts=True)
    toxic = np.bincount(where, weights=y[met[1].astype(np.int64)], minlength=len(words))
    chosen = np.sort(np.lexsort((words, -count))[: min(VOCABULARY, int((count >= 3).sum()))])
    net = Network(words[chosen], seed=seed)
    p = net.p
    # The first input of a word starts at its log odds, so that few labelled texts are enough.
    odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((count - toxic + 0.5) / (n0 + 1))
    p["word"][:-1, 0] = np.clip(odds[chosen], -3, 4)
    p["out"][2 * HIDDEN] = 1.0
    start, length, owner = t.windows()
    first, last = (np.searchsorted(owner, np.arange(len(y)), side=s) for s in ("left", "right"))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    balance = np.where(y > 0, np.sqrt(n0 / n1), 1.0).astype(np.float32)
    ids_of = net.word_ids(t.hashes)
    step = 0
    for turn in range(PASSES):
        score = score_windows(net, t, start, length)
        top = np.array([a + int(np.argmax(score[a:b])) for a, b in zip(first, last)])
        other = rng.integers(first, last)[y == 0]
        picked, rows = np.r_[top, other], np.r_[np.arange(len(y)), np.flatnonzero(y == 0)]
        order = rng.permutation(len(picked))
        rate = RATE * (1 - 0.8 * turn / PASSES)
        for at in range(0, len(order), BATCH):
            part = picked[order[at : at + BATCH]]
            target = rows[order[at : at + BATCH]]
            ids, mask = _padded(start[part], length[part], -1)
            used, inner = np.unique(ids, return_inverse=True)
            used = used[used >= 0]
            inner = inner.reshape(ids.shape) - (0 if len(used) == inner.max() + 1 else 1)
            sizes = t.sizes[used]
            chars = np.repeat(t.begins[used] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            tri, word = t.trigrams[chars], np.repeat(np.arange(len(used)), sizes)
            vectors = np.zeros((len(used) + 1, INPUT), np.float32)
            if len(used):
                vectors[:-1] = np.add.reduceat(p["tri"][tri], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None] + p["word"][ids_of[used]]
            inner = np.where(mask > 0, inner, len(used))
            tape: dict = {}
            logit = net.forward(vectors, inner, mask, tape)
            d = ((sigmoid(logit) - y[target]) * balance[target] / len(part)).astype(np.float32)
            g, dx = net.gradients(tape, d)
            dv = np.zeros_like(vectors)
            np.add.at(dv, inner.reshape(-1), (dx * mask[:, :, None]).reshape(-1, INPUT))
            g |= {"word": np.zeros_like(p["word"]), "tri": np.zeros_like(p["tri"])}
            np.add.at(g["word"], ids_of[used], dv[:-1])
            g["word"][-1] = 0
            np.add.at(g["tri"], tri, (dv[:-1] / np.maximum(sizes, 1)[:, None])[word])
            step += 1
            for k, v in g.items():
                m, s = moments[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    return net


def held_out():
    return F.coalesce(crc_of_id(F.col("doc_id")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> tuple[Network | None, float]:
    """A network, and the share of toxic labels, from labelled rows that are not held out.

    The sample: max_docs labels, about, the first by hash; of these documents, in the order of another hash, those that
    together have max_chars characters at most. Texts are used whole, whatever their length. Of rows with one doc_id one is
    used. Ids and lengths of the sample, and then its texts, are all that reaches the driver.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumnRenamed("doc_id", "label_id")
    n, bad = known.agg(F.count("*"), F.avg("toxic")).first()
    if n > max_docs:
        known = known.where(F.pmod(F.xxhash64("label_id"), F.lit(n)) < max_docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    met = docs.select("doc_id", text.alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    one = written(met.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), "sample")
    left, used = max_chars, []
    for doc_id, size in one.select("doc_id", F.length("text")).orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").collect():
        if size <= left:
            left -= size
            used.append((doc_id,))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(used, "used_id long"))
    rows = one.join(chosen, F.col("doc_id") == F.col("used_id")).select("doc_id", "text", "toxic").toPandas().sort_values("doc_id")
    return train(rows["text"].tolist(), [int(x > 0) for x in rows["toxic"]]), float(bad or 0.0)


def score(docs: DataFrame, net: Network | None, share: float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per row of docs. The network is broadcast: about 1 MB, by its fixed sizes."""
    state = docs.sparkSession.sparkContext.broadcast((net.vocabulary, net.p) if net else None)

    def run(batches):
        own = Network(*state.value) if state.value else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores = score_texts(own, texts) if own else np.full(len(texts), share)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(scores, dtype=np.float64))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, *fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
