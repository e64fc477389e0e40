"""Quality classifier: learned vectors of hashed word and character n-grams, averaged per document, with a softmax on top.

Rows: null and empty texts, and those of white space only, have no n-grams; their vector is zero and they score as the bias
alone. Repeated rows score alike; a null doc_id has no label and is not held out. Extra columns are ignored, whatever their
names; an empty table gives an empty result. Without labels of both kinds every score is the share of good labels. Texts are
read whole: one of more than PIECE characters is read in pieces that are cut at white space (a run of more than PIECE
characters without any counts as several words), whose n-grams are averaged together; a pair of words across a cut is not met.

The n-grams of a text are its words as they are written (runs without white space), pairs of neighbouring words, where a
word that comes twice in a row is one n-gram of its own, and 3 and 4 characters of a word with its ends. Each is hashed to one
of BUCKETS rows of a table of vectors, which plain stochastic gradient descent learns with the softmax.

The fit reads at most MAX_DOCS labelled documents, not held out, drawn by a hash of their ids, whatever the length of their
texts. Tasks reduce each to the weights of its n-grams, BUCKETS numbers at most, and only these reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.toxicity import held_out

#: Rows and width of the table of vectors.
BUCKETS, WIDTH = 1 << 16, 8
#: Training: labelled documents at most, passes, documents of one step, first rate (it falls to zero in a straight line).
MAX_DOCS, PASSES, BATCH, RATE = 3000, 6, 16, 2.0
THRESHOLD = 0.7
SEED = 17
#: Characters that are read at once.
PIECE = 1 << 20
#: Fixed odd multipliers of the hashes, and one for each place in a word.
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)
PLACES = np.random.default_rng(SEED).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
#: Code points that part words: the six ASCII white-space characters.
SPACES = np.array([9, 10, 11, 12, 13, 32], dtype=np.uint32)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * MIX[1]
    return (h >> np.uint64(48)).astype(np.int32)


SAME_PAIR = int(_bucket(MIX[3:4])[0])


def n_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every n-gram of the texts, in no order that matters."""
    codes = np.frombuffer("".join(f"\n{t}" for t in texts).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0" * 3, dtype=np.uint32)
    inside = ~((codes <= 32) & np.isin(codes, SPACES))
    owner_of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    c = np.where(inside, codes, 0).astype(np.uint64) + np.uint64(1)
    before, here, after, beyond = c[at - 1], c[at], c[at + 1], c[at + 2]
    three = before * MIX[0] + here * MIX[1] + after * MIX[2]
    four = inside[at + 1]
    begins = np.flatnonzero(~inside[at - 1])
    sizes = np.diff(np.r_[begins, len(at)])
    place = np.arange(len(at)) - np.repeat(begins, sizes)
    word = np.add.reduceat(here * PLACES[place % 64] + (place >> 6).astype(np.uint64), begins)
    owner = owner_of[at]
    of_word = owner[begins]
    both = of_word[1:] == of_word[:-1]
    pair = _bucket(word[:-1] * MIX[2] + word[1:] * MIX[0] + MIX[3])
    pair = np.where(word[:-1] == word[1:], SAME_PAIR, pair)
    found = [_bucket(word), pair[both], _bucket(three), _bucket(three[four] + beyond[four] * MIX[3])]
    return np.concatenate(found), np.concatenate([of_word, of_word[1:][both], owner, owner[four]])


def _cut(text: str) -> list[str]:
    """A text in pieces of PIECE characters at most, cut at white space where there is some."""
    out, at = [], 0
    while len(text) - at > PIECE:
        end = max(text.rfind(chr(s), at + 1, at + PIECE) for s in SPACES.tolist())
        out.append(text[at : end if end > 0 else at + PIECE])
        at += len(out[-1])
    return [*out, text[at:]]


def read(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """n_grams of texts, in as many parts as their lengths ask for; the numbers of texts count from the first of all."""
    part, owners, chars = [], [], 0
    for k, text in enumerate(texts):
        for piece in _cut(text or ""):
            if chars + len(piece) > PIECE and part:
                buckets, of = n_grams(part)
                yield buckets, np.array(owners)[of]
                part, owners, chars = [], [], 0
            part.append(piece)
            owners.append(k)
            chars += len(piece)
    if part:
        buckets, of = n_grams(part)
        yield buckets, np.array(owners)[of]


def weights_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and the share of its n-grams in each."""
    count = np.zeros(BUCKETS, np.int64)
    for buckets, _ in read([text]):
        count += np.bincount(buckets, minlength=BUCKETS)
    met = np.flatnonzero(count)
    return met.astype(np.int32), (count[met] / max(1, count.sum())).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    """vectors [bucket, WIDTH], and out [WIDTH, 2] and bias [2] of the softmax."""

    def __init__(self, vectors: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.vectors, self.out, self.bias = vectors, out, bias
        # A mean of vectors times out is the mean of their products with out: two numbers a bucket are enough to score.
        self.logits = vectors.astype(np.float64) @ out.astype(np.float64)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The chance of label 1 of each text."""
        total, n = np.zeros((len(texts), 2)), np.zeros(len(texts))
        for buckets, of in read(texts):
            n += np.bincount(of, minlength=len(texts))
            for k in range(2):
                total[:, k] += np.bincount(of, self.logits[buckets, k], minlength=len(texts))
        return softmax(total / np.maximum(n, 1)[:, None] + self.bias)[:, 1]


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = SEED) -> Model | None:
    """Stochastic gradient descent over documents, given as buckets and their weights; None where there is one kind of label."""
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, 2), np.float32)
    share = np.bincount(y, minlength=2) / len(y)
    bias = np.log(share).astype(np.float32)
    steps, step = PASSES * -(-len(y) // BATCH), 0
    for _ in range(PASSES):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            pick = order[at : at + BATCH]
            buckets = np.concatenate([rows[i][0] for i in pick])
            weight = np.concatenate([rows[i][1] for i in pick])
            of = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
            used = vectors[buckets] * weight[:, None]
            mean = np.stack([np.bincount(of, used[:, k], minlength=len(pick)) for k in range(WIDTH)], axis=1).astype(np.float32)
            wrong = softmax(mean @ out + bias)
            wrong[np.arange(len(pick)), y[pick]] -= 1
            back = wrong @ out.T
            out -= rate * (mean.T @ wrong)
            bias -= rate * wrong.mean(axis=0)
            for k in range(WIDTH):
                vectors[:, k] -= rate * np.bincount(buckets, weight * back[of, k], minlength=BUCKETS).astype(np.float32)
    return Model(vectors, out, bias)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> tuple[Model | None, float]:
    """A model, and the share of good labels, from labelled rows that are not held out: max_docs of them, about, by hash.

    Of rows with one doc_id one is used.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumnRenamed("doc_id", "label_id")
    n, good = known.agg(F.count("*"), F.avg((F.col("quality") > 0).cast("int"))).first()
    if n > max_docs:
        known = known.where(F.pmod(F.xxhash64("label_id"), F.lit(n)) < max_docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    one = met.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))

    def reduce(batches):
        for batch in batches:
            found = [weights_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([b.tobytes() for b, _ in found], pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary())], names=["doc_id", "quality", "buckets", "weights"])

    rows = one.select("doc_id", "text", F.col("quality").cast("int")).mapInArrow(reduce, "doc_id long, quality int, buckets binary, weights binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    grams = [(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["weights"], np.float32)) for r in rows]
    return train(grams, [int(r["quality"] > 0) for r in rows]), float(good or 0.0)


def score(docs: DataFrame, model: Model | None, share: float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per row of docs. The model is broadcast: about 3 MB, by its fixed sizes."""
    state = docs.sparkSession.sparkContext.broadcast((model.vectors, model.out, model.bias) if model else None)

    def run(batches):
        own = Model(*state.value) if state.value else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores = own.score(texts) if own else np.full(len(texts), share)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, *fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
