"""An approximate index of unit vectors: lists around centroids, residuals as product codes, exact scores for what these find.

The index is fitted on a bounded sample; every vector is held by one list. A query probes the lists whose centroids are nearest. How many
it has to probe is measured on the sample, so that vectors without clusters are found as well, at the price of more lists.
Lists are cut into slices and their queries into blocks, which meet in a grid, so that neither a large list nor many queries make a large task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.scratch import written

#: Vectors of the sample and lists, at most; bytes of a code, and values of each of them.
SAMPLE, LISTS, CODE_BYTES, VALUES = 20_000, 4096, 16, 256
#: The share of nearest neighbours in the sample that probes have to find, and of how many neighbours; sample queries that measure it.
TARGET, NEIGHBOURS, ASKED = 0.98, 10, 500
#: Vectors of a list that one task scores, queries of a list that one task answers, and vectors scored at once.
SLICE_ROWS, BLOCK_QUERIES, SCORED_ROWS = 100_000, 2_000, 4096
#: Vectors that are scored exactly, for each that is asked for.
RERANK = 20
SEED = 3


def _means(x: np.ndarray, k: int, rng: np.random.Generator, unit: bool = False, turns: int = 12) -> np.ndarray:
    """k centroids by Lloyd's turns; one without members stays. unit: of length 1, as members are dealt by their product with it."""
    means = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(turns):
        near = _nearest(x, means)
        total = np.zeros_like(means)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=k)[:, None]
        means = np.where(count > 0, total / np.maximum(count, 1), means)
        if unit:
            means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    return means


def _nearest(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    half = (means * means).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[at : at + 8192] @ means.T - half, axis=1) for at in range(0, len(x), 8192)]) if len(x) else np.zeros(0, int)


@dataclass
class Index:
    """centroids [list, size], books [byte, value, size / bytes], and how many lists a query probes."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int

    def parts(self, x: np.ndarray) -> np.ndarray:
        """x as [row, byte, size / bytes], filled up with zeros."""
        m, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, m * width - x.shape[1]))).reshape(len(x), m, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the code of each vector."""
        own = _nearest(x, self.centroids)
        rest = self.parts(x - self.centroids[own])
        codes = [_nearest(rest[:, m], book) for m, book in enumerate(self.books)]
        return own, np.stack(codes, axis=1).astype(np.uint8)

    def probed(self, q: np.ndarray) -> np.ndarray:
        """The lists [query, probe] that are looked through."""
        half = (self.centroids * self.centroids).sum(axis=1) / 2
        return np.argsort(half - q @ self.centroids.T, axis=1, kind="stable")[:, : self.probes]

    def scores(self, q: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """About the products [query, vector] with the vectors of a list."""
        table = np.einsum("qmw,mvw->qmv", self.parts(q), self.books)
        out = np.repeat((q @ self.centroids[of])[:, None], len(codes), axis=1)
        for m in range(codes.shape[1]):
            out += table[:, m, codes[:, m]]
        return out


def fit(vectors: DataFrame, sample: int = SAMPLE, target: float = TARGET) -> Index:
    """An index for a table (chunk_id, vector): from sample vectors, about, drawn by a hash of their ids."""
    held = vectors.where("vector is not null")
    n = held.count()
    some = held.where(F.pmod(F.xxhash64("chunk_id"), F.lit(max(n, 1))) < sample) if n > sample else held
    rows = sorted(some.select("chunk_id", F.col("vector").cast("array<double>")).collect())
    if not rows:
        raise ValueError("an index needs vectors")
    x, rng = np.array([r[1] for r in rows], dtype=np.float64), np.random.default_rng(SEED)
    k = max(1, min(LISTS, int(n**0.5), len(x) // 8))
    centroids = _means(x, k, rng, unit=True)
    index = Index(centroids, np.zeros((min(CODE_BYTES, x.shape[1]), 1, -(-x.shape[1] // min(CODE_BYTES, x.shape[1])))), k)
    own = _nearest(x, centroids)
    rest = index.parts(x - centroids[own])
    index.books = np.stack([_means(rest[:, m], min(VALUES, len(x)), rng) for m in range(rest.shape[1])])
    # The place, among the lists by distance, of the list of each of the nearest neighbours of some of the sample.
    asked = np.arange(0, len(x), max(1, len(x) // ASKED))
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-score, axis=1)[:, : min(NEIGHBOURS, len(x) - 1)]
    place = np.argsort(index.probed(x[asked]), axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).reshape(-1)) if near.size else np.zeros(1, int)
    index.probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1
    return index


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def stored(vectors: DataFrame, index: Index) -> DataFrame:
    """(list, chunk_id, code) of every vector, written by lists."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own, codes = index.encode(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "chunk_id", "code"])

    held = vectors.where("vector is not null").select(F.col("chunk_id").cast("long"), F.col("vector").cast("array<double>"))
    return written(held.mapInArrow(run, "list int, chunk_id long, code binary").repartition("list"), "index")


def candidates(queries: DataFrame, held: DataFrame, index: Index, most: int) -> DataFrame:
    """(q_id, chunk_id): for each query (q_id, vector) most vectors of stored() whose codes score best in the lists that it probes."""

    def probe(batches):
        for batch in batches:
            if batch.num_rows:
                lists = index.probed(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(lists.astype(np.int32)), pa.list_(pa.int32()))], names=["q_id", "vector", "lists"])

    sent = queries.mapInArrow(probe, "q_id long, vector array<double>, lists array<int>").select("q_id", "vector", F.explode("lists").alias("list"))
    # A row for each list, of which there are LISTS at most.
    sizes = held.groupBy("list").agg(F.ceil(F.count("*") / SLICE_ROWS).cast("int").alias("slices"))
    asks = sent.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks"))
    grid = written(sizes.join(asks, "list"), "grid")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lot = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = sent.join(F.broadcast(grid), "list").select("list", "q_id", "vector", lot("q_id", "blocks").alias("block"), each("slices").alias("slice"))
    right = held.join(F.broadcast(grid), "list").select(F.col("list").alias("of_list"), "chunk_id", "code", lot("chunk_id", "slices").alias("of_slice"), each("blocks").alias("of_block"))

    def score(asked: pa.Table, there: pa.Table) -> pa.Table:
        if not len(asked) or not len(there):
            return pa.table({"q_id": pa.array([], pa.int64()), "chunk_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q_id, q = asked.column("q_id").to_numpy(), _matrix(asked.column("vector").combine_chunks())
        chunk_id = there.column("chunk_id").to_numpy()
        codes = np.frombuffer(b"".join(there.column("code").to_pylist()), np.uint8).reshape(len(chunk_id), -1)
        of, best, who = asked.column("list")[0].as_py(), np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
        for at in range(0, len(codes), SCORED_ROWS):
            part = index.scores(q, of, codes[at : at + SCORED_ROWS])
            best = np.concatenate([best, part], axis=1)
            who = np.concatenate([who, np.broadcast_to(chunk_id[at : at + SCORED_ROWS], part.shape)], axis=1)
            if best.shape[1] > most:
                kept = np.argpartition(-best, most - 1, axis=1)[:, :most]
                best, who = np.take_along_axis(best, kept, axis=1), np.take_along_axis(who, kept, axis=1)
        return pa.table({"q_id": np.repeat(q_id, best.shape[1]), "chunk_id": who.reshape(-1), "score": best.reshape(-1)})

    met = left.groupBy("list", "slice", "block").cogroup(right.groupBy("of_list", "of_slice", "of_block")).applyInArrow(score, "q_id long, chunk_id long, score double")
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("score").desc(), "chunk_id"))
    return met.withColumn("place", place).where(F.col("place") <= most).select("q_id", "chunk_id")


def search(queries: DataFrame, vectors: DataFrame, held: DataFrame, index: Index, top_k: int, skip_same: bool = False, rerank: int = RERANK) -> DataFrame:
    """(q_id, rank, chunk_id, score), as the exact search gives it, of the vectors that the index finds; scores are exact."""
    asked = queries.where("vector is not null").select(F.col("q_id").cast("long").alias("q_id"), F.col("vector").cast("array<double>").alias("vector"))
    found = candidates(asked, held, index, max(1, top_k * rerank))
    if skip_same:
        found = found.where("q_id <> chunk_id")
    own = vectors.where("vector is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("vector").cast("array<double>").alias("other"))
    met = found.join(own, "chunk_id").join(asked, "q_id")
    score = F.aggregate(F.zip_with("vector", "other", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = met.select("q_id", "chunk_id", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("score").desc(), "chunk_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top_k).select("q_id", "rank", "chunk_id", "score")
