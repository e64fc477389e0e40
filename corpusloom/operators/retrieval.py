"""Exact nearest neighbours by cosine, and retrievers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.encoding import QUERY, Encoder
from corpusloom.sources.scratch import scratch_path, written

#: Queries that are sent to the tasks at once, as a matrix: a block of them is all that the driver ever holds.
QUERY_BLOCK = 4096
#: Vectors of the corpus that are scored at once; a task's matrix of scores has QUERY_BLOCK times as many cells.
CORPUS_ROWS = 512


def _best(query: np.ndarray, chunk: np.ndarray, score: np.ndarray, top_k: int) -> tuple:
    order = np.lexsort((chunk, -score, query))
    query, chunk, score = query[order], chunk[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query, side="left") < top_k
    return query[keep], chunk[keep], score[keep]


def _ranked(sent, corpus: DataFrame, top_k: int, skip_same: bool) -> DataFrame:
    """(q_id, rank, chunk_id, score) for a broadcast block of queries (ids, matrix): each task keeps its own best, a window ranks them."""

    def run(batches):
        own, q = sent.value
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        least = np.full(len(own), -np.inf)  # of each query that has top_k, the last score held
        found, n_found = [held], 0

        def merged() -> tuple:
            kept = _best(*(np.concatenate(x) for x in zip(*found)), top_k)
            end = np.cumsum(np.bincount(kept[0], minlength=len(own)))
            full = np.diff(end, prepend=0) == top_k
            least[full] = kept[2][end[full] - 1]
            return kept

        for batch in batches:
            for at in range(0, batch.num_rows, CORPUS_ROWS):
                part = batch.slice(at, CORPUS_ROWS)
                chunk = part.column(0).to_numpy(zero_copy_only=False)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                score = q @ flat.reshape(len(chunk), -1).T
                if skip_same:
                    score[own[:, None] == chunk[None]] = -np.inf
                near = (score >= least[:, None]) & np.isfinite(score)
                if len(chunk) > top_k and np.count_nonzero(near) > top_k * len(own):
                    near &= score >= np.partition(score, len(chunk) - top_k, axis=1)[:, len(chunk) - top_k, None]
                row, col = np.nonzero(near)
                found.append((row, chunk[col], score[row, col]))
                n_found += len(row)
                if n_found > top_k * len(own):
                    held = merged()
                    found, n_found = [held], 0
        held = merged()
        yield pa.RecordBatch.from_arrays([pa.array(own[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["q_id", "chunk_id", "score"])

    found = corpus.mapInArrow(run, "q_id long, chunk_id long, score double")
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("score").desc(), "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top_k).select("q_id", "rank", "chunk_id", "score")


def search(queries: DataFrame, corpus: DataFrame, top_k: int, skip_same: bool = False) -> DataFrame:
    """(q_id, rank, chunk_id, score): for each query (q_id, vector) the top_k of corpus (chunk_id, vector), unit vectors all.

    Best score first, then smaller chunk_id; top_k below 1 gives nothing. skip_same leaves out the chunk with the query's
    own id. Queries go to the tasks in blocks. Where there is more than one, the vectors are written to the shared folder
    first, so that encoders run once; each block's hits are written there too, and its broadcast is given up before the next.
    """
    spark = queries.sparkSession
    none = spark.createDataFrame([], "q_id long, rank int, chunk_id long, score double")
    if top_k < 1:
        return none
    asked = queries.where("vector is not null").select(F.col("q_id").cast("long").alias("q_id"), F.col("vector").cast("array<double>").alias("vector"))
    held = corpus.where("vector is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), "vector")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    if blocks > 1:
        held, path = written(held, "vectors"), scratch_path(spark, "hits")
        block_of = F.pmod(F.xxhash64("q_id"), F.lit(blocks)).cast("int").alias("block")
        asked_path = scratch_path(spark, "queries")
        asked.select("*", block_of).repartition("block").write.partitionBy("block").parquet(asked_path)
        asked = spark.read.schema("q_id long, vector array<double>, block int").parquet(asked_path)
    for b in range(blocks):
        rows = (asked.where(F.col("block") == b) if blocks > 1 else asked).select("q_id", "vector").collect()  # about QUERY_BLOCK rows
        if not rows:
            continue
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64)))
        ranked = _ranked(sent, held, top_k, skip_same)
        if blocks == 1:
            return ranked
        ranked.write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(none.schema).parquet(path) if blocks > 1 else none


class Retriever:
    """retrieve() answers a table of queries; subclasses hold what they search."""

    name = ""

    def retrieve(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        raise NotImplementedError

    def retrieve_one(self, query: str, spark, top_k: int = 10) -> DataFrame:
        return self.retrieve(spark.createDataFrame([(0, query)], "q_id long, question string"), top_k)


class VectorRetriever(Retriever):
    """Chunks (chunk_id, section, paragraph, text) with vectors (chunk_id, vector)."""

    name = "vector"
    fields = ("section", "paragraph", "text")

    def __init__(self, chunks: DataFrame, vectors: DataFrame, encoder: Encoder, prefix: str = QUERY, threshold: float | None = None):
        self.chunks, self.vectors, self.encoder, self.prefix, self.threshold = chunks, vectors, encoder, prefix, threshold

    def check(self) -> None:
        """Every chunk has a vector, and the other way round."""
        n, m = self.chunks.count(), self.vectors.count()
        if n != m or not self.chunks.join(self.vectors, "chunk_id", "left_anti").isEmpty():
            raise RuntimeError(f"{n} chunks and {m} vectors do not match")

    def retrieve(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        hits = search(self.encoder.encode(queries, "q_id", "question", self.prefix), self.vectors, top_k)
        if self.threshold is not None:
            hits = hits.where(F.col("score") >= self.threshold)
        met = hits.join(self.chunks.select("chunk_id", *self.columns()), "chunk_id")
        return met.select("q_id", "rank", "chunk_id", F.bround("score", 4).alias("score"), *self.fields)

    def columns(self) -> list:
        return [F.col(c) for c in self.fields]


class RichRetriever(VectorRetriever):
    """Also gives what rich records hold; what a record lacks is '' or an empty array."""

    name = "rich"
    fields = (*VectorRetriever.fields, "summary", "context_prefix", "modern_summary", "questions")

    def columns(self) -> list:
        there = self.chunks.columns
        empty = {"questions": F.array().cast("array<string>")}
        return [F.coalesce(F.col(c), empty.get(c, F.lit(""))).alias(c) if c in there and c not in VectorRetriever.fields else F.col(c) if c in there else empty.get(c, F.lit("")).alias(c) for c in self.fields]


RETRIEVERS = {x.name: x for x in (VectorRetriever, RichRetriever)}


def list_retrievers() -> list[str]:
    return list(RETRIEVERS)


def get_retriever(name: str, *what, **how) -> Retriever:
    if name not in RETRIEVERS:
        raise ValueError(f"unknown retriever {name!r}; there are {sorted(RETRIEVERS)}")
    return RETRIEVERS[name](*what, **how)
