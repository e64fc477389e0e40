"""Exact dedup against a minimal perfect hash over the distinct digests seen so far.

Texts are equal when identical after each run of the six ASCII space characters is replaced by one space; null counts as
empty, so null and empty texts are copies of one another. Of equal texts one row stays: that with the smallest doc_id, where
null sorts after all others; of rows that share that doc_id too, one of them. Texts are read whole, whatever their length.
Columns other than doc_id and text are carried along by the stage, whatever their names, and ignored otherwise; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ROW_KEY, SPACE, join_groups, one_of_each, row_key
from corpusloom.sources.scratch import written

#: Digests in one bucket of the hash, about: what one task holds at once is a few buckets of 48 bytes a digest.
BUCKET_ROWS = 4096
#: Bits of a level for each key that is still unplaced; a level that places none is followed by the next one.
SLACK = 2.0
DIGEST = 32

#: Parts in which the rows of one digest are summed before they are looked up: at most so many keys for a hot digest.
PARTS = 32

INDEX_SCHEMA = "bucket long, levels array<binary>, digests binary, ids binary, known binary, rows binary, sizes binary"
GROUP = ("digest", "keep_id", "keep_row", "group_size")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def digest(text: Column) -> Column:
    """The SHA-256 of the normalised text as 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(row, doc_id, digest); row is a number of its own for each row, fixed once the table is written."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text").cast("string")).alias("digest"))


def grouped(rows: DataFrame, *keys: str) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) of rows (row, doc_id, digest), by digest and keys; summed before the shuffle."""
    keep_row = F.coalesce(F.min_by("row", "doc_id"), F.min("row"))
    return rows.groupBy("digest", *keys).agg(F.min("doc_id").alias("keep_id"), keep_row.alias("keep_row"), F.count("*").alias("group_size")).drop(*keys)


def regrouped(groups: DataFrame) -> DataFrame:
    """Groups (digest, keep_id, keep_row, group_size) with repeated digests summed."""
    keep_row = F.coalesce(F.min_by("keep_row", "keep_id"), F.min("keep_row"))
    return groups.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), keep_row.alias("keep_row"), F.sum("group_size").alias("group_size"))


def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where the keys fall in a level: a multiply-and-mix of two words of the digest and the level's number."""
    x = words[:, 1] + words[:, 2] * np.uint64(2 * level + 1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash as bit levels: a key sits in the first level where no other unplaced key falls on its bit.

    A key's slot is the number of set bits before its own, over all levels: slots are 0 .. n - 1 without gaps.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.rank = [np.cumsum(x) - x for x in levels]

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        levels, left = [], words
        while len(left):
            size = max(8, int(SLACK * len(left)) // 8 * 8 + 8)
            at = _places(left, len(levels), size)
            once = np.bincount(at, minlength=size) == 1
            levels.append(once.astype(np.int64))
            left = left[~once[at]]
        return cls(levels)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key outside the set, any slot or -1."""
        out = np.full(len(words), -1, dtype=np.int64)
        open_ = np.arange(len(words))
        for k, bits in enumerate(self.levels):
            at = _places(words[open_], k, len(bits))
            hit = bits[at] == 1
            out[open_[hit]] = self.before[k] + self.rank[k][at[hit]]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> list[bytes]:
        return [np.packbits(x.astype(np.uint8)).tobytes() for x in self.levels]

    @classmethod
    def from_bytes(cls, parts: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(x, dtype=np.uint8)).astype(np.int64) for x in parts])


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, DIGEST)


def _words(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view(np.uint64).reshape(-1, DIGEST // 8)


def bucket_of(digest: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(buckets)).cast("long")


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The perfect hash of a history of distinct digests, one row a bucket: levels and, by slot, digest, winner and size.

    The winner's locator is its doc_id (known is 0 for a null one) and its row.
    """

    def build(part: pa.Table) -> pa.Table:
        raw = _bytes(part.column("digest"))
        hash_ = PerfectHash.build(_words(raw))
        order = np.argsort(hash_.slots(_words(raw)))
        ids = part.column("keep_id")
        held = {
            "digests": raw,
            "ids": ids.fill_null(0).to_numpy(),
            "known": ids.is_valid().to_numpy().astype(np.uint8),
            "rows": part.column("keep_row").to_numpy(),
            "sizes": part.column("group_size").to_numpy(),
        }
        binary = {k: pa.array([v[order].tobytes()], pa.binary()) for k, v in held.items()}
        return pa.table({"bucket": part.column("bucket")[:1], "levels": pa.array([hash_.to_bytes()], pa.list_(pa.binary())), **binary})

    return history.withColumn("bucket", bucket_of(F.col("digest"), buckets)).groupBy("bucket").applyInArrow(build, INDEX_SCHEMA)


def look_up(groups: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """groups with found, and with old_id, old_row and old_size of the indexed digest that is byte for byte the same."""
    schema = "digest binary, keep_id long, keep_row long, group_size long, found boolean, old_id long, old_row long, old_size long"
    asked = groups.withColumn("bucket", bucket_of(F.col("digest"), buckets)).groupBy("bucket")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.select(list(GROUP))
        n = len(rows)
        found, old = np.zeros(n, bool), {k: np.zeros(n, np.int64) for k in ("ids", "known", "rows", "sizes")}
        if n and len(right):
            held = lambda name, kind: np.frombuffer(right.column(name)[0].as_py(), dtype=kind)
            raw = _bytes(rows.column("digest"))
            slot = PerfectHash.from_bytes(right.column("levels")[0].as_py()).slots(_words(raw))
            found = (slot >= 0) & (held("digests", np.uint8).reshape(-1, DIGEST)[slot] == raw).all(axis=1)
            old = {k: held(k, np.uint8 if k == "known" else np.int64)[slot] for k in old}
        given = {name: pa.array(old[k], pa.int64(), mask=~found) for name, k in (("old_row", "rows"), ("old_size", "sizes"))}
        ids = pa.array(old["ids"], pa.int64(), mask=~(found & (old["known"] > 0)))
        return pa.table({**{c: rows.column(c) for c in GROUP}, "found": pa.array(found), "old_id": ids, **given})

    return asked.cogroup(index.groupBy("bucket")).applyInArrow(probe, schema)


def dedup(rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) for every distinct digest of rows and of a history (row, doc_id, digest both).

    The distinct digests of the history are indexed. The rows, summed in parts so that a hot digest is few keys, are looked
    up: members add to the group of their slot, whose winner stays unless they have a smaller doc_id; nonmembers are
    grouped on their own. The groups are written once.
    """
    if history is None:
        return written(grouped(rows), "groups")
    old = written(grouped(history), "history")
    buckets = max(64, -(-old.count() // BUCKET_ROWS))
    parts = grouped(rows.withColumn("part", F.pmod("row", F.lit(PARTS))), "part")
    met = written(look_up(parts, build_index(old, buckets), buckets), "met")
    new = written(regrouped(met.where("not found").select(*GROUP)), "new")
    first = lambda a, b: F.coalesce(F.col(a) < F.col(b), F.col(a).isNotNull())
    keep_row = F.coalesce(F.min_by("keep_row", "keep_id"), F.min("keep_row"))
    joined = met.where("found").groupBy("digest").agg(F.min("keep_id").alias("keep_id"), keep_row.alias("keep_row"), F.sum("group_size").alias("group_size"), *(F.first(c).alias(c) for c in ("old_id", "old_row", "old_size")))
    joined = written(joined, "members")
    members = joined.select("digest", F.least("keep_id", "old_id").alias("keep_id"), F.when(first("keep_id", "old_id"), F.col("keep_row")).otherwise(F.col("old_row")).alias("keep_row"), (F.col("group_size") + F.col("old_size")).alias("group_size"))
    alone = old.join(joined.select("digest"), "digest", "left_anti")
    return written(new.unionByName(members).unionByName(alone.select(*GROUP)), "groups")


def groups_of(rows: DataFrame) -> DataFrame:
    """The groups of written rows, which arrive in two loads: ids up to the middle of their range are the history, the rest are looked up."""
    ends = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = (ends[0] + ends[1]) // 2 if ends[0] is not None else 0
    early = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    return dedup(rows.where(~early), rows.where(early))


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. One row of each group is kept."""
    rows = written(digests(docs), "rows")
    met = join_groups(rows, groups_of(rows), "digest", "group_size", rows.count())
    return met.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays. Rows are told apart by doc_id and text, so no text is lost where rows share an id."""
    groups = groups_of(written(digests(docs), "rows"))
    kept = groups.select(row_key(F.col("keep_id"), F.hex("digest")).alias(ROW_KEY))
    return one_of_each(docs, F.hex(digest(F.col("text").cast("string"))), kept)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""
