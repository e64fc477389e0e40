"""A corpus pipeline of five stages: quality rules, exact dedup, near-dedup, mixing, BPE.

Each stage reads what the one before it wrote. All but the last return the columns of documents. Learned rules make a stage
that SQL cannot express, so there is no SQL for the whole; the tests hold the stages against brute force.

Rows: null, empty and blank texts have fewer than 50 words, so the first stage rejects them. Of repeated rows and equal texts one
stays, that with the smallest doc_id (null last); of near copies likewise. Rows that share a doc_id, or have none, are told apart by
their texts. Texts are read whole by every stage, whatever their length; the mix may cut a text at its last taken word. A null source is a
source of its own. Columns besides those of documents come through, whatever their names, until the last stage, which returns its own. Empty tables give an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from corpusloom.sources.scratch import written

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", simhash.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, n_tokens, ids_sha256 and decoded_sha256 of every mixed document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
