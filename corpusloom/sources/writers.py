"""Writers: nested corpora, chunks, vectors, reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_corpus(paragraphs: DataFrame, path: str, title: str, source: str) -> None:
    """The nested corpus in the fields of its files, one JSON line a section with the corpus's constants; read_corpus reads it with lines set.

    paragraphs: section, para_no, text, gloss, text_raw; group and title, if there, are those of the section.
    """
    headed = [c for c in ("group", "title") if c in paragraphs.columns]
    of = {c: F.col(c) if c in headed else F.lit("") for c in ("group", "title")}
    one = F.struct(F.col("para_no").cast("int").alias("seif"), "text", F.col("gloss").alias("hagah"), "text_raw")
    nested = paragraphs.withColumns({"_group": of["group"], "_title": of["title"]}).groupBy(F.col("section").cast("int").alias("siman"), F.col("_group").alias("hilchot_group"), F.col("_title").alias("siman_sign")).agg(F.array_sort(F.collect_list(one)).alias("seifim"))
    sections = nested.select(F.lit(title).alias("title"), F.lit(source).alias("source"), F.array(F.struct("siman", "hilchot_group", "siman_sign", "seifim")).alias("simanim"))
    sections.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_pretty_json(df: DataFrame, path: str) -> None:
    """A small table as one indented JSON file, through the driver."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(rows, ensure_ascii=False, indent=2, default=str) + "\n", encoding="utf-8")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def replace_collection(df: DataFrame, name: str) -> None:
    """A vector collection as a managed table: dropped and written again."""
    df.write.mode("overwrite").saveAsTable(name)


def dump_first_query(retriever, questions: DataFrame, path: str, top_k: int) -> None:
    """The hits of the first question, as they are."""
    first = questions.orderBy("q_id").limit(1)
    if first.isEmpty():
        raise ValueError("there is no question")
    write_pretty_json(retriever.retrieve(first, top_k).orderBy("rank"), path)
