"""Readers: text lines, nested corpora, chunks, questions, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.enrich import heading_map, require
from corpusloom.sources import schemas
from corpusloom.sources.matrix import MatrixSource
from corpusloom.sources.scratch import written


#: Blocks of files whose first line numbers are sent to all tasks, at most; where there are more, lines and blocks are joined by a shuffle.
BLOCKS_SENT = 200_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc, line_no, line) of text files, line_no from 0; doc is the file. An empty file has no lines.

    Files are read in blocks, by as many tasks as there are; a line belongs to the block in which it begins. The lines of each
    block are counted first, and then numbered from the counts of the blocks before it, by their places in the file.
    """
    place = F.monotonically_increasing_id()  # rises by one from line to line of a block, which one task reads
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_block_start").alias("_block"), place.alias("_place"), F.col("value").alias("line"))
    before = Window.partitionBy("_doc").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = read.groupBy(F.col("doc").alias("_doc"), "_block").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    blocks = written(counts.select("_doc", F.col("_block").alias("_of"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset")), "blocks")
    sent = F.broadcast(blocks) if blocks.count() <= BLOCKS_SENT else blocks
    met = read.join(sent, (F.col("doc") == F.col("_doc")) & (F.col("_block") == F.col("_of")))
    return met.select("doc", (F.col("_offset") + F.col("_place")).alias("line_no"), "line")


def read_corpus(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(title, source, section, group, title_of_section, paragraph, text, gloss, text_raw), one row a paragraph.

    A file holds one corpus, or, with lines, sections as write_corpus writes them, which are read in parts.
    """
    nested = spark.read.schema(schemas.CORPUS_FILE).json(path, multiLine=not lines)
    sections = nested.select("title", "source", F.inline("simanim"))
    return sections.select("title", "source", F.col("siman").alias("section"), F.col("hilchot_group").alias("group"), F.col("siman_sign").alias("title_of_section"), F.inline("seifim")).withColumnsRenamed({"seif": "paragraph", "hagah": "gloss"})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Rich paragraph records from a JSON array."""
    return spark.read.schema(schemas.RICH).json(path, multiLine=True)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from CSV: needs section, paragraph and text; an empty text stays ''."""
    found = require(read_csv(spark, path), {"section", "paragraph", "text"})
    return found.select(*(F.col(c).cast("int") if c in ("section", "paragraph") else F.coalesce(c, F.lit("")).alias(c) if c == "text" else F.col(c) for c in found.columns))


def aliased(df: DataFrame) -> DataFrame:
    """Columns of a question file under their usual names."""
    known = {c: schemas.QUERY_HEADERS[c.strip().lower()] for c in df.columns if c.strip().lower() in schemas.QUERY_HEADERS}
    return df.withColumnsRenamed(known)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Questions from CSV, in Hebrew or English: needs question, section and paragraph."""
    found = require(aliased(read_csv(spark, path)), {"question", "section", "paragraph"})
    return found.withColumns({c: F.col(c).cast(kind) for c, kind in (("q_id", "long"), ("section", "int"), ("paragraph", "int")) if c in found.columns})


def read_headings(spark: SparkSession, path: str) -> DataFrame:
    return heading_map(read_lines(spark, path))


def read_matrix(spark: SparkSession, path: str, part_bytes: int | None = None) -> DataFrame:
    """Vectors of a numpy file, keyed by row; each task reads the bytes of its own rows."""
    spark.dataSource.register(MatrixSource)
    asked = spark.read.format("matrix")
    return (asked.option("partBytes", part_bytes) if part_bytes else asked).load(path)


def check_same_rows(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> None:
    if (n := chunks.count()) != (m := vectors.count()):
        raise RuntimeError(f"{n} chunks, but {m} vectors")
    if not (chunks.join(vectors, key, "left_anti").isEmpty() and vectors.join(chunks, key, "left_anti").isEmpty()):
        raise RuntimeError("chunks and vectors have other keys")
