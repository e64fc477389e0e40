"""Chunks of sections: paragraphs, whole sections, and sliding windows of words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.refs import label
from corpusloom.functions.text import join_fields, word_count, words
from corpusloom.operators.prefix import running_sum

SIZE, OVERLAP = 200, 50


def paragraph_chunks(paragraphs: DataFrame, fields: tuple[str, ...] = ("text", "gloss")) -> DataFrame:
    """One chunk a paragraph (section, para_no): its fields joined; without any, an empty text."""
    return paragraphs.select("section", F.col("para_no").alias("paragraph"), label(F.col("section"), F.col("para_no")).alias("label"), join_fields(*map(F.col, fields)).alias("text"))


def section_chunks(paragraphs: DataFrame, fields: tuple[str, ...] = ("text", "gloss")) -> DataFrame:
    """One chunk a section: the fields of its paragraphs in order."""
    parts = paragraphs.select("section", "para_no", join_fields(*map(F.col, fields)).alias("part"))
    joined = parts.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("para_no", "part"))).alias("parts"))
    text = F.array_join(F.filter(F.col("parts.part"), lambda x: x != ""), " ")
    return joined.select("section", F.lit(None).cast("long").alias("paragraph"), label(F.col("section")).alias("label"), text.alias("text"))


def _check(size: int, overlap: int) -> int:
    if not 0 <= overlap < size:
        raise ValueError(f"0 <= overlap < size is needed, not {overlap}, {size}")
    return size - overlap


def _windows(parts: DataFrame, keys: list[str], size: int, step: int) -> DataFrame:
    """Windows over parts (keys, section, ord, part, start): each part is split into words here, and cut once for each window that it touches."""
    parts = parts.withColumn("words", words(F.col("part"))).drop("part")
    first = F.greatest(F.lit(0), F.ceil((F.col("start") - size + 1) / step)).cast("long")
    last = F.floor((F.col("start") + F.size("words") - 1) / step).cast("long")
    touched = parts.where(F.size("words") > 0).select("*", F.explode(F.sequence(first, last)).alias("window"))
    low = F.greatest(F.col("window") * step - F.col("start"), F.lit(0)).cast("int")
    high = F.least(F.col("window") * step + size - F.col("start"), F.size("words")).cast("int")
    cut = touched.withColumn("piece", F.array_join(F.slice("words", low + 1, high - low), " ")).withColumn("n", high - low)
    grouped = cut.groupBy(*keys, "window").agg(F.min(F.struct("start", "section"))["section"].alias("owner"), F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("pieces"), F.sum("n").cast("long").alias("n_words"))
    return grouped.select(*keys, "window", "owner", F.array_join(F.col("pieces.piece"), " ").alias("text"), "n_words")


def sliding_chunks(paragraphs: DataFrame, fields: tuple[str, ...] = ("text",), size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows of size words every size - overlap words over the whole corpus, in the order of section and para_no.

    Windows cross sections; a window belongs to the section of its first word. The last ones may be shorter, also where the
    one before holds all their words.
    """
    step = _check(size, overlap)
    parts = paragraphs.select("section", "para_no", join_fields(*map(F.col, fields)).alias("part")).withColumn("n", word_count(F.col("part")))
    placed = running_sum(parts, "section", "n", "start", "para_no")  # texts are moved whole: arrays of words take a multiple of their room
    found = _windows(placed, [], size, step)
    return found.select("window", F.col("owner").alias("section"), F.lit(None).cast("long").alias("paragraph"), F.concat(F.col("owner").cast("string"), F.lit(":"), F.col("window").cast("string")).alias("label"), "text", "n_words")


def section_windows(paragraphs: DataFrame, fields: tuple[str, ...] = ("text",), size: int = SIZE, overlap: int = 0) -> DataFrame:
    """Windows of size words that stay within a section."""
    step = _check(size, overlap)
    parts = paragraphs.select("section", "para_no", join_fields(*map(F.col, fields)).alias("part")).withColumn("n", word_count(F.col("part")))
    before = Window.partitionBy("section").orderBy("para_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))
    return _windows(placed.withColumn("of", F.col("section")), ["of"], size, step).select(F.col("of").alias("section"), "window", "text", "n_words")


CHUNKERS: dict[str, Callable[..., DataFrame]] = {"paragraph": paragraph_chunks, "section": section_chunks, "sliding": sliding_chunks}


def chunk(paragraphs: DataFrame, mode: str, **how) -> DataFrame:
    if mode not in CHUNKERS:
        raise ValueError(f"unknown mode {mode!r}; there are {sorted(CHUNKERS)}")
    return CHUNKERS[mode](paragraphs, **how)


def build_chunks(paragraphs: DataFrame, mode: str, **how) -> DataFrame:
    """chunk() with chunk_id from 0: by section and paragraph, or by window."""
    chunks = chunk(paragraphs, mode, **how)
    return numbered(chunks, "window") if "window" in chunks.columns else numbered(chunks, "section", "paragraph")


def numbered(chunks: DataFrame, key: str, *order: str, out: str = "chunk_id") -> DataFrame:
    """chunks with their place, from 0, in the order of the number key and then order."""
    return running_sum(chunks.withColumn("_one", F.lit(1)), key, "_one", out, *order).drop("_one")


