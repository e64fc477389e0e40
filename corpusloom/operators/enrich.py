"""Headings, lookups, nesting, and checks of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.refs import breadcrumb, heading
from corpusloom.functions.text import strip
from corpusloom.operators.carry import carried


def heading_map(lines: DataFrame) -> DataFrame:
    """(section, group, title) of heading lines (doc, line_no, line): a group holds for the sections after it; of repeated sections the last wins.

    A section without a description has its group as title.
    """
    parsed = lines.where(strip(F.col("line")) != "").withColumn("h", heading(F.col("line")))
    filled = carried(parsed, lasts={"group": F.col("h.group")}).withColumn("group", F.coalesce("group", F.lit(""))).where("h.section is not null")
    row = F.struct("doc", "line_no", F.col("group"), F.coalesce("h.title", "group").alias("title"))
    last = filled.groupBy(F.col("h.section").alias("section")).agg(F.max(row).alias("row"))
    return last.select("section", "row.group", "row.title")


def enriched(sections: DataFrame, headings: DataFrame, key: str = "section") -> DataFrame:
    """sections with group and title from headings; '' where there is none, and no title like the group. Old values are replaced.

    The new columns stand before paragraphs, if there is such a column, and at the end otherwise.
    """
    old = [c for c in ("group", "title") if c in sections.columns]
    found = headings.select(F.col("section").alias("_of"), F.col("group").alias("_group"), F.col("title").alias("_title"))
    met = sections.drop(*old).join(found, F.col(key).cast("string") == F.col("_of"), "left")
    group, title = (F.coalesce(c, F.lit("")) for c in ("_group", "_title"))
    named = met.withColumn("group", group).withColumn("title", F.when(title == F.col("group"), F.lit("")).otherwise(title))
    kept = [c for c in sections.columns if c not in ("group", "title")]
    at = kept.index("paragraphs") if "paragraphs" in kept else len(kept)
    return named.select(*kept[:at], "group", "title", *kept[at:])


def without_heading(sections: DataFrame, headings: DataFrame, key: str = "section") -> DataFrame:
    return sections.join(headings.select(F.col("section").alias("_of")), F.col(key).cast("string") == F.col("_of"), "left_anti")


def with_breadcrumb(rows: DataFrame, root: str) -> DataFrame:
    return rows.withColumn("breadcrumb", breadcrumb(F.col("group"), F.col("title"), root))


def nest(paragraphs: DataFrame, fields: tuple[str, ...] = ("text", "gloss", "text_raw")) -> DataFrame:
    """One row a section: paragraphs as an array of structs, in order."""
    one = F.struct(F.col("para_no").cast("int").alias("paragraph"), *fields)
    return paragraphs.groupBy("section").agg(F.array_sort(F.collect_list(one)).alias("paragraphs"))


def unnest(sections: DataFrame) -> DataFrame:
    return sections.select("section", F.inline("paragraphs")).withColumnRenamed("paragraph", "para_no")


def misaligned(raw: DataFrame, clean: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys that only one of two tables has, with the side; nothing means that they are aligned."""
    marked = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    both = marked(raw, "in_raw").join(marked(clean, "in_clean"), list(keys), "full")
    return both.where("in_raw is null or in_clean is null").select(*keys, F.when(F.col("in_raw").isNull(), F.lit("clean")).otherwise(F.lit("raw")).alias("side"))


def check_aligned(raw: DataFrame, clean: DataFrame, keys: tuple[str, ...]) -> None:
    if rows := misaligned(raw, clean, keys).limit(10).collect():
        raise RuntimeError(f"raw and clean text differ in {[tuple(r) for r in rows]}")


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def coverage(paragraphs: DataFrame, text: Column, gloss: Column) -> DataFrame:
    """One row: sections, paragraphs, those with a gloss and their share, those without text."""
    n = F.count("*").cast("double")
    has = F.count_if(F.coalesce(gloss, F.lit("")) != "")
    return paragraphs.agg(F.countDistinct("section").alias("sections"), F.count("*").alias("paragraphs"), has.alias("with_gloss"), share(has, n).alias("gloss_share"), F.count_if(F.coalesce(text, F.lit("")) == "").alias("without_text"))


def rule_totals(rows: DataFrame, counts: Column) -> DataFrame:
    """(rule, n) from an array of such structs a row."""
    return rows.select(F.explode(counts).alias("x")).groupBy("x.rule").agg(F.sum("x.n").cast("long").alias("n"))


def missing_columns(df: DataFrame, required: set[str]) -> set[str]:
    return set(required) - set(df.columns)


def require(df: DataFrame, required: set[str]) -> DataFrame:
    if missing := missing_columns(df, required):
        raise ValueError(f"columns {sorted(missing)} are missing; there are {df.columns}")
    return df
