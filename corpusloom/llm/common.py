"""Helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources.scratch import written

#: One white-space character and a run of other characters, as the operators understand words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row: a lambda's variable is bound, while a repeated expression is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has, counted without building them: places where a word begins."""
    clean = F.coalesce(text, F.lit(""))
    return F.regexp_count(clean, F.lit(WORD)).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


#: Parts in which the rows of one key are numbered.
SLOTS = 256


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """df with out: 1, 2, 3 … among the rows with equal keys, by a hash of the order columns and then these.

    A key's rows are numbered in SLOTS parts, each after the sizes of the parts before it, so that a hot key is no one
    task's. Keys may be null.
    """
    slotted = df.withColumn("__slot", F.pmod(F.xxhash64(*order), F.lit(SLOTS)))
    sizes = slotted.groupBy(*keys, "__slot").agg(F.count("*").alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__slot").alias("__of"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    within = F.row_number().over(Window.partitionBy(*keys, "__slot").orderBy(*order))
    same = F.col("__slot") == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    met = slotted.withColumn("__within", within).join(offset, same)
    return met.withColumn(out, F.col("__offset") + F.col("__within")).select(*df.columns, out)


#: A group that holds over one in HOT_SHARE of all rows is hot; so fewer than HOT_SHARE groups are.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with groups, one row for each key with its size in rows, of total rows at most; the only shared column is key.

    Hot groups are broadcast, fewer than HOT_SHARE of them whatever the tables hold; all others meet their rows in a shuffle
    in which no key has more than total / HOT_SHARE rows.
    """
    hot = F.broadcast(groups.where(F.col(size) * HOT_SHARE > total))
    cold = groups.where(F.col(size) * HOT_SHARE <= total)
    met = rows.join(hot, key)
    return met.unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def follow(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """rows with the columns of found, one row for each key; null where there is none. A key may be in any share of the rows."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("__size"))
    asked = written(sizes.join(found, key, "left"), "asked")
    total = asked.agg(F.coalesce(F.sum("__size"), F.lit(0))).first()[0]
    return join_groups(rows, asked, key, "__size", total).drop("__size")


#: The column by which one_of_each tells rows apart.
ROW_KEY = "__row_key"


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that tell documents apart: by doc_id and by text (or its digest). Null is an id of its own; null texts count as empty."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(" "), F.coalesce(text, F.lit("")))))


def free_name(name: str, columns: list[str]) -> str:
    """name, or name with as many underscores as make it another than all columns."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def one_of_each(docs: DataFrame, text: Column, kept: DataFrame) -> DataFrame:
    """The rows of docs whose key is in kept (ROW_KEY); of rows with one key, one of them.

    Rows with one key are thinned out before the shuffle, so no key brings many rows to a task; the join reuses its order.
    """
    key = free_name(ROW_KEY, docs.columns)
    thinned = docs.withColumn(key, row_key(F.col("doc_id"), text)).dropDuplicates([key])
    return thinned.join(kept.select(F.col(ROW_KEY).alias(key)), key, "left_semi").select(*(f"`{c}`" for c in docs.columns))
