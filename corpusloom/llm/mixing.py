"""Mixing sources to target weights by weighted fair queueing.

Rows: a null text has size 0 and is taken 0 times; null is a source of its own, ordered last. Repeated rows are separate
documents; ties in the shuffle are broken by doc_id, size and text, so reruns agree. A null doc_id is shuffled like others.
A very long text is served in packets, so it may be taken in part. Columns other than doc_id, text and source are carried
along by the stage, whatever their names, and ignored otherwise; an empty table gives an empty result. The number of
sources is taken to be small: one row for each is ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACE, WORD, free_name, n_words
from corpusloom.sources.scratch import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 7
#: Documents or packets that one window partition sums up, about.
QUEUE_ROWS = 20_000
#: A document is served in packets of so many words at most: at least LEAST_PACKET, and else one in PACKETS of its source's target.
LEAST_PACKET, PACKETS = 64, 2000
ROW = "__row"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, src, n, source_size, target) from one row per source; src numbers the sources by code point, null last.

    Filling up: sources in the order in which they reach most times their size take that, and what is left is shared by
    weight among the others. The windows without a partition run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    src = (F.row_number().over(order) - 1).cast("long")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("src"), F.lit(len(weights))).cast("int") + 1)
    cap = F.col("source_size") * F.lit(float(most))
    by_fill = Window.orderBy((cap / F.col("weight")).asc(), "src")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = sizes.withColumn("src", src).withColumn("weight", weight).withColumn("level", level).withColumn("full", cap <= F.col("level") * F.col("weight"))
    water = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)  # of the first source that does not fill up
    aim = F.when(F.col("full"), cap).otherwise(F.least(cap, water * F.col("weight")))
    return leveled.select("source", "src", "n", "source_size", F.round(aim, 6).alias("target"))


def _queued(sized: DataFrame, order: list[str]) -> DataFrame:
    """sized with end, the running sum of size in its source: (src, slot) is summed alone, then offset by the slots before it."""
    totals = sized.groupBy("src", "slot").agg(F.sum("size").alias("slot_size"))
    before = Window.partitionBy("src").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = totals.select(F.col("src").alias("o_src"), F.col("slot").alias("o_slot"), F.coalesce(F.sum("slot_size").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("src", "slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = sized.withColumn("within", F.sum("size").over(within))
    return summed.join(offset, (F.col("src") == F.col("o_src")) & (F.col("slot") == F.col("o_slot"))).withColumn("end", F.col("offset") + F.col("within"))


def lot(seed: int) -> Column:
    """The shuffle: 60 bits of an MD5 over the seed and doc_id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame, row: Column, seed: int = SEED) -> DataFrame:
    """(ROW, doc_id, source, size, lot, tie) of documents."""
    text = F.col("text").cast("string")
    named = docs.select(row.alias(ROW), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("tie"))
    return named.withColumn("lot", lot(seed))


def packets(queued: DataFrame, most: int = MOST) -> DataFrame:
    """(ROW, src, pos, finish, words): what each document sends, most times over.

    queued: documents with start, the words of their source before them. A packet's virtual finish time is the words of its
    source up to its end, pos, divided by the source's target.
    """
    width = F.greatest(F.lit(LEAST_PACKET), F.ceil(F.col("target") / PACKETS)).cast("long")
    sent = queued.where("size > 0").withColumn("width", width)
    each = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.col("width"))
    turns = sent.withColumn("turn", F.explode(F.array(*map(F.lit, range(most))))).withColumn("first", F.explode(each))
    words = F.least(F.col("width"), F.col("size") - F.col("first"))
    pos = F.col("turn") * F.col("source_size") + F.col("start") + F.col("first") + words
    return turns.select(ROW, "src", pos.alias("pos"), (pos.cast("double") / F.col("target")).alias("finish"), words.alias("words"))


def served(entries: DataFrame, budget: int, n_entries: int) -> DataFrame:
    """(ROW, taken): the words that each document sends within the budget, in the global order of finish times.

    The entries are range-sorted by finish time, then source and place. Each range's total is offset by those of the ranges
    before it, a table of one row for each QUEUE_ROWS entries; within a range the words are summed in order, and the
    entry at which the sum reaches the budget is the last.
    """
    order = ["finish", "src", "pos"]
    ranges = max(64, -(-n_entries // QUEUE_ROWS))
    # Written, as the bounds of the ranges are sampled: another run of the same plan could draw others.
    ranged = written(entries.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("range").agg(F.sum("words").alias("total")).select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset")).where(F.col("offset") < budget)
    within = F.sum("words").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = ranged.join(F.broadcast(offsets), "range").withColumn("left", F.lit(budget) - F.col("offset") - within + F.col("words"))
    return summed.where("left > 0").groupBy(ROW).agg(F.sum(F.least("words", "left")).alias("taken"))


def mixed(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(ROW, doc_id, source, size, source_size, target, taken) of written sizes().

    Each source's documents queue in shuffled order, most times over, and are served by weighted fair queueing: in the order
    of their virtual finish times, which are the words that their source has sent by then, divided by its target. The mix
    is what is served until the total budget is reached, so a source ends within a packet of its target.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    aims = written(targets(per_source, weights, share, most), "targets").withColumnRenamed("source", "of")
    slots = F.greatest(F.ceil(F.col("n") / F.lit(QUEUE_ROWS)), F.lit(64))
    slotted = sized.join(F.broadcast(aims), F.col("source").eqNullSafe(F.col("of"))).withColumn("slot", F.floor(F.col("lot") / F.lit(2.0**60) * slots).cast("long"))
    queued = written(_queued(slotted, ["lot", "doc_id", "size", "tie"]).select(ROW, "doc_id", "source", "src", "size", "source_size", "target", (F.col("end") - F.col("size")).alias("start")), "queue")
    entries = packets(queued, most)
    total = aims.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    taken = served(entries, math.floor(total * share), entries.count()).withColumnRenamed(ROW, "__of")
    met = queued.join(taken, F.col(ROW) == F.col("__of"), "left")
    return met.select(ROW, "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and taken, one row per row of docs."""
    return mixed(written(sizes(docs, F.monotonically_increasing_id(), seed), "sizes"), weights, share, most).drop(ROW)


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"{SPACE}*{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents: a row for each time that a document is taken; a partly taken one is cut after its last taken word.

    The documents are written once with a number for each row, so that repeated rows keep what each of them is due. n_chars
    follows a cut text.
    """
    row, size, taken, due = (free_name(x, docs.columns) for x in (ROW, "__size", "__taken", "__due"))
    tagged = written(docs.withColumn(row, F.monotonically_increasing_id()), "tagged")
    took = mixed(written(sizes(tagged, F.col(row)), "sizes")).where("taken > 0").select(F.col(ROW).alias(row), F.col("size").alias(size), F.col("taken").alias(taken))
    times = F.filter(F.array(*(F.least(F.col(size), F.col(taken) - k * F.col(size)) for k in range(MOST))), lambda x: x > 0)
    cut = tagged.join(took, row).withColumn(due, F.explode(times))
    partly = F.col(due) < F.col(size)
    text = F.when(partly, first_words(F.col("text"), F.col(due))).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(partly, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


ORACLE = r"""
WITH sized AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('%d:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS lot FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1)::BIGINT AS src FROM sized GROUP BY source
), weighed AS (SELECT *, [3.0, 1.0, 2.0][(src %% 3)::INT + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM src),
leveled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), aims AS (
  SELECT source, src, source_size, round(CASE WHEN cap <= level * weight THEN cap ELSE least(cap, weight * max(CASE WHEN cap > level * weight THEN level END) OVER ()) END, 6) AS target FROM leveled
), queued AS (
  SELECT s.r, s.doc_id, s.size, a.src, a.source_size, a.target, greatest(%d, ceil(a.target / %d))::BIGINT AS width,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.lot, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS start
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
), sent AS (SELECT *, unnest(range(0, size, width)) AS first FROM queued),
entries AS (
  SELECT r, src, least(width, size - first) AS words, (turn * source_size + start + first + least(width, size - first))::BIGINT AS pos,
         (turn * source_size + start + first + least(width, size - first))::DOUBLE / target AS finish FROM sent, (SELECT unnest([0, 1]) AS turn)
), ordered AS (
  SELECT r, words, (SELECT floor(1.5::DOUBLE * sum(size))::BIGINT FROM sized) - sum(words) OVER (ORDER BY finish, src, pos ROWS UNBOUNDED PRECEDING) + words AS left_over FROM entries
), served AS (SELECT r, sum(least(words, left_over)) AS taken FROM ordered WHERE left_over > 0 GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM queued LEFT JOIN served USING (r)
""" % (SEED, LEAST_PACKET, PACKETS)
