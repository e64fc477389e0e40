"""Running sums in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.scratch import written

#: Rows of a slot, about, and the fewest and most slots; the table of their totals is broadcast.
SLOT_ROWS = 200_000
MIN_SLOTS = 16
MAX_SLOTS = 10_000


def running_sum(rows: DataFrame, key: str, value: str, out: str, *ties: str) -> DataFrame:
    """rows with out: the sum of value over the rows before, in the order of key and then ties, nulls first.

    Rows are written once, then cut into ranges of (key, ties), more of them the more rows there are, so that ties split a
    hot key. Ranges are written with their number, so a task that is run again meets the same ones. Each is summed alone,
    and offset by the sums of those before it, a table of MAX_SLOTS rows at most.
    """
    source = written(rows, "unordered")
    n_slots = min(max(source.count() // SLOT_ROWS, MIN_SLOTS), MAX_SLOTS)
    slotted = written(source.repartitionByRange(n_slots, key, *ties).withColumn("_slot", F.spark_partition_id()), "ordered")
    totals = slotted.groupBy("_slot").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = totals.select(F.col("_slot").alias("_of"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_slot").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    summed = slotted.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    met = summed.join(F.broadcast(offset), F.col("_slot") == F.col("_of"))  # MAX_SLOTS rows at most
    return met.withColumn(out, (F.col("_offset") + F.col("_within")).cast("long")).drop("_slot", "_of", "_offset", "_within")
