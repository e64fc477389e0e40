"""State that runs along the rows of a document, without one task that sees the whole document.

A document's rows are cut into ranges of their order. Each range is scanned alone, and its last row says what it leaves behind; a
table of one row for each range is scanned in order, and hands every range what lies before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a range. The ranges of one document are ordered in one task: a thousandth of a per cent of a long one's lines.
RANGE_LINES = 4096


def carried(
    rows: DataFrame,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    since: dict[str, tuple[Column, Column]] | None = None,
    by: str = "doc",
    order: tuple[str, ...] = ("line_no",),
    range_of: Column | None = None,
) -> DataFrame:
    """rows with one more column for each name, over the rows of its document (by, which may be null) in order.

    sums: the sum of a number up to and with the row. lasts: the latest value that is not null, up to and with the row.
    before: the value in the row before, null in the first. since: (number, reset) the sum, not negative, of the rows up to and with this
    one and after the latest row where reset holds, or after the beginning.
    range_of: the range of a row, not null, which must rise with order; ranges of RANGE_LINES by the first column of order else.
    rows are computed twice: once for what the ranges leave behind, of which only the numbers and marks are shuffled, and once for the result.
    """
    sums, lasts, before, since = (x or {} for x in (sums, lasts, before, since))
    ranged = F.floor(F.col(order[0]) / F.lit(RANGE_LINES)) if range_of is None else range_of
    inputs = {f"_in_{k}": v for k, v in {**sums, **lasts, **before}.items()} | {f"_in_{k}": n for k, (n, _) in since.items()} | {f"_at_{k}": r for k, (_, r) in since.items()}
    marked = rows.withColumns({"_doc": F.struct(by), "_range": ranged, **inputs})
    part = Window.partitionBy("_doc", "_range").orderBy(*order)
    upto = part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {f"_own_{k}": F.sum(f"_in_{k}").over(upto) for k in (*sums, *since)} | {f"_own_{k}": F.last(f"_in_{k}", ignorenulls=True).over(upto) for k in lasts}
    local |= {f"_own_{k}": F.lag(f"_in_{k}").over(part) for k in before} | {"_first": F.row_number().over(part) == 1}
    scanned = marked.withColumns(local)
    if since:  # the sum at the latest reset: it only grows, so it is the largest so far
        scanned = scanned.withColumns({f"_reset_{k}": F.max(F.when(F.col(f"_at_{k}"), F.col(f"_own_{k}"))).over(upto) for k in since})
    left = [F.col(f"_own_{k}") for k in (*sums, *lasts, *since)] + [F.col(f"_in_{k}") for k in before] + [F.col(f"_reset_{k}") for k in since]
    behind = scanned.groupBy("_doc", "_range").agg(F.max_by(F.struct(*left), F.struct(*order)).alias("_left")).select("_doc", "_range", "_left.*")
    ranges = Window.partitionBy("_doc").orderBy("_range")
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    if since:
        behind = behind.withColumns({f"_turn_{k}": F.count(f"_reset_{k}").over(ranges.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for k in since})
        behind = behind.withColumns({f"_open_{k}": F.sum(F.col(f"_own_{k}") - F.coalesce(f"_reset_{k}", F.lit(0))).over(Window.partitionBy("_doc", f"_turn_{k}").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) for k in since})
    given = {k: F.coalesce(F.sum(f"_own_{k}").over(earlier), F.lit(0)) for k in sums} | {k: F.last(f"_own_{k}", ignorenulls=True).over(earlier) for k in lasts}
    given |= {k: F.lag(f"_in_{k}").over(ranges) for k in before} | {k: F.coalesce(F.lag(f"_open_{k}").over(ranges), F.lit(0)) for k in since}
    carry = behind.select(F.col("_doc").alias("_of"), F.col("_range").alias("_of_range"), *(v.alias(f"_given_{k}") for k, v in given.items()))
    met = scanned.join(carry, (F.col("_doc") == F.col("_of")) & (F.col("_range") == F.col("_of_range")))
    out = {k: F.col(f"_own_{k}") + F.col(f"_given_{k}") for k in sums} | {k: F.coalesce(f"_own_{k}", f"_given_{k}") for k in lasts}
    out |= {k: F.when(F.col("_first"), F.col(f"_given_{k}")).otherwise(F.col(f"_own_{k}")) for k in before}
    out |= {k: F.col(f"_own_{k}") - F.coalesce(f"_reset_{k}", F.lit(0)) + F.when(F.col(f"_reset_{k}").isNull(), F.col(f"_given_{k}")).otherwise(0) for k in since}
    kept = [c for c in rows.columns if c not in out]
    return met.select(*kept, *(v.alias(k) for k, v in out.items()))
