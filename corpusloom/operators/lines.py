"""Line algebra. Lines are rows (doc, line_no, line); order is always explicit, and windows stay within a range of one doc."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import markup
from corpusloom.functions.text import strip, tidy_line
from corpusloom.operators.carry import carried
from corpusloom.sources.scratch import written

NEWLINE = "\r\n|\r|\n"
# The lines that mark sections, and those that belong to a file's head.
SECTION = r"^Siman (\d+)$"
HEADER = "^(Shulchan|שולחן|Torat|http)"
SKIPPED = r"^(Siman \d+|Shulchan|שולחן|Torat|http)"


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line_no, line) of texts; line_no counts from 0."""
    return docs.select(F.col(key).alias("doc"), F.posexplode(F.split(F.col(text), NEWLINE)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def is_section(line: Column) -> Column:
    return strip(line).rlike(SECTION)


def is_header(line: Column) -> Column:
    return strip(line).rlike(HEADER)


def is_content(line: Column) -> Column:
    return (strip(line) != "") & ~is_section(line) & ~is_header(line)


def is_passed_through(line: Column) -> Column:
    """Blank, header and section lines, which rules for content leave alone."""
    return (strip(line) == "") | strip(line).rlike(SKIPPED)


def has_text(line: Column) -> Column:
    """Whether anything is left of a line without its small marks."""
    return strip(F.regexp_replace(line, "</?small>", "")) != ""


def forward_fill(rows: DataFrame, value: Column, out: str, **how) -> DataFrame:
    """rows with the latest value that is not null, up to each row; how: by, order and range_of of carried()."""
    return carried(rows, lasts={out: value}, **how)


def sections(lines: DataFrame, marker: Column | None = None, number: Column | None = None) -> DataFrame:
    """The content lines after the first section marker, with section_ord, section and para_no (from 1).

    Sections are told apart by their place, so a number that comes again begins another section. Headers and lines without
    text are left out.
    """
    line = F.col("line")
    marker = is_section(line) if marker is None else marker
    number = F.regexp_extract(strip(line), SECTION, 1) if number is None else number
    marked = lines.withColumn("marks", marker).withColumn("content", ~F.col("marks") & (strip(line) != "") & ~is_header(line) & has_text(line))
    filled = carried(marked, sums={"section_ord": F.col("marks").cast("long")}, lasts={"section": F.when(F.col("marks"), number)}, since={"para_no": (F.col("content").cast("long"), F.col("marks"))})
    return filled.where(F.col("content") & (F.col("section_ord") > 0)).select("doc", "section_ord", "section", "para_no", "line_no", "line")


def collapse_blank_lines(lines: DataFrame) -> DataFrame:
    """Of each run of blank lines the first stays."""
    marked = carried(lines.withColumn("blank", strip(F.col("line")) == ""), before={"after_blank": F.col("blank")})
    return marked.where(~(F.col("blank") & F.coalesce("after_blank", F.lit(False)))).drop("blank", "after_blank")


def insert_separators(lines: DataFrame, started: Column | None = None) -> DataFrame:
    """An empty line between content lines that follow each other, from the first section on; part tells it (0) from the line (1)."""
    begun = {"begun": F.when(is_section(F.col("line")) if started is None else started, F.lit(True))}
    marked = carried(lines.withColumn("content", is_content(F.col("line"))), before={"after": F.col("content")}, lasts=begun)
    both = F.when(F.col("begun") & F.col("content") & F.col("after"), F.array(F.lit(""), F.col("line"))).otherwise(F.array("line"))
    placed = marked.withColumn("both", both).select("doc", "line_no", F.size("both").alias("n"), F.posexplode("both").alias("k", "line"))
    return placed.select("doc", "line_no", (F.col("k") + 2 - F.col("n")).cast("long").alias("part"), "line")


def merge_lines(lines: DataFrame, continues: Column, keep_leading: bool = True) -> DataFrame:
    """Lines that continue the one before are appended to it. Leading ones have nothing before: kept as one line, or dropped."""
    grouped = carried(lines, sums={"head": (~continues).cast("long")})
    if not keep_leading:
        grouped = grouped.where("head > 0")
    merged = grouped.groupBy("doc", "head").agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("parts"))
    return merged.select("doc", "line_no", F.array_join(F.col("parts.line"), "").alias("line"))


def merge_orphan_tags(lines: DataFrame, keep_leading: bool = True) -> DataFrame:
    """A line that is only a closing tag belongs to the line before."""
    orphan = strip(F.col("line")) == markup.CLOSE
    return merge_lines(lines.withColumn("line", F.when(orphan, F.lit(markup.CLOSE)).otherwise(F.col("line"))), orphan, keep_leading)


def basic_fixes(lines: DataFrame) -> DataFrame:
    """Orphan tags, parentheses, white space and separators, in this order; line_no is renumbered. What two steps read is written."""
    merged = merge_orphan_tags(lines, keep_leading=False).withColumn("line", tidy_line(markup.close_parentheses(F.col("line"))))
    spread = written(insert_separators(written(merged, "merged")), "spread")
    placed = carried(spread, sums={"place": F.lit(1).cast("long")}, order=("line_no", "part"))
    return placed.select("doc", (F.col("place") - 1).alias("line_no"), "line")


def tag_balance(lines: DataFrame, opening: str = markup.OPEN, closing: str = markup.CLOSE, text: str = "line") -> DataFrame:
    """One row: opens, closes, balanced."""
    count = lambda tag: F.sum(F.regexp_count(F.col(text), F.lit(tag))).cast("long")
    return lines.agg(count(opening).alias("opens"), count(closing).alias("closes")).withColumn("balanced", F.col("opens") == F.col("closes"))


