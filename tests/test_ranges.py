"""State along a document in ranges, and lines of files in blocks, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import carry, lines
from corpusloom.sources.readers import read_lines


def plain(rows):
    """What carried() should give, by one loop a document: rows (doc, line_no, n, mark, value)."""
    out, state = {}, {}
    for doc, at, n, mark, value in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        total, last, old, since = state.get(doc, (0, None, None, 0))
        since = 0 if mark else since + n
        state[doc] = (total + n, value if value is not None else last, value, since)
        out[doc, at] = (total + n, value if value is not None else last, old, since)
    return out


@pytest.mark.parametrize("width", [1, 3, 7, 4096])
def test_carried_is_a_loop(spark, monkeypatch, width):
    monkeypatch.setattr(carry, "RANGE_LINES", width)
    rng = random.Random(width)
    rows = [(doc, at, rng.randint(0, 2), rng.random() < 0.1, rng.choice([None, None, "x", "y"])) for doc in (1, 2, None) for at in rng.sample(range(60), 40)]
    rows += [(4, 5, 1, False, None)]
    table = spark.createDataFrame(rows, "doc long, line_no long, n int, mark boolean, value string").repartition(3)
    got = carry.carried(table, sums={"total": F.col("n")}, lasts={"last": F.col("value")}, before={"old": F.col("value")}, since={"since": (F.when(F.col("mark"), 0).otherwise(F.col("n")), F.col("mark"))})
    assert got.columns == [*table.columns, "total", "last", "old", "since"]
    assert {(r["doc"], r["line_no"]): (r["total"], r["last"], r["old"], r["since"]) for r in got.collect()} == plain(rows)
    assert carry.carried(table.limit(0), sums={"total": F.col("n")}).count() == 0


def test_no_task_has_all_lines_of_a_document(spark, monkeypatch):
    """The rows of one document are dealt out by their ranges."""
    monkeypatch.setattr(carry, "RANGE_LINES", 100)
    table = spark.range(10_000).select(F.lit(1).alias("doc"), F.col("id").alias("line_no"), F.when(F.col("id") % 777 == 0, "Siman 1").otherwise("text").alias("line"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in lines.sections(table).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 4 and max(sizes) < 5000


@pytest.mark.parametrize("width", [2, 5, 4096])
def test_line_rules_do_not_depend_on_ranges(spark, monkeypatch, width):
    monkeypatch.setattr(carry, "RANGE_LINES", width)
    text = ["http://x", "Siman 1", "one", "", " ", "", "two", "</small>", "</small>", "three", "Siman 2", "Siman 3", "four", "five", "", "six"]
    table = spark.createDataFrame([(d, i, x) for d in (1, 2) for i, x in enumerate(text)], "doc long, line_no long, line string")
    own = lambda df, *c: [tuple(r) for r in df.where("doc = 1").select(*c).orderBy(*c).collect()]
    assert own(lines.sections(table), "line_no", "section_ord", "section", "para_no") == [(2, 1, "1", 1), (6, 1, "1", 2), (9, 1, "1", 3), (12, 3, "3", 1), (13, 3, "3", 2), (15, 3, "3", 3)]
    assert own(lines.collapse_blank_lines(table), "line_no") == [(i,) for i in range(16) if i not in (4, 5)]
    assert [r for r in own(lines.insert_separators(table), "line_no", "part") if r[1] == 0] == [(7, 0), (8, 0), (9, 0), (13, 0)]
    assert (6, "two</small></small>") in own(lines.merge_orphan_tags(table), "line_no", "line")
    fixed = own(lines.basic_fixes(table), "line_no", "line")
    assert [i for i, _ in fixed] == list(range(len(fixed)))


@pytest.mark.parametrize("step", [2, 5, 1 << 20])
def test_lines_in_blocks_are_those_of_the_whole_file(spark, tmp_path, monkeypatch, step):
    """Every end of line lies at the edge of a block with one of the steps, CR and LF apart too."""
    texts = {"a.txt": "one\r\ntwo\r\n\r\n\nthree\rfour\r\r\n", "b.txt": "é😀\nx", "c.txt": "\n\n", "d.txt": "", "e.txt": "\r\n" * 9 + "end"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(step))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for sent in (200_000, 0):  # with 0, lines and blocks are joined by a shuffle
            monkeypatch.setattr("corpusloom.sources.readers.BLOCKS_SENT", sent)
            rows = read_lines(spark, str(tmp_path)).collect()
            got = {n: [r["line"] for r in sorted((r for r in rows if r["doc"].endswith(n)), key=lambda r: r["line_no"])] for n in texts}
            numbers = {n: sorted(r["line_no"] for r in rows if r["doc"].endswith(n)) for n in texts}
            for name, text in texts.items():
                want = re.split("\r\n|\r|\n", text)
                want = want[:-1] if want[-1] == "" else want
                assert got[name] == want and numbers[name] == list(range(len(want)))
        if step == 2:
            monkeypatch.setattr("corpusloom.sources.readers.BLOCKS_SENT", 200_000)
            assert read_lines(spark, str(tmp_path / "a.txt")).select(F.spark_partition_id()).distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
