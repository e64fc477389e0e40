"""Lines, marks, chunks, nesting."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import markup
from corpusloom.functions import text as T
from corpusloom.operators import chunking, enrich
from corpusloom.operators import lines as L
from corpusloom.operators.prefix import running_sum
from corpusloom.plans.pipeline import build_corpus


def lines_of(spark, *texts):
    return L.explode_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))


def shown(df, *columns):
    return [tuple(r) for r in df.orderBy(*df.columns[:2]).select(*columns).collect()]


def one(spark, text, function):
    return spark.createDataFrame([(text,)], "a string").select(function(F.col("a")).alias("x")).first()["x"]


def test_newlines_of_all_kinds(spark):
    assert shown(lines_of(spark, "a\r\nb\rc\nd", ""), "doc", "line_no", "line") == [(0, 0, "a"), (0, 1, "b"), (0, 2, "c"), (0, 3, "d"), (1, 0, "")]


def test_sections_by_place(spark):
    text = "lost\nSiman 1\na\n\n<small></small>\nShulchan x\nb\nSiman 1\nc"
    assert sorted(shown(L.sections(lines_of(spark, text)).drop("doc"), "section_ord", "section", "para_no", "line")) == [(1, "1", 1, "a"), (1, "1", 2, "b"), (2, "1", 1, "c")]
    assert L.sections(lines_of(spark, "no marker\nat all")).count() == 0


def test_blank_runs_and_separators(spark):
    assert [x for (x,) in shown(L.collapse_blank_lines(lines_of(spark, "\n \na\n\n\nb")), "line")] == ["", "a", "", "b"]
    got = L.insert_separators(lines_of(spark, "x\ny\nSiman 1\na\nb\n\nc")).orderBy("line_no", "part").collect()
    assert [r["line"] for r in got] == ["x", "y", "Siman 1", "a", "", "b", "", "c"]


def test_orphan_tags(spark):
    lines = lines_of(spark, "</small>\na\n </small> \nb")
    assert [x for (x,) in shown(L.merge_orphan_tags(lines), "line")] == ["</small>", "a</small>", "b"]
    assert [x for (x,) in shown(L.merge_orphan_tags(lines, keep_leading=False), "line")] == ["a</small>", "b"]


def test_balance(spark):
    assert tuple(L.tag_balance(lines_of(spark, "<small>a</small>\n<small>")).first()) == (2, 1, False)


def test_gloss(spark):
    text = 'טקסט מחבר <small> הגה: דברי רמ"א חלק א </small> <small> הגה: דברי רמ"א חלק ב </small>'
    got = one(spark, text, markup.split_gloss)
    assert got["gloss"] == 'דברי רמ"א חלק א דברי רמ"א חלק ב' and got["text"] == "טקסט מחבר"
    got = one(spark, "א <small>הגה: ב <small>ציטוט</small> ג</small> ד <small>הערה</small>", markup.split_gloss)
    assert (got["text"], got["gloss"]) == ("א ד", "ב ג")
    assert tuple(one(spark, "", markup.split_gloss)) == (None, None)


def test_citations(spark):
    keep = {"פי' טוב": False, "(פי' כך)": False, "": True, ".": True, "(ב)": True, "מלים": False}
    for text, want in keep.items():
        assert one(spark, text, markup.is_citation) is want, text
    line = "א <small>ב <small>(ג)</small> ד <small>ה</small></small> <small>(ו)</small>"
    got = one(spark, line, markup.nested_citations)
    assert got["line"] == "א <small>ב ד <small>ה</small></small> <small>(ו)</small>"
    assert [tuple(x) for x in got["audit"]] == [("DROP", 2, "(ג)"), ("KEEP", 2, "ה")]
    assert one(spark, "א</small><small>ב<small>ג", markup.drop_nested_citations) == "א<small>ב<small>ג</small></small>"
    deep = one(spark, "<small>א<small>ב<small>(ג)</small></small></small>", markup.nested_citations)
    assert deep["line"] == "<small>א<small>ב</small></small>" and [x["depth"] for x in deep["audit"]] == [3, 2]


def settled(line):
    """Line and audit by recursion over the tree of a line's blocks."""
    root = []
    stack = [root]
    for t in re.split("(<small>|</small>)", line):
        if t == "<small>":
            stack[-1].append(block := [])
            stack.append(block)
        elif t == "</small>":
            if len(stack) > 1:
                stack.pop()
        else:
            stack[-1].append(t)
    audit = []

    def citation(s):
        if not s:
            return True
        if re.match(r"\(\s*(פי'|פירוש)\s*", s):
            return False
        return bool(len(s) <= 2 and not re.search("[א-ת]", s) or re.search("[()]", s))

    def rendered(node, depth):
        out = ""
        for x in node:
            if isinstance(x, str):
                out += x
                continue
            inner = rendered(x, depth + 1)
            content = " ".join(re.sub("</?small>", "", inner).split())
            if depth >= 2:
                audit.append(("DROP" if citation(content) else "KEEP", depth, content))
                if audit[-1][0] == "DROP":
                    continue
            out += f"<small>{inner}</small>"
        return out

    return re.sub("  +", " ", rendered(root, 1)), audit


def test_citations_at_any_depth(spark):
    rng = random.Random(5)
    pieces = ["<small>"] * 5 + ["</small>"] * 4 + ["א ", "מלים  ", "(ב)", " ", ".", "(פי' כך", "abc"]
    drawn = ["".join(rng.choices(pieces, k=rng.randint(1, 200))) for _ in range(60)]
    nests = [f"{'<small>א' * n}<small>(ב){'</small>' * (n + 1)}" for n in (1, 6, 7, 8, 51, 200)]
    nests += [f"{'<small>א' * 20}<small>(ב)</small>{'<small>' * 9}(ג)", "x<small>" * 12 + "</small>" * 20 + "y", "a\ue001b<small>\ue003<small>c\ue002</small></small>"]
    lines = [*drawn, *nests]
    table = spark.createDataFrame(list(enumerate(lines)), "i int, a string")
    rows = table.select("i", markup.nested_citations(F.col("a")).alias("x")).orderBy("i").collect()
    for line, r in zip(lines, rows, strict=True):
        assert (r["x"]["line"], [tuple(b) for b in r["x"]["audit"]]) == settled(line), line
    assert max(depth for r in rows for _, depth, _ in r["x"]["audit"]) == 201


def test_only_glosses_stay(spark):
    line = "א <small>הערה</small> <small>הגה: ב</small><small>עוד</small> ג <small>סוף</small>"
    got = one(spark, line, markup.keep_glosses)
    assert (got["line"], got["dropped"]) == ("א <small>הגה: ב</small><small>עוד</small> ג ", 2)


def test_parentheses_are_closed_in_depth(spark):
    assert one(spark, "(א <small>ב <small>(ג </small></small>", markup.close_parentheses) == "(א <small>ב <small>(ג)</small></small>"
    assert one(spark, "(א <small>(ב</small>", markup.close_parentheses) == "(א <small>(ב</small>"


def test_cleanup(spark):
    assert one(spark, " א <small> .. </small> ,, ב  . ", T.final_cleanup) == "א, ב."
    assert one(spark, "a  b\x1cc", T.normalize_whitespace) == "a b c"
    assert one(spark, None, T.words) == [] and one(spark, "  a b ", T.word_count) == 2


def test_build_corpus(spark):
    raw = lines_of(spark, "Shulchan\nSiman 1\nחָכְמָה <small>הגה: דף י\"ב</small>\nשֵׁנִי\nSiman 2\nג\n</small>")
    rows = {(r["section"], r["para_no"]): (r["text"], r["gloss"]) for r in build_corpus(raw).collect()}
    assert rows == {(1, 1): ("חוכמה", "דף שנים עשר"), (1, 2): ("שני", None), (2, 1): ("ג", None)}


@pytest.fixture(scope="module")
def paragraphs(spark):
    rows = [(1, 1, "a b c", "g"), (1, 2, None, None), (2, 1, "d e", ""), (3, 1, "", None), (4, 1, "f g h i j k l", None)]
    return spark.createDataFrame(rows, "section long, para_no long, text string, gloss string")


def test_paragraph_and_section_chunks(paragraphs):
    assert {r["label"]: r["text"] for r in chunking.paragraph_chunks(paragraphs).collect()}["סימן 1, סעיף 2"] == ""
    assert {r["section"]: r["text"] for r in chunking.section_chunks(paragraphs).collect()} == {1: "a b c g", 2: "d e", 3: "", 4: "f g h i j k l"}
    with pytest.raises(ValueError, match="unknown mode"):
        chunking.chunk(paragraphs, "other")


@pytest.mark.parametrize(("size", "overlap"), [(5, 2), (4, 0), (3, 2), (100, 50)])
def test_sliding_windows(paragraphs, size, overlap):
    words, owner = "a b c d e f g h i j k l".split(), [1] * 3 + [2] * 2 + [4] * 7
    want = [(k, owner[a], " ".join(words[a : a + size])) for k, a in enumerate(range(0, len(words), size - overlap))]
    got = chunking.sliding_chunks(paragraphs, size=size, overlap=overlap).orderBy("window").select("window", "section", "text").collect()
    assert [tuple(r) for r in got] == want
    with pytest.raises(ValueError):
        chunking.sliding_chunks(paragraphs, size=3, overlap=3)


def test_windows_of_nothing(spark, paragraphs):
    assert chunking.sliding_chunks(paragraphs.where("section = 3")).count() == 0
    assert chunking.section_windows(paragraphs.limit(0)).count() == 0


def test_running_sum_is_in_order(spark):
    rows = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), F.lit(1).alias("v"))
    got = running_sum(rows, "k", "v", "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(5000))


def test_running_sum_of_a_hot_key_with_nulls(spark):
    rows = [(None if k % 7 == 0 else 1 + k % 3 // 2, k, k % 5) for k in range(3000)]
    got = running_sum(spark.createDataFrame(rows, "k long, t long, v long"), "k", "v", "n", "t").collect()
    want, total = {}, 0
    for k, t, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want[t] = total
        total += v
    assert {r["t"]: r["n"] for r in got} == want
    assert running_sum(spark.createDataFrame([], "k long, v long"), "k", "v", "n").count() == 0


def test_nesting_and_alignment(paragraphs):
    full = paragraphs.withColumn("text_raw", F.lit("r"))
    back = enrich.unnest(enrich.nest(full)).select("section", F.col("para_no").cast("long"), "text", "gloss")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, paragraphs.collect()), key=str)
    with pytest.raises(RuntimeError):
        enrich.check_aligned(paragraphs, paragraphs.where("section < 3"), ("section", "para_no"))
    enrich.check_aligned(paragraphs, paragraphs, ("section", "para_no"))
    assert tuple(enrich.coverage(paragraphs, F.col("text"), F.col("gloss")).first()) == (4, 5, 1, 0.2, 2)


def test_build_keeps_raw_lines_and_counts(spark):
    from corpusloom.plans.pipeline import build_statistics
    from corpusloom.sources import readers, writers

    text = ["Siman 1", "a  b <small>c <small>(d </small></small>", "שלום הקב\"ה <small>הגה: דבר", "</small>", "שורה  אחרת", "Siman 2", "תרנגול"]
    raw = spark.createDataFrame([("f", i, line) for i, line in enumerate(text)], "doc string, line_no long, line string")
    built = build_corpus(raw)
    rows = {(r["section"], r["para_no"]): r for r in built.collect()}
    assert rows[1, 1]["text_raw"] == text[1] and rows[1, 2]["text_raw"] == text[2] + "</small>" and rows[1, 2]["text"] == "שלום אלוהים"
    assert set(rows) == {(1, 1), (1, 2), (1, 3), (2, 1)}
    told = {(r["stage"], r["name"]): r["n"] for r in build_statistics(raw).collect()}
    assert told["fixes", "orphans"] == 1 and told["fixes", "parentheses"] == 1 and told["fixes", "sections"] == 2 and told["terms", 'stem הקב"ה'] == 1 and told["fixes", "opens"] == told["fixes", "closes"] == 3


def test_build_tells_what_cleaning_loses(spark):
    raw = spark.createDataFrame([("f", 0, "Siman 1"), ("f", 1, "<small>עיין שם דבר</small>"), ("f", 2, "שלום")], "doc string, line_no long, line string")
    with pytest.raises(RuntimeError, match="differ"):
        build_corpus(raw)


def test_chunks_are_numbered_by_paragraph(spark):
    from corpusloom.operators.chunking import build_chunks

    rows = spark.createDataFrame([(s, p, f"w{s} w{p}", "") for s in (1, 2, 10) for p in range(1, 13)], "section long, para_no long, text string, gloss string")
    got = [(r["section"], r["paragraph"]) for r in build_chunks(rows, "paragraph").orderBy("chunk_id").collect()]
    assert got == [(s, p) for s in (1, 2, 10) for p in range(1, 13)]
    windows = build_chunks(rows, "sliding", size=10, overlap=5).orderBy("chunk_id").collect()
    assert [r["window"] for r in windows] == list(range(len(windows))) == [r["chunk_id"] for r in windows]


def test_corpus_round_trip(spark, tmp_path):
    from corpusloom.sources import readers, writers

    rows = [(1, 1, "a", "g", "raw a", "grp", "t"), (1, 2, None, None, "raw", "grp", "t"), (2, 1, "b", None, "raw b", "", "")]
    table = spark.createDataFrame(rows, "section int, para_no int, text string, gloss string, text_raw string, group string, title string")
    writers.write_corpus(table, str(tmp_path / "corpus"), "T", "S")
    back = readers.read_corpus(spark, str(tmp_path / "corpus"), lines=True)
    assert sorted(tuple(r) for r in back.select("section", "paragraph", F.coalesce("text", F.lit("-")), F.coalesce("gloss", F.lit("-")), "text_raw", "group", "title_of_section").collect()) == sorted((s, p, t or "-", g or "-", r, gr, ti) for s, p, t, g, r, gr, ti in rows)
    assert {(r["title"], r["source"]) for r in back.collect()} == {("T", "S")}


def test_commands(spark, tmp_path):
    from corpusloom.plans import pipeline

    (tmp_path / "lines.txt").write_text("Siman 1\n" + "\n".join(f"שורה {'א' * (k + 1)}" for k in range(11)) + "\nSiman 2\nעוד שורה\n", encoding="utf-8")
    (tmp_path / "headings.txt").write_text("הלכות ציצית\nסימן 1 - ענין. ובו ב' סעיפים:\n", encoding="utf-8")
    at = lambda name: str(tmp_path / name)
    assert pipeline.main(["build", at("lines.txt"), at("headings.txt"), at("corpus")]) == 0
    assert pipeline.main(["breadcrumb", at("corpus"), at("headings.txt"), at("crumbs")]) == 0
    assert pipeline.main(["chunk", at("corpus"), at("chunks")]) == 0
    assert pipeline.main(["embed", at("chunks"), at("vectors"), "--collection", "chunk_vectors"]) == 0
    crumbs = {r["section"]: r["breadcrumb"] for r in spark.read.parquet(at("crumbs")).collect()}
    assert crumbs == {1: "[הלכות ציצית > ענין]", 2: "[אורח חיים]"}
    ids = {r["chunk_id"]: (r["section"], r["paragraph"]) for r in spark.read.parquet(at("chunks")).collect()}
    assert ids == {**{k: (1, k + 1) for k in range(11)}, 11: (2, 1)} and spark.table("chunk_vectors").count() == 12


def test_listings_and_saved_results(spark, tmp_path):
    from corpusloom.operators import evaluation, retrieval

    assert retrieval.list_retrievers() == ["vector", "rich"] and evaluation.list_evaluators() == ["retrieval", "answers"]
    with pytest.warns(UserWarning, match="k_valuse"):
        evaluation.get_evaluator("retrieval", k_valuse=[1])
    for name, score in (("one", 0.2), ("two", 0.7)):
        (tmp_path / f"{name}.json").write_text('{"metrics": {"mrr": %s, "n_total": 3, "recall_rate": {"1": 0.5}}}' % score)
    assert [(r["place"], r["name"]) for r in evaluation.compare_saved(spark, str(tmp_path)).orderBy("place").collect()] == [(1, "two"), (2, "one")]


def test_citations_fold_no_tokens_in_the_plan(spark):
    df = spark.createDataFrame([("א<small>ב<small>(ג)</small></small>",), (None,)], "a string")
    df = df.select(markup.nested_citations(F.col("a")).alias("x"), markup.keep_glosses(F.col("a")).alias("y"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    got = [(r["x"]["line"], len(r["x"]["audit"]), r["y"]["line"], r["y"]["dropped"]) for r in df.collect()]
    assert "lambda" not in plan and got == [("א<small>ב</small>", 1, "א", 1), ("", 0, "", 0)]


def test_sliding_windows_move_no_arrays_of_words(spark, monkeypatch):
    moved = []
    monkeypatch.setattr(chunking, "running_sum", lambda rows, *how: moved.append(rows.dtypes) or running_sum(rows, *how))
    rows = spark.createDataFrame([(1, 1, "a b  c"), (1, 2, None), (2, 1, "d e")], "section long, para_no long, text string")
    got = {r["window"]: r["text"] for r in chunking.sliding_chunks(rows, size=4, overlap=1).collect()}
    assert got == {0: "a b c d", 1: "d e"} and not [t for _, t in moved[0] if t.startswith("array")]
