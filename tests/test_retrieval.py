"""Search, scores, chat, sources, runner, stream."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import vectors
from corpusloom.operators import chat, evaluation, retrieval
from corpusloom.operators.encoding import HashingEncoder, PrecomputedEncoder
from corpusloom.plans import pipeline
from corpusloom.sources import config, readers, writers
from corpusloom.streaming.chat import start_history


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_search_is_exact(spark):
    rng = np.random.default_rng(0)
    corpus = rng.integers(-2, 3, (300, 4)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(corpus)]
    unit = table(spark, rows, "chunk_id long, vector array<double>").select("chunk_id", vectors.normalized(F.col("vector")).alias("vector"))
    asked = unit.where("chunk_id < 20").withColumnRenamed("chunk_id", "q_id")
    for k in (1, 7, 400):
        got = {(r["q_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in retrieval.search(asked, unit, k, skip_same=True).collect()}
        held = {r["chunk_id"]: np.array(r["vector"]) for r in unit.collect()}
        for q in range(20):
            order = sorted((c for c in held if c != q), key=lambda c: (-(held[q] @ held[c]), c))[:k]
            assert all(abs(got[q, i + 1][1] - held[q] @ held[c]) < 1e-9 for i, c in enumerate(order))
        assert len(got) == 20 * min(k, 299)
    assert retrieval.search(asked, unit, 0).count() == 0
    assert retrieval.search(asked.limit(0), unit, 5).count() == 0


def test_queries_in_blocks(spark, monkeypatch):
    unit = table(spark, [(i, [1.0, float(i)]) for i in range(30)], "chunk_id long, vector array<double>")
    asked = unit.withColumnRenamed("chunk_id", "q_id")
    whole = {tuple(r) for r in retrieval.search(asked, unit, 3).collect()}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    assert {tuple(r) for r in retrieval.search(asked, unit, 3).collect()} == whole


def test_zero_vector(spark):
    row = table(spark, [([0.0, 0.0], [3.0, 4.0])], "a array<double>, b array<double>").select(vectors.normalized(F.col("a")), vectors.normalized(F.col("b")), vectors.dot(F.col("a"), F.col("b")), vectors.norm(F.col("b"))).first()
    assert list(row) == [[0.0, 0.0], [0.6, 0.8], 0.0, 5.0]


def test_metrics(spark):
    hits = table(spark, [(1, 1, 5), (1, 2, 5), (1, 3, 7), (2, 1, 9), (3, 1, 7)], "q_id long, rank int, section int")
    truth = table(spark, [(1, 7), (2, 8), (3, 7), (4, 1)], "q_id long, section int")
    unique = {r["q_id"]: r["gt_rank"] for r in evaluation.ground_truth_ranks(hits, truth).collect()}
    assert unique == {1: 2, 2: None, 3: 1, 4: None}
    chunks = {r["q_id"]: r["gt_rank"] for r in evaluation.ground_truth_ranks(hits, truth, unique=False).collect()}
    assert chunks == {1: 3, 2: None, 3: 1, 4: None}
    finer = evaluation.ground_truth_ranks(hits.withColumn("paragraph", F.col("rank")), truth.withColumn("paragraph", F.lit(1)), unique=False, by=("section", "paragraph"))
    assert {r["q_id"]: r["gt_rank"] for r in finer.collect()} == {1: None, 2: None, 3: 1, 4: None}
    ranks = evaluation.ground_truth_ranks(hits, truth)
    assert {r["k"]: (r["hits"], r["recall"]) for r in evaluation.recall_at(ranks, [1, 2, 2]).collect()} == {1: (1, 0.25), 2: (2, 0.5)}
    assert tuple(evaluation.mrr(ranks).first()) == (4, 0.375)
    assert evaluation.target_gate(ranks, 2, 0.5).first()["passed"] is True
    assert {r["section"]: r["missed"] for r in evaluation.failures(ranks, truth, 1).collect()} == {7: 1, 8: 1, 1: 1}
    none = ranks.limit(0)
    assert [r["recall"] for r in evaluation.recall_at(none, [1]).collect()] == [0.0] and evaluation.mrr(none).first()["mrr"] == 0.0
    assert evaluation.k_list([5, 1, 5], 3) == ([1, 5], 5) and evaluation.k_list()[1] == 50


def test_registries():
    with pytest.raises(ValueError, match="vector"):
        retrieval.get_retriever("none")
    with pytest.raises(ValueError, match="retrieval"):
        evaluation.get_evaluator("none")


def test_chat(spark):
    rows = [(1, i, "user" if i % 2 else "tool", f" m{i} ") for i in range(15)] + [(2, 0, "user", "  "), (2, 1, "assistant", None), (3, 0, "user", "x" * 5000), (4, 0, None, "a")]
    turns = table(spark, rows, "conv_id long, turn long, role string, text string")
    got = chat.clean_history(turns).orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["turn"]) for r in got] == [(1, 3), (1, 5), (1, 7), (1, 9), (1, 11), (1, 13), (3, 0)]
    assert len(got[-1]["text"]) == 4000 and got[0]["text"] == "m3"
    payload = table(spark, [([("user", " a "), ("system", "b"), ("assistant", ""), ("user", None)],)], "m array<struct<role:string,content:string>>")
    assert [tuple(x) for x in payload.select(chat.clean_messages(F.col("m")).alias("x")).first()["x"]] == [("user", "a")]


def test_stream_counts_a_turn_once(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    for part in ([(1, 0, "user", "a"), (2, 0, "user", "z")], [(1, 1, "assistant", " b ")]):
        table(spark, part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        start_history(source, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(60)
    last = spark.read.parquet(str(tmp_path / "out/clean/batch=1")).orderBy("turn").collect()
    assert [(r["conv_id"], r["text"]) for r in last] == [(1, "a"), (1, "b")]


def test_sources(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('#,שאלה,תשובה,סימן,סעיף\n1,"מה, ""כן""?",ת,4,2\n', encoding="utf-8")
    row = readers.read_queries(spark, str(path)).first()
    assert (row["q_id"], row["question"], row["section"], row["paragraph"]) == (1, 'מה, "כן"?', 4, 2)
    path.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="missing"):
        readers.read_chunks(spark, str(path))
    (tmp_path / "l.txt").write_bytes("x\r\ny\n".encode())
    assert [r["line"] for r in readers.read_lines(spark, str(tmp_path / "l.txt")).orderBy("line_no").collect()] == ["x", "y"]
    (tmp_path / "c.json").write_text(json.dumps({"title": "t", "source": "s", "simanim": [{"siman": 1, "seifim": [{"seif": 1, "text": "a", "hagah": None, "text_raw": "r"}]}]}))
    row = readers.read_corpus(spark, str(tmp_path / "c.json")).first()
    assert (row["section"], row["paragraph"], row["text"], row["gloss"]) == (1, 1, "a", None)
    np.save(tmp_path / "v.npy", np.eye(2, dtype=np.float32))
    held = readers.read_matrix(spark, str(tmp_path / "v.npy"))
    readers.check_same_rows(held.select("chunk_id"), held)
    with pytest.raises(RuntimeError):
        readers.check_same_rows(held.limit(1), held)
    rows = table(spark, [(1, 1, "a", None, "r")], "section int, para_no int, text string, gloss string, text_raw string")
    writers.write_corpus(rows, str(tmp_path / "out"), "t", "s")
    assert json.loads(next((tmp_path / "out").glob("*.json")).read_text())["simanim"][0]["seifim"][0]["hagah"] is None


def test_config(tmp_path):
    c = config.Config.of({"k_values": [1, 2], "paths": {"mini": {"chunks": "a"}}})
    assert c.k_values == (1, 2) and config.resolve_paths(c, "mini") == {"chunks": "a"}
    with pytest.raises(ValueError):
        config.resolve_paths(c, "full")
    assert config.resolve_paths(config.Config(paths={"chunks": "x"}), "any") == {"chunks": "x"}
    assert [config.limit_of(*x) for x in ((5, 9), (None, "7"), ("all", 9), (None, None), (-1, 3))] == [5, 7, None, None, None]
    assert str(config.resolve_path("a.txt", "/base")) == "/base/a.txt" and str(config.resolve_path("d/a.txt", "/base", True)) == "d/a.txt"


def test_experiment_builds_what_is_missing(spark, tmp_path):
    rows = [(s, 1, " ".join(f"w{s}x{i}" for i in range(20)), None) for s in range(1, 9)]
    table(spark, rows, "section int, para_no int, text string, gloss string").write.parquet(str(tmp_path / "corpus"))
    (tmp_path / "q.csv").write_text("#,question,siman,seif\n" + "".join(f"{s},w{s}x3 w{s}x7 w{s}x9,{s},1\n" for s in range(1, 9)))
    paths = {k: str(tmp_path / k) for k in ("corpus", "chunks", "vectors")} | {"questions": str(tmp_path / "q.csv"), "results": str(tmp_path / "r/result")}
    c = config.Config(paths=paths, retrieve_k=5, k_values=(1, 3), target_k=3)
    result, report = pipeline.run_experiment(spark, c, "any")
    assert result["metrics"]["recall_rate"]["3"] > 0.7 and result["n_questions"] == 8 and "MRR" in report
    before = (tmp_path / "chunks/_SUCCESS").stat().st_mtime_ns
    assert pipeline.run_experiment(spark, c, "any", max_questions=2)[0]["n_questions"] == 2
    assert (tmp_path / "chunks/_SUCCESS").stat().st_mtime_ns == before
    with pytest.raises(FileNotFoundError):
        pipeline.ensure(spark, str(tmp_path / "no"), [str(tmp_path / "nothing")], lambda: None)


def test_rich_fields_have_defaults(spark):
    chunks = table(spark, [(0, 1, 1, "a b"), (1, 2, 1, "c d")], "chunk_id long, section int, paragraph int, text string")
    encoder = HashingEncoder(32)
    found = retrieval.get_retriever("rich", chunks, encoder.encode(chunks, "chunk_id", "text"), encoder, prefix="").retrieve_one("c d", spark, 1).first()
    assert (found["chunk_id"], found["summary"], found["questions"]) == (1, "", [])
    held = table(spark, [(7, [1.0])], "id long, v array<double>")
    assert PrecomputedEncoder(held, "id", "v").encode(table(spark, [(7, "x")], "q_id long, t string"), "q_id", "t").first()["vector"] == [1.0]


def test_search_in_small_parts_with_ties(spark, monkeypatch):
    """Few rows are scored at once, in several blocks; equal scores go to the smaller chunk."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 5)
    monkeypatch.setattr(retrieval, "CORPUS_ROWS", 3)
    vector = {i: [(1.0, 0.0), (0.0, 1.0), (0.6, 0.8)][i % 3] for i in range(40)}
    corpus = table(spark, [(i, list(v)) for i, v in vector.items()] + [(99, None)], "chunk_id long, vector array<double>").coalesce(2)
    asked = corpus.where("chunk_id < 17").withColumnRenamed("chunk_id", "q_id")
    for k in (1, 4, 60):
        got = sorted((r["q_id"], r["rank"], r["chunk_id"]) for r in retrieval.search(asked, corpus, k).collect())
        score = lambda q, c: round(sum(a * b for a, b in zip(vector[q], vector[c])), 9)
        assert got == [(q, i + 1, c) for q in range(17) for i, c in enumerate(sorted(vector, key=lambda c: (-score(q, c), c))[:k])]
