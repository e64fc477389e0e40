"""The cache by content: what is given out, what is stored, and an experiment that encodes changed paragraphs only."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.cache import CachedEncoder, ContentCache
from corpusloom.operators.encoding import HashingEncoder
from corpusloom.plans.pipeline import run_experiment, with_enrichment
from corpusloom.sources.config import Config


def shout(missing):
    return missing.where("text <> 'refused'").select("digest", F.upper("text").alias("output"))


def test_only_new_texts_are_made(spark, tmp_path):
    table = lambda texts: spark.createDataFrame(list(enumerate(texts)), "id long, said string").repartition(3)
    cache = ContentCache(spark, str(tmp_path / "cache"), "v1")
    texts = ["a", "b", "a", None, "", "refused"] + ["hot"] * 3000
    for again in range(2):
        rows = {r["id"]: r for r in cache.filled(table(texts), F.col("said"), "out", shout).collect()}
        assert len(rows) == len(texts) and [rows[i]["out"] for i in range(7)] == ["A", "B", "A", "", "", None, "HOT"]
        assert cache.made == (1 if again else 5)  # what is refused is given out again
    cache.filled(table(["a", "b", "c"]), F.col("said"), "out", shout)
    assert cache.made == 1 and cache.stored().count() == 5
    other = ContentCache(spark, str(tmp_path / "cache"), "v2")
    assert other.filled(table(["a"]), F.col("said"), "out", lambda m: m.select("digest", F.lit("new").alias("output"))).first()["out"] == "new" and other.made == 1
    assert cache.filled(table(["a"]), F.col("said"), "out", shout).first()["out"] == "A" and cache.made == 0
    assert cache.filled(table([]), F.col("said"), "out", shout).count() == 0

    def fails(missing):
        return missing.select("digest", F.raise_error(F.lit("no model")).cast("string").alias("output"))

    with pytest.raises(Exception, match="no model"):
        cache.filled(table(["d"]), F.col("said"), "out", fails)
    assert cache.filled(table(["d"]), F.col("said"), "out", shout).first()["out"] == "D"


def test_encoder_with_a_cache_gives_the_same_vectors(spark, tmp_path):
    texts = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None)], "id long, said string")
    plain = HashingEncoder(16)
    cached = CachedEncoder(plain, ContentCache(spark, str(tmp_path / "v"), plain.version(), "array<double>"))
    for _ in range(2):
        assert {r["id"]: r["vector"] for r in cached.encode(texts, "id", "said", "passage: ").collect()} == {r["id"]: r["vector"] for r in plain.encode(texts, "id", "said", "passage: ").collect()}
    assert cached.cache.made == 0 and HashingEncoder(8).version() != plain.version()


def test_one_changed_paragraph_is_encoded_alone(spark, tmp_path, monkeypatch):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "q.csv").write_text("q_id,question,section,paragraph\n1,alpha beta,1,1\n2,gamma delta,2,1\n", encoding="utf-8")
    config = Config.of({"paths": {"m": {"corpus": at("corpus"), "chunks": at("chunks"), "vectors": at("vectors"), "questions": at("q.csv"), "cache": at("cache")}}, "retrieve_k": 2, "k_values": [1, 2], "target_k": 2})
    made = []
    filled = ContentCache.filled
    monkeypatch.setattr(ContentCache, "filled", lambda self, *a: (filled(self, *a), made.append(self.made))[0])

    def run(second):
        rows = [(1, 1, "alpha beta", None, "x"), (1, 2, "epsilon", None, "x"), (2, 1, second, None, "x")]
        spark.createDataFrame(rows, "section long, para_no long, text string, gloss string, text_raw string").write.mode("overwrite").parquet(at("corpus"))
        made.clear()
        return run_experiment(spark, config, "m", force=True)[0]["metrics"]["mrr"]

    assert run("gamma delta") == 1.0 and made == [3, 2]
    assert run("gamma delta!") == 1.0 and made == [1, 0]
    assert run("gamma delta!") == 1.0 and made == [0, 0]


def test_fields_of_an_enrichment(spark):
    chunks = spark.createDataFrame([(1, "body", "short", ["why?", "how?"]), (2, "body", None, None)], "chunk_id long, text string, summary string, questions array<string>")
    rows = with_enrichment(chunks, ("summary", "questions", "absent"), " | ").orderBy("chunk_id").collect()
    assert [r["text"] for r in rows] == ["short | why? how? | body", "body"]
    assert with_enrichment(chunks, ("absent",)).columns == chunks.columns and Config.of({"enrich_fields": ["summary"]}).enrich_fields == ("summary",)
