"""The approximate index against exact search, and matrices read by parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval, vector_index
from corpusloom.plans.registry import QUERIES
from corpusloom.sources.readers import read_matrix


def table(spark, x, key="chunk_id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{key} long, vector array<double>")


def units(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def recall(found, exact):
    got, want = ({(r["q_id"], r["chunk_id"]) for r in df.collect()} for df in (found, exact))
    return len(got & want) / len(want)


@pytest.mark.parametrize("clusters", [20, 0])
def test_index_finds_what_exact_search_finds(spark, monkeypatch, clusters):
    """With clusters few lists are probed, without any nearly all; slices and blocks of a few rows each change nothing."""
    monkeypatch.setattr(vector_index, "SLICE_ROWS", 60)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24))
    if clusters:
        x = rng.normal(size=(clusters, 24))[rng.integers(0, clusters, 1500)] * 3 + x
    vectors = table(spark, units(x))
    queries = table(spark, units(x[::15]), "q_id").withColumn("q_id", F.col("q_id") * 15)
    index = vector_index.fit(vectors, sample=900)
    held = vector_index.stored(vectors, index)
    assert held.count() == held.select("chunk_id").distinct().count() == 1500
    found = vector_index.search(queries, vectors, held, index, 10, skip_same=True)
    exact = retrieval.search(queries, vectors, 10, skip_same=True)
    assert found.count() == 1000 and recall(found, exact) >= 0.95
    assert index.probes < len(index.centroids) / 2 if clusters else index.probes > len(index.centroids) / 2
    best = {(r["q_id"], r["chunk_id"]): r["score"] for r in exact.collect()}
    assert all(abs(best[k] - r["score"]) < 1e-9 for r in found.collect() if (k := (r["q_id"], r["chunk_id"])) in best)


def test_index_of_few_equal_and_missing_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "chunk_id long, vector array<double>")
    index = vector_index.fit(vectors)
    held = vector_index.stored(vectors, index)
    asked = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "q_id long, vector array<double>")
    assert [(r["q_id"], r["rank"], r["chunk_id"]) for r in vector_index.search(asked, vectors, held, index, 5).orderBy("rank").collect()] == [(9, 1, 1), (9, 2, 2), (9, 3, 3)]
    assert vector_index.search(asked.limit(0), vectors, held, index, 5).count() == 0
    with pytest.raises(ValueError):
        vector_index.fit(vectors.limit(0))


def test_query_has_the_neighbours_of_cosine_topk(spark, sf_dir):
    exact = QUERIES["cosine_topk"](spark, sf_dir).where("rank <= 10")
    assert recall(QUERIES["vector_index_topk"](spark, sf_dir), exact) >= 0.95


@pytest.mark.parametrize("kind", ["<f4", ">f4", "<f8", ">f8", "<f2", "<i4"])
def test_matrix_is_read_by_parts(spark, tmp_path, kind):
    x = (np.random.default_rng(1).normal(size=(101, 7)) * 50).astype(kind)
    np.save(tmp_path / "m.npy", x)
    for path in (str(tmp_path / "m.npy"), f"file://{tmp_path}/m.npy"):
        df = read_matrix(spark, path, part_bytes=10 * x.itemsize * 7)
        rows = sorted(df.collect())
        assert [r["chunk_id"] for r in rows] == list(range(101)) and np.array_equal(np.array([r["vector"] for r in rows]), x.astype(float))
    assert df.select(F.spark_partition_id()).distinct().count() == 11


def test_matrices_that_cannot_be_read(spark, tmp_path):
    np.save(tmp_path / "empty.npy", np.zeros((0, 3), np.float32))
    assert read_matrix(spark, str(tmp_path / "empty.npy")).count() == 0
    with open(tmp_path / "v2.npy", "wb") as f:
        np.lib.format.write_array(f, np.ones((2, 2)), version=(2, 0))
    assert read_matrix(spark, str(tmp_path / "v2.npy")).count() == 2
    np.save(tmp_path / "fortran.npy", np.asfortranarray(np.ones((3, 2))))
    np.save(tmp_path / "flat.npy", np.ones(3))
    (tmp_path / "text.npy").write_text("no matrix")
    (tmp_path / "short.npy").write_bytes((tmp_path / "v2.npy").read_bytes()[:-8])
    for name in ("fortran", "flat", "text", "short"):
        with pytest.raises(Exception, match="needed|no numpy file|ends before"):
            read_matrix(spark, str(tmp_path / f"{name}.npy")).count()
