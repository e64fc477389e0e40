"""The learned encoder against a dense decomposition, and on paraphrases without shared words."""

import numpy as np
import pytest

from corpusloom.operators import retrieval, semantic


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def dense(texts, terms):
    counts = np.zeros((len(texts), terms))
    for i, t in enumerate(texts):
        at, n = semantic.counts_of(t, terms)
        counts[i, at] = n
    weight = np.log((1 + len(texts)) / (1 + (counts > 0).sum(axis=0))) + 1
    rows = counts * weight
    return weight, rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def test_vectors_are_those_of_a_dense_decomposition(spark):
    rng = np.random.default_rng(3)
    themes = [[f"w{t}_{k}" for k in range(8)] for t in range(6)]
    texts = [" ".join(rng.choice(themes[int(rng.choice(6, p=[0.3, 0.25, 0.2, 0.12, 0.08, 0.05]))] + ["and", "the", "of", "by"], 12)) for _ in range(120)] + [None, "", "!!"]
    encoder = semantic.SemanticEncoder.fit(docs(spark, texts), "text", size=4, terms=256, turns=4)
    weight, rows = dense(texts, 256)
    assert np.allclose(encoder.weight, weight)
    right = np.linalg.svd(rows, full_matrices=False)[2][:4]
    right *= np.sign(right[np.arange(4), np.abs(right).argmax(axis=1)])[:, None]
    assert np.allclose(encoder.basis, right.T, atol=1e-3)
    got = {r["doc_id"]: r["vector"] for r in encoder.encode(docs(spark, texts), "doc_id", "text").collect()}
    want = rows @ right.T
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    assert len(got) == len(texts) and np.allclose(np.array([got[i] for i in range(len(texts))]), want, atol=1e-2)


def test_paraphrases_without_shared_words_are_near(spark):
    """Texts link car with automobile; then a text of only one of them finds those of only the other."""
    rng = np.random.default_rng(4)
    pairs = [("car", "automobile"), ("doctor", "physician"), ("film", "movie"), ("stone", "rock")]
    company = {p: [f"{p[0]}{k}" for k in range(12)] for p in pairs}
    texts = [f"{w} " + " ".join(rng.choice(company[p], 8)) for p in pairs for w in p for _ in range(30)]
    texts += [p[1] for p in pairs]
    encoder = semantic.SemanticEncoder.fit(docs(spark, texts), "text", size=4, terms=1024)
    held = encoder.encode(docs(spark, [p[1] for p in pairs]), "doc_id", "text").withColumnRenamed("doc_id", "chunk_id")
    asked = encoder.encode(docs(spark, [p[0] for p in pairs]), "doc_id", "text").withColumnRenamed("doc_id", "q_id")
    first = {r["q_id"]: r["chunk_id"] for r in retrieval.search(asked, held, 4).collect() if r["rank"] == 1}
    assert first == {k: k for k in range(4)}


@pytest.mark.parametrize("texts", [[], [None, "", "?"], ["one"]])
def test_few_texts(spark, texts):
    encoder = semantic.SemanticEncoder.fit(docs(spark, texts), "text", size=3, terms=64)
    rows = encoder.encode(docs(spark, [*texts, "one two", None]), "doc_id", "text").collect()
    assert len(rows) == len(texts) + 2 and len({len(r["vector"]) for r in rows}) == 1


def test_texts_are_split_once(spark):
    """Fitting and encoding read the counts of terms; each text is computed once, not once a pass."""
    met = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    texts = [f"one two w{k % 7} v{k % 5} " * (k % 3) for k in range(90)] + [None]
    read = docs(spark, texts).mapInArrow(seen, "doc_id long, text string")
    counts = semantic.counted(read, "text", "doc_id", terms=256)
    assert met.value == len(texts)
    encoder = semantic.SemanticEncoder.fit_counts(counts, size=3, terms=256)
    got = {r["chunk_id"]: r["vector"] for r in encoder.encode_counts(counts, "chunk_id").collect()}
    assert met.value == len(texts)
    semantic.SemanticEncoder.fit(read, "text", size=3, terms=256)
    assert met.value == 2 * len(texts)
    want = {r["doc_id"]: r["vector"] for r in encoder.encode(docs(spark, texts), "doc_id", "text").collect()}
    assert got == want and len(got) == len(texts)


def test_equal_texts_have_equal_vectors(spark):
    """To the last bit, whatever stands beside them: ties of copies go to the smaller id."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(400)], 40)) for _ in range(100)]
    texts = [texts[0] if k % 9 == 0 else t for k, t in enumerate(texts)]
    counts = semantic.counted(docs(spark, texts), "text", "doc_id", terms=1024)
    encoder = semantic.SemanticEncoder.fit_counts(counts, size=4, terms=1024)
    assert len({tuple(r["vector"]) for r in encoder.encode_counts(counts, "chunk_id").where("chunk_id % 9 = 0").collect()}) == 1


def test_sums_in_one_level_and_in_two(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(300)], 30)) for _ in range(200)]
    counts = semantic.counted(docs(spark, texts), "text", terms=1024).repartition(6)
    weight, narrow = semantic.term_weights(counts, 1024), rng.standard_normal((1024, 5))
    one = semantic.passed(counts, 6, weight, narrow)
    monkeypatch.setattr(semantic, "TASKS_ADDED", 3)
    rows = dense(texts, 1024)[1]
    assert np.allclose(one, rows.T @ (rows @ narrow)) and np.allclose(one, semantic.passed(counts, 6, weight, narrow))
