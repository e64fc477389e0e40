"""Scores of answers against plain loops."""

import math
import random
from collections import Counter

import pytest

from corpusloom.operators import answers, evaluation
from corpusloom.plans.registry import QUERIES, answered

PAIRS = [(1, 1, "The the cat cat sat", "the cat the mat"), (1, 2, None, None), (1, 3, "", "a b"), (2, 1, "one  two\nthree four five", "One two three four six seven"), (None, 1, "x x x x", "x"), (3, 1, "a b c d e f", "f e d c b a"), (3, 2, "b c d e", "a b c d e")]


def grams(text, n):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def plain_bleu(pairs):
    precisions = []
    for n in range(1, 5):
        each = [(grams(a, n), grams(b, n)) for a, b in pairs]
        total = sum(sum(a.values()) for a, _ in each)
        precisions.append(sum(sum((a & b).values()) for a, b in each) / total if total else 0.0)
    c, r = (sum(sum(grams(t, 1).values()) for t in texts) for texts in zip(*pairs))
    brevity = 0.0 if not c else 1.0 if c >= r else math.exp(1 - r / c)
    return (brevity * math.exp(sum(map(math.log, precisions)) / 4) if min(precisions) else 0.0), precisions, brevity


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(row[j], before[j + 1]))
    return row[-1]


def test_common_subsequences():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert answers.common_length(a, b) == plain_common(a, b)


def test_scores_of_answers(spark):
    table = spark.createDataFrame(PAIRS, "conv_id long, turn int, given string, answer string").repartition(3)
    keys = ["conv_id", "turn"]
    want = {}
    for c, t, a, b in PAIRS:
        x, y = grams(a, 1), grams(b, 1)
        n = sum(x.values()) + sum(y.values())
        want[c, t] = 2 * sum((x & y).values()) / n if n else 1.0
    assert {(r[0], r[1]): pytest.approx(r["f1"]) for r in answers.token_f1(table, keys).collect()} == want
    for r in answers.overlaps(table, keys).collect():
        a, b = next((a, b) for c, t, a, b in PAIRS if (c, t) == (r["conv_id"], r["turn"]))
        x, y = grams(a, r["n"]), grams(b, r["n"])
        assert (r["matched"], r["given"], r["true"]) == (sum((x & y).values()), sum(x.values()), sum(y.values()))
    found, (score, precisions, brevity) = answers.bleu(table, keys).first(), plain_bleu([p[2:] for p in PAIRS])
    assert 0 < score == pytest.approx(found["bleu"]) and found["precisions"] == pytest.approx(precisions) and found["brevity"] == pytest.approx(brevity)
    for part in (PAIRS[1:3], PAIRS[:1], []):
        assert answers.bleu(spark.createDataFrame(part, table.schema), keys).first()["bleu"] == pytest.approx(plain_bleu([p[2:] for p in part] or [("", "")])[0])
    total = evaluation.get_evaluator("answers").evaluate(table.withColumnsRenamed({"turn": "t"}).selectExpr("10 * coalesce(conv_id, 9) + t AS q_id", "given", "answer")).first()
    assert total["n"] == len(PAIRS) and total["f1"] == pytest.approx(sum(want.values()) / len(want)) and total["bleu"] == pytest.approx(score)


def test_rouge_of_all_conversations(spark, sf_dir):
    rows = {(r["conv_id"], r["turn"]): r for r in QUERIES["answer_rouge"](spark, sf_dir).collect()}
    texts = answered(spark, sf_dir).collect()
    assert len(rows) == len(texts) > 0
    for r in texts:
        a, b = r["given"].lower().split(), r["answer"].lower().split()
        common = plain_common(a, b)
        assert rows[r["conv_id"], r["turn"]]["common"] == common
        assert rows[r["conv_id"], r["turn"]]["rouge_l"] == pytest.approx(2 * common / (len(a) + len(b)) if a or b else 1.0, abs=1e-6)
