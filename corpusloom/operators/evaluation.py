"""Scores of retrieval: ranks, recall at K, mean reciprocal rank, targets, reports."""

from __future__ import annotations

import json
import warnings
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.answers import bleu, rouge_l, token_f1

K_VALUES = (1, 3, 5, 10, 18, 30, 50)
TARGET_K, TARGET_RECALL = 50, 0.85


def k_list(k_values=None, retrieve_k: int | None = None) -> tuple[list[int], int]:
    """Distinct K in order (the usual ones for none), and how many hits to fetch."""
    ks = sorted(set(k_values or K_VALUES))
    return ks, max(retrieve_k or ks[-1], ks[-1])


def unique_ranks(hits: DataFrame) -> DataFrame:
    """(q_id, section, unique_rank) of hits (q_id, rank, section): each section counts once, at its best hit."""
    best = hits.groupBy("q_id", "section").agg(F.min("rank").alias("best"))
    return best.withColumn("unique_rank", F.row_number().over(Window.partitionBy("q_id").orderBy("best"))).select("q_id", "section", "unique_rank")


def ground_truth_ranks(hits: DataFrame, truth: DataFrame, unique: bool = True, by: tuple[str, ...] = ("section",)) -> DataFrame:
    """(q_id, gt_rank): the rank of the true section among sections, or (not unique) of the first chunk that agrees in all columns of by.

    Null if it was not found. truth: q_id and the columns of by.
    """
    ranked = unique_ranks(hits) if unique else hits.select("q_id", *by, F.col("rank").alias("unique_rank"))
    found = ranked.join(truth, ["q_id", *(("section",) if unique else by)]).groupBy("q_id").agg(F.min("unique_rank").alias("gt_rank"))
    return truth.select("q_id").join(found, "q_id", "left")


def recall_at(ranks: DataFrame, k_values=K_VALUES) -> DataFrame:
    """(k, hits, n, recall) for each K; recall 0 without queries."""
    n = F.count("*")
    ks = sorted(set(k_values))
    counted = ranks.agg(n.alias("n"), *(F.count_if(F.col("gt_rank") <= k).alias(f"k{k}") for k in ks))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("hits")) for k in ks)))
    return counted.select("n", rows.alias("x")).select("x.k", "x.hits", "n", rate(F.col("x.hits"), F.col("n")).alias("recall"))


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def reciprocal(rank: Column) -> Column:
    return F.coalesce(F.lit(1.0) / rank, F.lit(0.0))


def mrr(ranks: DataFrame) -> DataFrame:
    """One row: n, mrr."""
    return ranks.agg(F.count("*").alias("n"), F.coalesce(F.sum(reciprocal(F.col("gt_rank"))) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("mrr"))


def target_gate(ranks: DataFrame, target_k: int = TARGET_K, target_recall: float = TARGET_RECALL) -> DataFrame:
    """One row: the recall at target_k and whether it is enough."""
    return recall_at(ranks, [target_k]).select(F.col("k").alias("target_k"), "recall", F.lit(target_recall).alias("target_recall"), (F.col("recall") >= target_recall).alias("passed"))


def failures(ranks: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(section, questions, missed): how many questions of each section have it beyond the first k."""
    met = truth.join(ranks, "q_id")
    return met.groupBy("section").agg(F.count("*").alias("questions"), F.count_if(F.col("gt_rank").isNull() | (F.col("gt_rank") > k)).alias("missed"))


def compare(results: DataFrame, metric: str) -> DataFrame:
    """results with place: best metric first, then name."""
    return results.withColumn("place", F.row_number().over(Window.orderBy(F.col(metric).desc(), "name")))


#: Settings that an experiment gives to other evaluators; unknown ones are probably misspelt.
OTHERS_SETTINGS = {"max_questions", "answer_metric", "evaluator"}


class RetrievalEvaluator:
    """evaluate() gives one result with metrics of a retriever over questions (q_id, question, section)."""

    name = "retrieval"

    def __init__(self, k_values=None, retrieve_k=None, target_k: int = TARGET_K, target_recall: float = TARGET_RECALL, unique: bool = True, **unused):
        if unknown := set(unused) - OTHERS_SETTINGS:
            warnings.warn(f"unknown settings {sorted(unknown)} of the retrieval evaluator", stacklevel=2)
        self.ks, self.retrieve_k = k_list([*(k_values or K_VALUES), target_k], retrieve_k)
        self.target_k, self.target_recall, self.unique = target_k, target_recall, unique

    def evaluate(self, retriever, questions: DataFrame) -> dict:
        began = datetime.now()
        hits = retriever.retrieve(questions, self.retrieve_k)
        ranks = ground_truth_ranks(hits, questions.select("q_id", "section"), self.unique).cache()
        try:
            rows, score = recall_at(ranks, self.ks).collect(), mrr(ranks).first()
        finally:
            ranks.unpersist()
        recall = {str(r["k"]): r["recall"] for r in rows}
        return {
            "evaluator": self.name,
            "timestamp": began.strftime("%Y%m%d_%H%M%S"),
            "granularity": "section" if self.unique else "chunk",
            "metrics": {"recall_at": {str(r["k"]): r["hits"] for r in rows}, "recall_rate": recall, "mrr": score["mrr"], "n_total": score["n"]},
            "n_questions": score["n"],
            "elapsed_sec": round((datetime.now() - began).total_seconds(), 3),
            "retrieve_k": self.retrieve_k,
            "k_values": self.ks,
            "target_k": self.target_k,
            "target_recall": self.target_recall,
            "target_passed": recall.get(str(self.target_k), 0.0) >= self.target_recall,
        }

    def format_report(self, result: dict) -> str:
        m = result["metrics"]
        lines = [f"{result['evaluator']}: {result['n_questions']} questions, {result['elapsed_sec']} s"]
        lines += [f"K={k:<3} → {m['recall_rate'][str(k)]:.4f}  ({m['recall_at'][str(k)]}/{m['n_total']})" for k in result["k_values"]]
        lines.append(f"MRR   → {m['mrr']:.4f}")
        lines.append(f"Recall@{result['target_k']} >= {result['target_recall']}: {'PASSED' if result['target_passed'] else 'FAILED'}")
        return "\n".join(lines)

    def save(self, result: dict, stem: str) -> None:
        Path(stem).parent.mkdir(parents=True, exist_ok=True)
        Path(f"{stem}.txt").write_text(self.format_report(result) + "\n", encoding="utf-8")
        Path(f"{stem}.json").write_text(json.dumps(result, ensure_ascii=False, indent=2), encoding="utf-8")


class AnswerEvaluator:
    """Scores of answers (q_id, given, answer): mean token F1 and ROUGE-L, and BLEU of all together."""

    name = "answers"

    def evaluate(self, answers: DataFrame) -> DataFrame:
        """One row: n, f1, rouge_l, bleu."""
        means = token_f1(answers, ["q_id"]).agg(F.count("*").alias("n"), F.avg("f1").alias("f1"))
        subsequences = rouge_l(answers, ["q_id"]).agg(F.avg("rouge_l").alias("rouge_l"))
        one = F.lit(1).alias("one")
        return means.select(one, "*").join(subsequences.select(one, "*"), "one").join(bleu(answers, ["q_id"]).select(one, "bleu"), "one").drop("one")


EVALUATORS = {x.name: x for x in (RetrievalEvaluator, AnswerEvaluator)}


def list_evaluators() -> list[str]:
    return list(EVALUATORS)


def compare_saved(spark: SparkSession, path: str, metric: str = "mrr") -> DataFrame:
    """Saved results (name: the file's; the metric, and recall_rate as a map) with their place, best first."""
    saved = spark.read.schema("metrics struct<mrr:double,n_total:bigint,recall_rate:map<string,double>>").json(path, multiLine=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return compare(saved.select(name.alias("name"), "metrics.mrr", "metrics.n_total", "metrics.recall_rate"), metric)


def get_evaluator(name: str, **how):
    if name not in EVALUATORS:
        raise ValueError(f"unknown evaluator {name!r}; there are {sorted(EVALUATORS)}")
    return EVALUATORS[name](**how)
