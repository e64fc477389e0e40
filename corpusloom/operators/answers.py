"""Scores of given answers against true ones: overlap of words and n-grams, and their longest common subsequence.

An answer's words are those between white space, in lower case; null is an empty text. Repeats count as often as both texts have them.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import words

#: The longest n-grams of BLEU.
LONGEST = 4


def n_grams(tokens: Column, n: int) -> Column:
    """The n-grams of an array of words, repeats included."""
    grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def overlaps(answers: DataFrame, keys: list[str], longest: int = LONGEST) -> DataFrame:
    """(keys, n, matched, given, true) of answers (keys, given, answer): n-grams that both have, and that each has; no row where neither has one.

    Grams are counted in both texts at once, before and after one shuffle; keys tell the answers apart and may be null.
    """
    sides = F.explode(F.array(*(F.struct(F.lit(own).alias("own"), words(F.lower(c)).alias("w")) for own, c in ((True, "given"), (False, "answer")))))
    cut = answers.select(*keys, sides.alias("s")).select(*keys, "s.own", "s.w")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), n_grams(F.col("w"), n).alias("g")) for n in range(1, longest + 1))))
    grams = cut.select(*keys, "own", each.alias("x")).select(*keys, "own", "x.n", F.explode("x.g").alias("gram"))
    counted = grams.groupBy(*keys, "n", "gram").agg(F.count_if("own").alias("g"), F.count_if(~F.col("own")).alias("a"))
    return counted.groupBy(*keys, "n").agg(F.sum(F.least("g", "a")).alias("matched"), F.sum("g").alias("given"), F.sum("a").alias("true"))


def token_f1(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, f1) of answers (keys, given, answer), each with keys of its own: twice the words that both have, by all words; 1 if neither has any."""
    found = overlaps(answers, keys, 1).select(*(F.col(k).alias(f"_{k}") for k in keys), (2.0 * F.col("matched") / (F.col("given") + F.col("true"))).alias("f1"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return answers.join(found, same, "left").select(*keys, F.coalesce("f1", F.lit(1.0)).alias("f1"))


def bleu(answers: DataFrame, keys: list[str], longest: int = LONGEST) -> DataFrame:
    """One row: bleu of all answers together, precisions (of 1 to longest words), brevity, given and true (words).

    The product of brevity and the geometric mean of the precisions, whose counts are summed over all answers, each gram of an answer counted as often as
    the true one has it at most. 0 where a precision is 0, or nothing is given.
    """
    sums = overlaps(answers, keys, longest).groupBy().agg(*(F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0)).alias(f"{c}{n}") for n in range(1, longest + 1) for c in ("matched", "given", "true")))
    rate = [F.when(F.col(f"given{n}") > 0, F.col(f"matched{n}") / F.col(f"given{n}")).otherwise(0.0) for n in range(1, longest + 1)]
    brevity = F.when(F.col("given1") == 0, 0.0).when(F.col("given1") >= F.col("true1"), 1.0).otherwise(F.exp(1 - F.col("true1") / F.col("given1")))
    mean = F.exp(reduce(lambda a, b: a + b, (F.log(r) for r in rate)) / longest)
    some = reduce(lambda a, b: a & b, (r > 0 for r in rate))
    return sums.select(F.when(some, brevity * mean).otherwise(0.0).alias("bleu"), F.array(*rate).alias("precisions"), brevity.alias("brevity"), F.col("given1").alias("given"), F.col("true1").alias("true"))


def common_length(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence: a row of the table is a number whose bits are the steps in it, folded over the words of a."""
    places: dict[str, int] = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    full = row = (1 << len(b)) - 1
    for w in a:
        met = row & places.get(w, 0)
        row = (row + met | row - met) & full
    return len(b) - row.bit_count()


def rouge_l(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, common, rouge_l) of answers (keys, given, answer): the longest common subsequence of words, and its F1; 1 if neither has words."""
    fields = [answers.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", common long, n_given long, n_true long"

    def run(batches):
        for batch in batches:
            pairs = list(zip(batch.column("_given").to_pylist(), batch.column("_true").to_pylist()))
            found = [[common_length(a, b) for a, b in pairs], [len(a) for a, _ in pairs], [len(b) for _, b in pairs]]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(x, pa.int64()) for x in found)], names=[*keys, "common", "n_given", "n_true"])

    cut = answers.select(*keys, words(F.lower("given")).alias("_given"), words(F.lower("answer")).alias("_true"))
    n = F.col("n_given") + F.col("n_true")
    return cut.mapInArrow(run, schema).select(*keys, "common", F.when(n == 0, 1.0).otherwise(2.0 * F.col("common") / F.nullif(n, F.lit(0))).alias("rouge_l"))
