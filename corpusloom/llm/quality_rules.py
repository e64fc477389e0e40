"""Quality rules: text statistics, and a decision list learned from labelled statistics.

Rows: a null text has no words. A text without words has ratios of 0 and fails the base rules. Repeated rows get the same
verdict; a null doc_id has no label. Extra columns are ignored; without labels of both kinds no rule is learned, and an
empty table gives an empty result. Texts are read whole.

The list is learned by sequential covering. Each round grows one rule, a conjunction of thresholds, on two thirds of the
labelled rows, by information gained on rows that no earlier rule covers; cuts it back to the prefix that does best on the
other third; keeps it if it is precise enough there; and takes the covered rows away. What a round needs from the rows is a
count by label for each statistic and threshold, so only such counts reach the driver. Covering ends when no rule is precise
enough, or after MAX_RULES rules of MAX_CONDITIONS conditions each, so that the list stays short enough to read. The rules
come out as one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, crc_of_id, let, words_of
from corpusloom.sources.scratch import written

MIN_WORDS = 50
MAX_REPEATED = 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"
#: Learning: labelled rows at most (a sample by hash beyond that), thresholds of a statistic, bounds on the list.
MAX_LABELLED = 20_000
CUTS = 32
MAX_RULES = 8
MAX_CONDITIONS = 3
MIN_PRECISION = 0.8
MIN_COVERED = 5

FEATURES = ("word_length", "symbols", "upper", "marks", "digits", "dup_lines", "repeated", "line_words")


def _repeat_words(words: Column, hashed=F.xxhash64) -> Column:
    """Words in WINDOW-word windows that are found twice or more in the text.

    Each window is a long: its hash in the high bits and its place in the low ones, so that sorting brings equal windows
    together. Neighbours with equal hash bits are compared word by word; where these differ, which hardly ever happens, the
    window is compared with all others. The places of repeated windows, in order, cover min(WINDOW, distance to the next)
    words each.
    """

    def windows(w: Column) -> Column:
        last = F.size(w) - WINDOW
        places = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        bits = F.length(F.bin(F.size(w).cast("bigint")))  # of a place
        low = F.element_at(F.array(*(F.lit(1 << k) for k in range(32))), bits + 1).cast("bigint") - 1
        of_words = F.transform(w, lambda x: F.xxhash64(x))
        packed = let(of_words, lambda h: F.sort_array(F.transform(places, lambda i: hashed(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("bigint")))))
        return let(F.struct(w.alias("w"), packed.alias("p"), low.alias("low")), repeated)

    def repeated(s: Column) -> Column:
        w, p, low = s["w"], s["p"], s["low"]
        place = lambda x: x.bitwiseAND(low).cast("int")

        def equal(x: Column, y: Column) -> Column:
            i, j = place(x), place(y)
            words = F.get(w, i) == F.get(w, j)
            for k in range(1, WINDOW):
                words = words & (F.get(w, i + k) == F.get(w, j + k))
            return F.when(x.bitwiseXOR(y) <= low, F.when(x.bitwiseXOR(y) >= 0, words).otherwise(F.lit(False))).otherwise(F.lit(False))

        def found(x: Column, i: Column) -> Column:
            before, after = F.when(i > 0, F.get(p, i - 1)), F.get(p, i + 1)
            alike = lambda y: F.coalesce(x.bitwiseXOR(y).between(0, low), F.lit(False))
            beyond = F.exists(p, lambda y: (x != y) & equal(x, y))
            return F.when(F.coalesce(equal(x, before), F.lit(False)), F.lit(True)).when(F.coalesce(equal(x, after), F.lit(False)), F.lit(True)).when(alike(before) | alike(after), beyond).otherwise(F.lit(False))

        twice = F.filter(p, found)
        at = F.sort_array(F.transform(twice, place))
        return let(at, lambda a: F.aggregate(F.transform(a, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(a, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda acc, x: acc + x))

    return let(words, windows)


def statistics(text: Column) -> Column:
    """One struct of counts and of the statistics that rules are learned from."""
    clean = F.coalesce(text.cast("string"), F.lit(""))
    without = lambda signs: F.length(clean) - F.length(F.translate(clean, signs, ""))

    def of(b: Column) -> Column:
        n_words, lines = F.size(b["words"]), b["lines"]
        n_lines = F.size(lines)
        chars = F.length(F.translate(clean, " \t\n\x0b\f\r", ""))
        symbols, dup = without(SYMBOLS), n_lines - F.size(F.array_distinct(lines))
        repeat = _repeat_words(b["words"])
        marks = without("!?;:")
        return F.struct(
            n_words.cast("long").alias("n_words"),
            chars.cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            dup.cast("long").alias("n_dup_lines"),
            repeat.cast("long").alias("n_repeat_words"),
            F.length(F.regexp_replace(clean, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
            marks.cast("long").alias("n_marks"),
            without("0123456789").cast("long").alias("n_digits"),
            n_lines.cast("long").alias("n_lines"),
        )

    lines = F.filter(F.split(clean, "\n"), lambda x: x.rlike(WORD))
    return let(F.struct(words_of(clean).alias("words"), lines.alias("lines")), of)


def features(s: Column) -> Column:
    """The statistics that rules may test, in the order of FEATURES."""
    ratio = lambda a, n: F.when(s[n] > 0, s[a] / s[n]).otherwise(F.lit(0.0)).cast("double")
    parts = (("word_chars", "n_words"), ("n_symbols", "n_words"), ("n_upper", "word_chars"), ("n_marks", "n_words"), ("n_digits", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_words", "n_lines"))
    return F.array(*(ratio(a, n) for a, n in parts))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEATED * s["n_words"])


@dataclass(frozen=True)
class Condition:
    """feature >= cut, or feature < cut."""

    feature: int
    above: bool
    cut: float

    def holds(self, x: Column) -> Column:
        value = F.element_at(x, self.feature + 1)
        return value >= F.lit(self.cut) if self.above else value < F.lit(self.cut)

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.above else '<'} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def rule_holds(rule: Rule, x: Column) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.holds(x)
    return out


def decision(rules: list[Rule], x: Column) -> Column:
    """The first rule that holds, as text; null if none does."""
    out = None
    for rule in rules:
        hit, name = rule_holds(rule, x), F.lit(" and ".join(map(str, rule)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(None).cast("string") if out is None else out


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    """First-order information gained on the bad rows by going from (p0, n0) to (p, n)."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else 0.0


def learn(rows: DataFrame) -> list[Rule]:
    """A decision list from rows (x: array of FEATURES, bad: boolean, grow: boolean); bad rows are what it covers."""
    width = len(FEATURES)
    shares = [k / CUTS for k in range(1, CUTS)]
    value = lambda k: F.element_at("x", k + 1)
    of_all = [F.percentile_approx(value(k), shares, 1000) for k in range(width)]
    of_bad = [F.percentile_approx(F.when(F.col("bad"), value(k)), shares, 1000) for k in range(width)]
    counted = rows.agg(F.count("*"), *of_all, *of_bad).first()
    if not counted[0]:
        return []

    def thresholds(k: int) -> list[float]:
        """Quantiles of all rows and of bad rows, and the middles between neighbours: a gap is cut in its middle."""
        found = sorted({*counted[k + 1], *(counted[k + 1 + width] or [])})
        return sorted({*found, *((a + b) / 2 for a, b in zip(found, found[1:]))})

    cuts = [thresholds(k) for k in range(width)]

    def by_bin(where: Column) -> list[list[list[int]]]:
        """[feature][bin] -> [good, bad] of the growing rows that hold."""
        def bin_of(k: int) -> Column:
            value = F.element_at("x", k + 1)
            return F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts[k])).cast("array<double>"), lambda c: c <= value))

        bins = F.array(*map(bin_of, range(width)))
        got = rows.where(F.col("grow") & where).select("bad", F.posexplode(bins).alias("feature", "bin")).groupBy("feature", "bin").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad")).collect()
        out = [[[0, 0] for _ in range(len(cuts[k]) + 1)] for k in range(width)]
        for r in got:
            out[r["feature"]][r["bin"]] = [r["good"], r["bad"]]
        return out

    def grown(free: Column) -> list[Condition]:
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS:
            table = by_bin(free & rule_holds(tuple(rule), F.col("x")))
            n0, p0 = (sum(x[i] for x in table[0]) for i in (0, 1))
            best = (0.0, None)
            for k, bins in enumerate(table):
                n, p = n0, p0
                for b, cut in enumerate(cuts[k]):
                    n, p = n - bins[b][0], p - bins[b][1]
                    for above, (nn, pp) in ((True, (n, p)), (False, (n0 - n, p0 - p))):
                        if pp >= MIN_COVERED and (g := _gain(p0, n0, pp, nn)) > best[0] + 1e-9:
                            best = (g, Condition(k, above, float(cut)))
            if best[1] is None:
                break
            rule.append(best[1])
        return rule

    def pruned(rule: list[Condition], free: Column) -> tuple[Rule, int, int]:
        prefixes = [tuple(rule[: k + 1]) for k in range(len(rule))]
        got = rows.where(~F.col("grow") & free).agg(*(F.count_if(F.col("bad") & rule_holds(r, F.col("x"))) for r in prefixes), *(F.count_if(~F.col("bad") & rule_holds(r, F.col("x"))) for r in prefixes)).first()
        worth = lambda k: ((got[k] - got[k + len(prefixes)]) / (got[k] + got[k + len(prefixes)] or 1), -k)
        k = max(range(len(prefixes)), key=worth)
        return prefixes[k], got[k], got[k + len(prefixes)]

    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        free = decision(rules, F.col("x")).isNull()
        rule = grown(free)
        if not rule:
            break
        best, p, n = pruned(rule, free)
        if p < max(1, MIN_COVERED // 2) or p < MIN_PRECISION * (p + n):
            break
        rules.append(best)
    return rules


def learn_from(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """The list learned from docs that labels (doc_id, quality) marks: quality 0 is bad. Ids of the sample are broadcast: max_labelled of them, about."""
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad")).withColumnRenamed("doc_id", "label_id")
    n = marked.count()
    if n > max_labelled:
        marked = marked.where(F.pmod(F.xxhash64("label_id"), F.lit(n)) < max_labelled)
    met = docs.select("doc_id", "text").join(F.broadcast(marked), F.col("doc_id") == F.col("label_id"))
    # Written before it is filtered: a filter on the statistics would be moved below the join, to all texts.
    counted = written(met.select("doc_id", "bad", statistics(F.col("text")).alias("s")), "counted").where(~base_failed(F.col("s")))
    return learn(written(counted.select(features(F.col("s")).alias("x"), "bad", (crc_of_id(F.col("doc_id")) % 3 != 1).alias("grow")), "labelled"))


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the counts, base_failed, kept and rule, one row per row of docs."""
    s = docs.select(F.col("doc_id").cast("long").alias("doc_id"), statistics(F.col("text")).alias("s"))
    return s.withColumn("rule", decision(rules, features(F.col("s")))).select("doc_id", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words", base_failed(F.col("s")).alias("base_failed"), (~base_failed(F.col("s")) & F.col("rule").isNull()).alias("kept"), "rule")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs, learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and that no learned rule rejects."""
    rules = learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    s = statistics(F.col("text"))
    keep = let(s, lambda s: ~base_failed(s) & decision(rules, features(s)).isNull())
    return docs.where(keep)
