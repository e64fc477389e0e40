"""URL filters: fixed host and path rules, and association rules mined from labelled URLs by FP-growth.

Rows: a null URL, or one without ://, has an empty host and path, fits no fixed rule and has no tokens, so it is allowed.
Repeated rows are judged alike; a null page_id has no label. Very long URLs are tokenised and matched whole; mining reads of
each labelled URL the WIDTH tokens that tell most about labels. Extra columns are ignored; an empty table gives an empty
result. Without labels of both kinds no rule is mined.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.scratch import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the fixed rules.
FIXED = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A mined rule needs this share of all labelled URLs (and this many) that it fits and that are bad, this share of bad ones
#: among those that it fits, and a share so many standard errors above that of all labelled URLs.
MIN_SUPPORT = 0.002
MIN_URLS = 20
MIN_CONFIDENCE = 0.6
MIN_Z = 3.0
#: Tokens of a rule, and tokens of a labelled URL that are mined: a URL has 2 ** WIDTH combinations at most.
MAX_TOKENS = 4
WIDTH = 12
#: Rules up to this number are broadcast to the URLs; more of them meet the URLs' tokens in a shuffle.
BROADCAST_RULES = 20_000
BAD = "label=bad"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = after_scheme(F.coalesce(url, F.lit("")))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def fixed_rule(host: Column, path: Column) -> Column:
    """The longest fixed rule that fits as struct<rule, verdict>; null if none does."""
    out = None
    for verdict, rule_host, rule_path in sorted(FIXED, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL by kind: scheme, host labels, registered domain, path segments (numbers as one), suffix, query keys, fragment."""
    clean = F.coalesce(url, F.lit(""))
    host, path = host_and_path(clean)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    marked = lambda kind, items: F.transform(items, lambda x: F.concat(F.lit(f"{kind}="), x))
    one = lambda kind, value: F.filter(F.array(F.concat(F.lit(f"{kind}="), value)), lambda x: x != f"{kind}=")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    plain = F.transform(segments, lambda x: F.when(x.rlike(r"^[0-9]+(\.[a-z]+)?$"), F.lit("#")).otherwise(x))
    keys = F.transform(F.filter(F.split(F.regexp_extract(clean, r"\?([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    parts = (
        one("scheme", F.lower(F.regexp_extract(clean, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
        marked("host", labels),
        one("domain", F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)),
        marked("path", plain),
        one("suffix", F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)),
        marked("key", keys),
        one("fragment", F.regexp_extract(clean, "#(.*)$", 1)),
    )
    return F.when(F.instr(clean, "://") > 0, F.array_distinct(F.concat(*parts))).otherwise(F.array().cast("array<string>"))


def informative(labelled: DataFrame, least: int, base: float) -> DataFrame:
    """(bad, items) of labelled (row, tokens, bad): of each URL the WIDTH tokens whose share of bad URLs is furthest from base.

    Tokens of fewer than least URLs are left out. Of tokens that are in exactly the same URLs, such as the parts of one domain
    or the segments of a repeated URL, one stands for all; they are told by their count and two sums of hashed row numbers.
    """
    each = labelled.select("row", "bad", F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.xxhash64("row", F.lit(1)) % (1 << 31)).alias("y")).where(F.col("n") >= least)
    z = F.abs(F.col("n_bad") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    named = seen.groupBy("n", "n_bad", "x", "y").agg(F.min("token").alias("token")).select("token", z.alias("z"))
    # A token has least URLs, so there are no more of them than tokens of all URLs / least: URL length / MIN_SUPPORT, about.
    ranked = each.join(F.broadcast(named), "token").groupBy("row", "bad").agg(F.sort_array(F.collect_list(F.struct(-F.col("z"), "token"))).alias("t"))
    return ranked.select("bad", F.slice(F.transform("t", lambda x: x["token"]), 1, WIDTH).alias("items"))


def subsets(items: Column) -> Column:
    """All subsets of a short array, each in its order."""
    none = F.array(F.array().cast("array<string>"))
    return F.aggregate(items, none, lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.array_append(s, x))))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_urls: int = MIN_URLS, min_confidence: float = MIN_CONFIDENCE, min_z: float = MIN_Z) -> DataFrame:
    """(rule_id, antecedent, post, confidence, lift) from labelled (tokens, bad); post is the rarest token of the antecedent.

    Candidates come from Spark's FP-growth over the tokens with one more for a bad label, and say that bad follows. They are
    counted again over all tokens of all labelled URLs, and pruned by support, by confidence, and by how far the confidence
    is above the share of bad labels. A rule is dropped if a shorter one, made of some of its tokens, is as confident.
    """
    schema = "rule_id long, antecedent array<string>, post string, confidence double, lift double"
    labelled = written(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "labelled")
    n, bad = labelled.agg(F.count("*"), F.count_if("bad")).first()
    if not 0 < bad < n:
        return labelled.sparkSession.createDataFrame([], schema)
    least, base = max(min_urls, math.ceil(min_support * n)), bad / n
    sets = F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items"))
    items = written(informative(labelled, least, base).select(sets.alias("items")), "items")
    m = items.count()  # URLs with a frequent token
    if m < least:
        return labelled.sparkSession.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=least / m, minConfidence=min_confidence).fit(items)
    of_bad = (F.size("consequent") == 1) & (F.get("consequent", F.lit(0)) == BAD) & (F.size("antecedent") <= MAX_TOKENS)
    single = model.freqItemsets.where(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("item"), "freq")
    each = model.associationRules.where(of_bad).select(F.array_sort("antecedent").alias("antecedent"), F.explode("antecedent").alias("item"))
    posted = each.join(single, "item").groupBy("antecedent").agg(F.min(F.struct("freq", "item"))["item"].alias("post"))
    candidates = written(posted.select(F.xxhash64("antecedent").alias("rule_id"), "antecedent", "post"), "candidates")
    met = matched(labelled, candidates).join(labelled.select("row", "bad"), "row")
    counts = met.groupBy("rule_id").agg(F.count("*").alias("fits"), F.count_if("bad").alias("hits"))
    confidence = F.col("hits") / F.col("fits")
    above = (confidence - base) / F.sqrt(F.lit(base * (1 - base)) / F.col("fits")) >= min_z
    enough = counts.where((F.col("hits") >= least) & (confidence >= min_confidence) & above).select("rule_id", confidence.alias("confidence"), (confidence / base).alias("lift"))
    found = written(candidates.join(enough, "rule_id"), "rules")
    shorter = found.select(F.col("antecedent").alias("part"), F.col("confidence").alias("part_confidence"))
    parts = found.select("rule_id", "antecedent", "confidence", F.explode(subsets(F.col("antecedent"))).alias("part")).where(F.size("part") < F.size("antecedent"))
    beaten = parts.join(shorter, "part").where(F.col("part_confidence") >= F.col("confidence")).select("rule_id").distinct()
    return written(found.join(beaten, "rule_id", "left_anti").select("rule_id", "antecedent", "post", "confidence", "lift"), "mined")


def matched(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, rule_id) of the rows (row, tokens) that hold all tokens of a rule.

    The inverted index holds each rule once, under its rarest token; a row's tokens look up candidates, whose other tokens
    are then checked against the row.
    """
    index = rules.select("rule_id", "antecedent", "post")
    if index.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    asked = rows.select("row", "tokens", F.explode("tokens").alias("token"))
    return asked.join(index, F.col("token") == F.col("post")).where(F.size(F.array_except("antecedent", "tokens")) == 0).select("row", "rule_id")


def judge(pages: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """page_id, host, path, rule, verdict and mined (ids of mined rules that fit), one row per row of pages.

    labels: (page_id, bad). Fixed rules come first; other URLs are blocked if a mined rule fits.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = written(pages.select(F.col("page_id").cast("long").alias("page_id"), F.monotonically_increasing_id().alias("row"), host.alias("host"), path.alias("path"), tokens(F.col("url").cast("string")).alias("tokens")), "urls")
    marked = labels.groupBy("page_id").agg(F.max("bad").alias("bad")).withColumnRenamed("page_id", "label_id")
    rules = mine(rows.join(marked, F.col("page_id") == F.col("label_id")).select("tokens", "bad"), **how)
    hits = matched(rows, rules).groupBy("row").agg(F.sort_array(F.collect_set("rule_id")).alias("mined")).withColumnRenamed("row", "hit")
    fixed = fixed_rule(F.col("host"), F.col("path"))
    met = rows.join(hits, F.col("row") == F.col("hit"), "left").withColumn("fixed", fixed)
    method = F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return met.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", method).alias("verdict"), "mined")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad): a page shows the document whose number its path ends with; it is bad if that has quality 0."""
    number = F.try_to_number(F.regexp_extract("url", r"://[^?#]*/([0-9]{1,18})(?:/|\.[a-z]+)?(?:[?#]|$)", 1), F.lit("9" * 18)).cast("long")
    shown = pages.select(F.col("page_id").cast("long").alias("page_id"), number.alias("number")).where("number is not null and page_id is not null")
    marked = labels.where("quality is not null").select(F.col("doc_id").alias("label_id"), (F.col("quality") == 0).alias("bad"))
    return shown.join(marked, F.col("number") == F.col("label_id")).select("page_id", "bad")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, page_labels(pages, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("mined")
