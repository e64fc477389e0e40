"""Secret scans: three fixed patterns, and a battery of randomness tests with false-discovery control.

Rows: null is read like an empty text, without spans. Repeated rows are scanned alike; extra columns are ignored; an empty
table gives an empty result. Positions count code points, ends are exclusive, and texts are scanned whole.

Everything runs as DataFrame expressions. The battery looks at runs of token characters. For each it infers the encoding,
and tests whether the run could be drawn evenly from that alphabet: chi-squared uniformity, runs above and below the middle
of the alphabet, and serial correlation of neighbouring symbols, joined by Fisher's method. A run that fails is not random.
For those that pass, a second pair of tests gives the chance that ordinary words look like this: too even a use of symbols
(a non-central chi-squared, with the collision rate of the corpus's own words), and too many changes of letter case or
digits. These chances are ranked over the whole corpus by the Benjamini-Hochberg rule, weighted by length, as longer runs
carry more evidence.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import let
from corpusloom.sources.scratch import written

KINDS = ("assign", "access", "hex", "random")
#: The fixed patterns, and the least length of what they must match (for assign, of its second group).
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Candidates of the battery.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
#: A run is not random below this chance; the rate of false discoveries.
NOT_RANDOM = 0.001
FALSE_RATE = 0.01
#: Ordinary words before the corpus is counted: collision rate of letters and rate of class changes, with their weights.
COLLISIONS, COLLISION_WEIGHT = 0.066, 10_000.0
CHANGES, CHANGE_WEIGHT = 0.02, 1_000.0
#: Steps of -ln(chance) in which candidates are ranked.
STEP, STEPS = 0.05, 20_000
#: A run is tested against the smallest alphabet that holds it, as an even draw stays even among the symbols that it uses.
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {
    "decimal": DIGITS,
    "hex": DIGITS + LOWER[:6],
    "HEX": DIGITS + UPPER[:6],
    "lower": LOWER,
    "upper": UPPER,
    "base32lower": LOWER + DIGITS[2:8],
    "base32": UPPER + DIGITS[2:8],
    "base36lower": DIGITS + LOWER,
    "base36": DIGITS + UPPER,
    "letters": UPPER + LOWER,
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = f"({'|'.join(map(_either_case, KEYWORDS))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


def prefix_sums(values: Column) -> Column:
    """For each place of an array of numbers, the sum of those before it; blocks keep the copying at n to the power 1.5."""
    state = "struct<sum:bigint,out:array<bigint>>"

    def scan(items: Column, number) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(items, zero, lambda acc, x: F.struct((acc["sum"] + number(x)).alias("sum"), F.array_append(acc["out"], acc["sum"]).alias("out")).cast(state))

    def blocks(v: Column) -> Column:
        width = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int"))
        firsts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), width)
        return F.transform(firsts, lambda at: scan(F.slice(v, at, width), lambda x: x.cast("bigint")))

    def joined(b: Column) -> Column:
        return let(scan(b, lambda x: x["sum"])["out"], lambda offset: F.flatten(F.transform(b, lambda x, i: F.transform(x["out"], lambda s: s + F.get(offset, i)))))

    return let(values, lambda v: let(blocks(v), joined))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of the leftmost non-overlapping matches of a pattern that matches no empty text."""
    kind = "array<struct<start:bigint,end:bigint,found:string>>"

    def placed(both: Column) -> Column:
        found, gaps = both["found"], both["gaps"]
        steps = F.transform(found, lambda x, i: F.length(x) + F.length(F.get(gaps, i)))
        start = lambda sums, i: F.get(sums, i) + F.length(F.get(gaps, i))
        return let(prefix_sums(steps), lambda sums: F.transform(found, lambda x, i: F.struct(start(sums, i).alias("start"), (start(sums, i) + F.length(x)).alias("end"), x.alias("found"))))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), let(both, placed).cast(kind)).otherwise(F.array().cast(kind))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the fixed patterns, by start and kind; kind is its place in KINDS."""

    def of(found: Column, kind: int) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    assigned = F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2)) >= ASSIGN_VALUE)
    return F.array_sort(F.concat(of(assigned, 0), of(matches(text, ACCESS), 1), of(matches(text, HEX), 2)))


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def encoding(token: Column) -> Column:
    return (
        F.when(token.rlike("[-_]"), F.lit("base64url"))
        .when(token.rlike("[+/]"), F.lit("base64"))
        .when(token.rlike("^[0-9]+$"), F.lit("decimal"))
        .when(token.rlike("^[0-9a-f]+$"), F.lit("hex"))
        .when(token.rlike("^[0-9A-F]+$"), F.lit("HEX"))
        .when(token.rlike("^[a-z]+$"), F.lit("lower"))
        .when(token.rlike("^[A-Z]+$"), F.lit("upper"))
        .when(token.rlike("^[a-z2-7]+$"), F.lit("base32lower"))
        .when(token.rlike("^[A-Z2-7]+$"), F.lit("base32"))
        .when(token.rlike("^[0-9a-z]+$"), F.lit("base36lower"))
        .when(token.rlike("^[0-9A-Z]+$"), F.lit("base36"))
        .when(token.rlike("^[A-Za-z]+$"), F.lit("letters"))
        .otherwise(F.lit("base62"))
    )


def _ln_two_sided(z: Column) -> Column:
    """The log of a normal's two tails beyond |z|, closely."""
    return -0.717 * F.abs(z) - 0.416 * z * z


def battery(token: Column) -> Column:
    """Statistics of one candidate: n, letters of the alphabet, chi2, ln_random (log chance under randomness), changes, plain."""

    def sums(e: Column) -> Column:
        size, n = F.length(e["alphabet"]), F.length(e["body"])
        x = e["x"]
        squares = F.aggregate(F.array_distinct(e["chars"]), F.lit(0.0), lambda acc, c: acc + F.pow((n - F.length(F.replace(e["body"], c, F.lit("")))).cast("double"), F.lit(2.0)))
        middle = (size - 1) / F.lit(2.0)
        high = F.size(F.filter(x, lambda v: v > middle))
        runs = 1 + F.size(F.filter(x, lambda v, i: (i > 0) & ((v > middle) != (F.get(x, i - 1) > middle))))
        serial = F.aggregate(F.transform(x, lambda v, i: F.when(i > 0, (v - middle) * (F.get(x, i - 1) - middle)).otherwise(F.lit(0.0))), F.lit(0.0), lambda acc, v: acc + v)
        changes = F.size(F.filter(e["kinds"], lambda k, i: (i > 0) & (k != F.get(e["kinds"], i - 1))))
        return F.struct(n.alias("n"), size.alias("size"), squares.alias("squares"), high.alias("high"), runs.alias("runs"), serial.alias("serial"), changes.alias("changes"), e["plain"].alias("plain"))

    def tests(s: Column) -> Column:
        n, size = s["n"].cast("double"), s["size"].cast("double")
        chi2 = size / n * s["squares"] - n
        z_chi = (chi2 - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        high, low = s["high"].cast("double"), n - s["high"]
        mean = 2 * high * low / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        z_runs = F.when(spread > 0, (s["runs"] - mean) / F.sqrt(spread)).otherwise(F.lit(30.0))
        z_serial = s["serial"] / ((size * size - 1) / 12) / F.sqrt(n - 1)
        half = -(_ln_two_sided(z_chi) + _ln_two_sided(z_runs) + _ln_two_sided(z_serial))
        ln_random = -half + F.log(1 + half + half * half / 2)
        return F.struct(n.alias("n"), size.alias("size"), s["squares"].alias("squares"), chi2.alias("chi2"), ln_random.alias("ln_random"), s["changes"].cast("double").alias("changes"), s["plain"].alias("plain"))

    named = F.create_map(*(F.lit(x) for kv in ALPHABETS.items() for x in kv))

    def parts(e: Column) -> Column:
        alphabet = e["alphabet"]
        chars = F.regexp_extract_all(e["body"], F.lit("."), F.lit(0))
        kinds = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(F.regexp_replace(e["body"], "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), F.lit("."), F.lit(0))
        whole = F.struct(e["body"].alias("body"), alphabet.alias("alphabet"), chars.alias("chars"), kinds.alias("kinds"), e["body"].rlike("^[A-Za-z][a-z]+$").alias("plain"))
        return let(whole, lambda w: let(F.struct(w["body"].alias("body"), w["alphabet"].alias("alphabet"), w["chars"].alias("chars"), w["kinds"].alias("kinds"), w["plain"].alias("plain"), F.transform(w["chars"], lambda c: F.position(c, w["alphabet"]) - 1).alias("x")), sums))

    body = F.rtrim(token, F.lit("="))
    return let(let(F.struct(body.alias("body"), F.element_at(named, encoding(body)).alias("alphabet")), parts), tests)


def ln_ordinary(s: Column, collisions: float, changes: float) -> Column:
    """The log chance that ordinary words are as even and change class as often; 0 where they would be more so."""
    n, size = s["n"], s["size"]
    rate = F.greatest(F.lit(collisions), 8.0 / (3.0 * size))
    excess = (n - 1) * F.greatest(size * rate - 1, F.lit(0.0))
    z = (s["chi2"] - (size - 1) - excess) / F.sqrt(2 * (size - 1) + 4 * excess)
    even = F.when(z < 0, math.log(0.5) + _ln_two_sided(z)).otherwise(F.lit(0.0))
    share = s["changes"] / (n - 1)
    part = lambda p, q: F.when(p > 0, p * F.log(p / F.lit(q))).otherwise(F.lit(0.0))
    often = F.when(share > changes, -(n - 1) * (part(share, changes) + part(1 - share, 1 - changes))).otherwise(F.lit(0.0))
    half = -(even + often)
    return -half + F.log(1 + half)


def scan(docs: DataFrame, false_rate: float = FALSE_RATE, not_random: float = NOT_RANDOM) -> DataFrame:
    """doc_id, base and added spans (array<struct<start, kind, end>>), one row per row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tested = F.transform(matches(text, CANDIDATE), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), battery(c["found"]).alias("s")))
    found = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), base_spans(text).alias("base"), tested.alias("candidates")), "candidates")

    each = found.select(F.explode("candidates.s").alias("s")).select("s.*")
    pairs, steps = F.col("n") * (F.col("n") - 1), F.col("n") - 1
    counts = each.agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.sum(F.when(F.col("plain"), F.col("squares") - F.col("n"))).alias("equal"), F.sum(F.when(F.col("plain"), pairs)).alias("pairs"), F.sum(F.when(F.col("plain"), F.col("changes"))).alias("changes"), F.sum(F.when(F.col("plain"), steps)).alias("steps")).first()
    collisions = ((counts["equal"] or 0) + COLLISIONS * COLLISION_WEIGHT) / ((counts["pairs"] or 0) + COLLISION_WEIGHT)
    changes = ((counts["changes"] or 0) + CHANGES * CHANGE_WEIGHT) / ((counts["steps"] or 0) + CHANGE_WEIGHT)
    mean = (counts["n"] or 1) / max(counts["m"], 1)

    def rank(s: Column) -> Column:
        """-ln(chance / weight), in steps; weights are in proportion to length and 1 on average."""
        return F.least(F.greatest(F.floor((F.log(s["n"] / mean) - ln_ordinary(s, collisions, changes)) / STEP), F.lit(0)), F.lit(STEPS)).cast("int")

    per_step = found.select(F.explode("candidates.s").alias("s")).select(rank(F.col("s")).alias("step")).groupBy("step").count()
    cut = least_step({r["step"]: r["count"] for r in per_step.collect()}, counts["m"], false_rate)  # STEPS + 1 rows at most
    random = F.filter("candidates", lambda c: (c["s"]["ln_random"] >= math.log(not_random)) & (rank(c["s"]) >= cut) & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return found.select("doc_id", "base", F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end"))).alias("added"))


def least_step(counts: dict[int, int], m: int, false_rate: float) -> int:
    """Benjamini-Hochberg over steps: the least step whose candidates and all above it are discoveries."""
    above, cut = 0, STEPS + 1
    for step in sorted(counts, reverse=True):
        above += counts[step]
        if math.exp(-step * STEP) <= false_rate * above / m:
            cut = step
    return cut


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_random"))
