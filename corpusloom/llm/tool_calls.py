"""Tool-call linking: calls and results joined by identifier, ordered, validated and written as canonical JSON.

Rows: a call without an identifier, or a result without one, links to nothing and is reported as such. Repeated rows are
calls or results of their own; rows with one identifier are one call to those that need it, and their needs add up. Null or
invalid arguments are reported, not dropped; texts of any length are kept whole. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import follow, n_words, numbered
from corpusloom.sources.scratch import written

KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
#: Keywords of a JSON schema that fault() knows, and those that say nothing about a value.
KEYWORDS = set(
    "type enum const minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern required properties additionalProperties "
    "minProperties maxProperties items minItems maxItems uniqueItems anyOf oneOf allOf not".split()
)
REMARKS = {"$schema", "$comment", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly"}


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, and text as it is; ValueError for what UTF-8 or JSON cannot hold."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    text.encode("utf-8")
    return text


def parts_of(schema) -> list:
    """The schemas directly inside a schema."""
    one = [schema[k] for k in ("items", "not", "additionalProperties") if k in schema]
    return one + list(schema.get("properties", {}).values()) + [x for k in ("anyOf", "oneOf", "allOf") for x in schema.get(k, ())]


#: What a keyword's value has to be; a count is a whole number that is not negative.
VALUES = {
    "schema": "items not additionalProperties",
    "schemas": "anyOf oneOf allOf",
    "number": "minimum maximum exclusiveMinimum exclusiveMaximum multipleOf",
    "count": "minLength maxLength minProperties maxProperties minItems maxItems",
    "list": "enum",
    "names": "required",
    "object": "properties",
    "string": "pattern",
    "boolean": "uniqueItems",
}
FORM_OF = {keyword: form for form, keywords in VALUES.items() for keyword in keywords.split()}


def has_form(value, form: str) -> bool:
    if form == "schema":
        return isinstance(value, (bool, dict))
    if form == "schemas":
        return isinstance(value, list) and bool(value) and all(isinstance(x, (bool, dict)) for x in value)
    if form == "names":
        return isinstance(value, list) and all(isinstance(x, str) for x in value)
    if form == "count":
        return is_number(value) and value >= 0 and value == int(value)
    return is_number(value) if form == "number" else isinstance(value, {"list": list, **KINDS}[form])


def check_schema(schema, at: str = "$") -> None:
    """ValueError if a schema uses a keyword that fault() would pass over, or one with a value that is none for it."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: {schema!r} is not a schema")
    if unknown := set(schema) - KEYWORDS - REMARKS:
        raise ValueError(f"{at}: keywords {sorted(unknown)} are not supported")
    if wrong := [k for k in schema if k in FORM_OF and not has_form(schema[k], FORM_OF[k])]:
        raise ValueError(f"{at}: {wrong[0]} cannot be {schema[wrong[0]]!r}")
    kinds = schema.get("type", [])
    if unknown := [k for k in (kinds if isinstance(kinds, list) else [kinds]) if not isinstance(k, str) or k not in (*KINDS, "number", "integer")]:
        raise ValueError(f"{at}: there is no type {unknown[0]!r}")
    if schema.get("multipleOf", 1) <= 0:
        raise ValueError(f"{at}: multipleOf has to be above 0")
    try:
        re.compile(schema.get("pattern", ""))
    except re.error as e:
        raise ValueError(f"{at}: pattern {schema['pattern']!r}: {e}") from e
    if not all(isinstance(x, (bool, dict)) for x in schema.get("properties", {}).values()):
        raise ValueError(f"{at}: properties have to be schemas")
    for i, part in enumerate(parts_of(schema)):
        check_schema(part, f"{at}/{i}")


def is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def is_kind(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        return is_number(value) and (kind == "number" or value == int(value))
    return isinstance(value, KINDS[kind])


def same(a, b) -> bool:
    """Equality of JSON: 1 is 1.0, but not true."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def fault(value, schema, at: str = "$") -> str | None:
    """The first place where value breaks a JSON schema of KEYWORDS, with what it breaks there; null if none."""
    if isinstance(schema, bool):
        return None if schema else f"{at}: not allowed"
    has = schema.get
    if kinds := has("type"):
        kinds = kinds if isinstance(kinds, list) else [kinds]
        if not any(is_kind(value, k) for k in kinds):
            return f"{at}: not {' or '.join(kinds)}"
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
        return f"{at}: not in enum"
    if "const" in schema and not same(value, schema["const"]):
        return f"{at}: not const"
    tests = []
    if is_number(value):
        tests = [("minimum", "below minimum", lambda x: value < x), ("maximum", "above maximum", lambda x: value > x), ("exclusiveMinimum", "not above minimum", lambda x: value <= x), ("exclusiveMaximum", "not below maximum", lambda x: value >= x), ("multipleOf", "no multiple", lambda x: abs(value / x - round(value / x)) > 1e-9)]
    elif isinstance(value, str):
        tests = [("minLength", "too short", lambda x: len(value) < x), ("maxLength", "too long", lambda x: len(value) > x), ("pattern", "no match", lambda x: not re.search(x, value))]
    elif isinstance(value, list):
        tests = [("minItems", "too few", lambda x: len(value) < x), ("maxItems", "too many", lambda x: len(value) > x), ("uniqueItems", "not unique", lambda x: x and len({canonical(v) for v in value}) < len(value))]
    elif isinstance(value, dict):
        tests = [("minProperties", "too few", lambda x: len(value) < x), ("maxProperties", "too many", lambda x: len(value) > x)]
    for keyword, words, broken in tests:
        if keyword in schema and broken(schema[keyword]):
            return f"{at}: {words}"
    if isinstance(value, dict):
        for k in has("required", ()):
            if k not in value:
                return f"{at}.{k}: missing"
        known, other = has("properties", {}), has("additionalProperties", True)
        for k in sorted(value):
            if k not in known and other is False:
                return f"{at}.{k}: unknown"
            if found := fault(value[k], known.get(k, other), f"{at}.{k}"):
                return found
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if found := fault(x, schema["items"], f"{at}[{i}]"):
                return found
    for part in has("allOf", ()):
        if found := fault(value, part, at):
            return found
    fits = lambda parts: sum(fault(value, p, at) is None for p in parts)
    if "anyOf" in schema and not fits(schema["anyOf"]):
        return f"{at}: fits none"
    if "oneOf" in schema and (n := fits(schema["oneOf"])) != 1:
        return f"{at}: fits {n} of one"
    if "not" in schema and fits([schema["not"]]):
        return f"{at}: fits what it must not"
    return None


def _no_constant(name: str):
    raise ValueError(name)


def checked(name, arguments, schemas: dict) -> tuple[str | None, str | None]:
    """(fault, canonical arguments) of one call."""
    if name not in schemas:
        return "unknown tool", None
    try:
        value = json.loads(arguments, parse_constant=_no_constant)
        return fault(value, schemas[name]), canonical(value)
    except (TypeError, ValueError, OverflowError, RecursionError):
        return "not JSON", None


def checker(schemas: dict[str, dict]) -> Callable:
    """A column function (name, arguments) -> struct<fault, canonical>: null fault if the arguments are valid JSON by the name's schema."""
    for schema in schemas.values():
        check_schema(schema)

    @F.pandas_udf(T.StructType([T.StructField("fault", T.StringType()), T.StructField("canonical", T.StringType())]))
    def check(name: pd.Series, arguments: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([checked(a, b, schemas) for a, b in zip(name, arguments)], columns=["fault", "canonical"])

    return check


def recorded(call_id, name, arguments, answer) -> str:
    """One pair as canonical JSON; arguments are canonical already, or null."""
    rest = [f'"{k}":{canonical(v)}' for k, v in (("id", call_id), ("name", name), ("result", answer))]
    return "{" + ",".join([f'"arguments":{arguments or "null"}', *rest]) + "}"


@F.pandas_udf(T.StringType())
def record(call_id: pd.Series, name: pd.Series, arguments: pd.Series, answer: pd.Series) -> pd.Series:
    return pd.Series([recorded(*x) for x in zip(call_id, name, arguments, answer)], dtype=object)


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of calls (call_id, needs: array): 0 if none of its needs is a known call, else one more than the
    highest of these; null in a cycle, and for what needs a call in one.

    Chains come first. A call with one need points to it; each round, pointers are followed twice as far, so that all chains
    end after a logarithm of rounds: at a call without needs or at one with several. These are then settled in layers, each
    once all its needs are; so the rounds are as many as calls with several needs lie on a path.
    """
    calls = calls.where("call_id is not null")
    known = calls.select("call_id").distinct()
    needs = calls.select("call_id", F.explode("needs").alias("need")).where("need is not null").distinct()
    edges = written(needs.join(known.withColumnRenamed("call_id", "need"), "need", "left_semi").select("call_id", "need"), "edges")
    degree = written(known.join(edges.groupBy("call_id").agg(F.count("*").alias("n")), "call_id", "left").select("call_id", F.coalesce("n", F.lit(0)).alias("n")), "degree")
    level = lambda value: F.lit(value).cast("long").alias("level")

    single = edges.join(degree.where("n = 1"), "call_id", "left_semi").withColumnRenamed("need", "to")
    open_ = degree.where("n = 1").select(F.col("call_id").alias("to"), F.lit(True).alias("open"))
    at = written(follow(single, "to", open_).select("call_id", "to", F.lit(1).cast("long").alias("level"), F.coalesce("open", F.lit(False)).alias("open")), "pointers")
    n, span = at.count(), 1
    while span < 2 * n and not at.where("open").isEmpty():
        far = at.select(F.col("call_id").alias("to"), F.col("to").alias("f_to"), F.col("level").alias("f_level"), F.col("open").alias("f_open"))
        moved = follow(at.where("open"), "to", far).select("call_id", F.col("f_to").alias("to"), (F.col("level") + F.col("f_level")).alias("level"), F.col("f_open").alias("open"))
        at, span = written(moved.union(at.where("not open")), "pointers"), 2 * span
    chains = at.where("not open").select("call_id", "to", F.col("level").alias("steps"))

    settled = degree.where("n = 0").select("call_id", level(0))
    several = edges.join(degree.where("n > 1"), "call_id", "left_semi")
    if not several.isEmpty():
        via = chains.withColumnsRenamed({"call_id": "need", "to": "end"})
        waiting = written(follow(several, "need", via).select("call_id", F.coalesce("end", "need").alias("end"), F.coalesce("steps", F.lit(0)).alias("steps")), "waiting")
        while True:
            met = follow(waiting, "end", settled.withColumnRenamed("call_id", "end"))
            ready = written(met.groupBy("call_id").agg(F.max(F.col("level") + F.col("steps") + 1).alias("level"), F.count_if(F.col("level").isNull()).alias("missing")).where("missing = 0").select("call_id", "level"), "ready")
            if ready.isEmpty():
                break
            settled = written(settled.union(ready), "settled")
            waiting = written(waiting.join(ready.select("call_id"), "call_id", "left_anti"), "waiting")
    ends = settled.withColumnRenamed("call_id", "to")
    chained = follow(chains, "to", ends).select("call_id", (F.col("level") + F.col("steps")).alias("level"))
    return known.join(settled.union(chained), "call_id", "left")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Calls (thread, call_id, needs: array, name, arguments) joined with results (call_id, content).

    Returns thread, call_id, name, level, place, status (linked, no_result, no_call), fault and record: canonical JSON of
    the linked pair. Within a thread, level and then place are a topological order; calls in a cycle, or that need one, have
    no level. Of an identifier that repeats, the n-th call meets the n-th result, so no identifier makes all pairs. A schema
    with keywords that are not supported is refused.
    """
    check = checker(schemas)
    columns = calls.withColumn("checked", check("name", "arguments")).select("thread", "call_id", "needs", "name", F.col("checked.fault").alias("fault"), F.col("checked.canonical").alias("arguments"))
    ordered = written(columns, "calls")
    level = written(levels(ordered), "levels")
    asked = written(numbered(ordered.drop("needs"), ["call_id"], ["call_id", "thread", "name", "arguments"], "nth"), "asked")
    answers = written(numbered(results.select("call_id", "content"), ["call_id"], ["call_id", "content"], "nth"), "answers").toDF("answer_id", "answer", "answer_nth")
    met = asked.join(answers, (F.col("call_id") == F.col("answer_id")) & (F.col("nth") == F.col("answer_nth")), "full")
    status = F.when(F.col("nth").isNull(), F.lit("no_call")).when(F.col("answer_nth").isNotNull(), F.lit("linked")).otherwise(F.lit("no_result"))
    shown = F.coalesce("call_id", "answer_id")
    rows = written(met.select("thread", shown.alias("call_id"), "name", status.alias("status"), "fault", record(shown, "name", "arguments", "answer").alias("record")), "linked")
    there = F.col("call_id").isNotNull() & (F.col("status") != "no_call")
    placed = follow(rows.where(there), "call_id", level).unionByName(rows.where(~there).withColumn("level", F.lit(None).cast("long")))
    return numbered(written(placed, "placed"), ["thread", "level"], ["call_id", "record"], "place").select("thread", "call_id", "name", "level", "status", "fault", "record", "place")


#: In the conversations, a turn that asks is a call of its speaker's tool, and the assistant's next turn is its result.
SCHEMAS = {
    "user": {"type": "object", "required": ["text", "words"], "properties": {"text": {"type": "string"}, "words": {"type": "integer", "minimum": 1}}, "additionalProperties": False},
    "system": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}, "words": {"type": "integer", "minimum": 1}}},
}


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that conversations imply.

    Turn t of conversation c, if its role is not assistant, is a call c:t of the tool named by the role, with the text and
    its number of words as arguments; it needs call c:(t - 2), if that is one. An assistant's turn t answers call c:(t - 1).
    """
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    earlier = lambda k: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - k).cast("string"))
    arguments = F.to_json(F.struct(F.col("text"), n_words(F.col("text")).alias("words")))
    calls = turns.where(~F.col("role").eqNullSafe("assistant")).select(F.col("conv_id").alias("thread"), name.alias("call_id"), F.array(F.when(F.col("turn") >= 2, earlier(2))).alias("needs"), F.col("role").alias("name"), arguments.alias("arguments"))
    results = turns.where(F.col("role") == "assistant").select(earlier(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def query(spark, sf_dir: str) -> DataFrame:
    found = link(*from_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")), SCHEMAS)
    return found.select(F.col("thread").alias("conv_id"), "call_id", "name", "level", "place", "status", "fault", F.sha2("record", 256).alias("record_sha256"))
