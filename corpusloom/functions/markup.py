"""Nested small marks: author's text at depth 0, glosses at depth 1, citations below.

A line is split into its tags and what lies between them. Where a rule depends on depth, the tokens are folded once, with
the depth in the fold's state, so that no tree is built.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import LETTER, MARK, none_if_empty, normalize_whitespace, squeeze_spaces, strip

OPEN, CLOSE = "<small>", "</small>"
GLOSS = "הגה"


def tokens(line: Column) -> Column:
    """The tags of a line and the texts between them, in order."""
    return F.filter(F.split(line, f"(?={OPEN})|(?<={OPEN})|(?={CLOSE})|(?<={CLOSE})"), lambda t: t != "")


def balanced(line: Column) -> Column:
    return F.regexp_count(line, F.lit(OPEN)) == F.regexp_count(line, F.lit(CLOSE))


def depth_texts(line: Column) -> Column:
    """array<struct<depth, text>> of a line's texts; a closing tag without an opening one counts for nothing."""
    state = "struct<depth:int,out:array<struct<depth:int,text:string>>>"

    def step(acc: Column, t: Column) -> Column:
        depth, out = acc["depth"], acc["out"]
        moved = F.when(t == OPEN, depth + 1).when(t == CLOSE, F.greatest(depth - 1, F.lit(0))).otherwise(depth)
        grown = F.when(t.isin(OPEN, CLOSE), out).otherwise(F.array_append(out, F.struct(depth.alias("depth"), t.alias("text"))))
        return F.struct(moved.alias("depth"), grown.alias("out")).cast(state)

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<struct<depth:int,text:string>>").alias("out")).cast(state)
    return F.aggregate(tokens(F.coalesce(line, F.lit(""))), start, step)["out"]


def is_citation(content: Column) -> Column:
    """Whether a text below depth 1 is a citation: empty, a few signs, or with parentheses; an explanation in parentheses is not."""
    s = strip(content)
    return (
        F.when(s == "", True)
        .when(s.rlike(r"^\(\s*(פי'|פירוש)\s*"), False)
        .when((F.length(s) <= 2) & ~s.rlike(f"[{LETTER}]"), True)
        .otherwise(s.contains("(") | s.contains(")"))
    )


def split_gloss(line: Column) -> Column:
    """struct<text, gloss> of a line; null where nothing is left.

    Depth 0 is the author's. A text at depth 1 that begins like a gloss opens one, and later texts at depth 1 belong to it
    until Hebrew text returns at depth 0. Deeper texts are left out.
    """
    state = "struct<open:boolean,text:string,gloss:string>"

    def step(acc: Column, x: Column) -> Column:
        begins = strip(x["text"]).startswith(GLOSS)
        at1 = x["depth"] == 1
        opened = F.when(at1 & begins, True).when((x["depth"] == 0) & x["text"].rlike(f"[{LETTER}]"), False).otherwise(acc["open"])
        text = F.when(x["depth"] == 0, F.concat(acc["text"], x["text"])).otherwise(acc["text"])
        gloss = F.when(at1 & (begins | acc["open"]), F.concat(acc["gloss"], x["text"])).otherwise(acc["gloss"])
        return F.struct(opened.alias("open"), text.alias("text"), gloss.alias("gloss")).cast(state)

    start = F.struct(F.lit(False).alias("open"), F.lit("").alias("text"), F.lit("").alias("gloss")).cast(state)

    def finish(acc: Column) -> Column:
        text = F.regexp_replace(normalize_whitespace(acc["text"]), "^[: ]+|[: ]+$", "")
        gloss = strip(F.regexp_replace(normalize_whitespace(acc["gloss"]), rf"(?<![{LETTER}]){GLOSS}\s*:\s*", ""))
        return F.struct(none_if_empty(text).alias("text"), none_if_empty(gloss).alias("gloss"))

    return F.aggregate(depth_texts(line), start, step, finish)


AUDIT = "array<struct<action:string,depth:int,content:string>>"
NESTED = pa.struct([("line", pa.string()), ("audit", pa.list_(pa.struct([("action", pa.string()), ("depth", pa.int32()), ("content", pa.string())])))])
KEPT = pa.struct([("line", pa.string()), ("dropped", pa.int32())])

#: The classes of functions.text as Python's expressions read them.
SPACE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES, SQUEEZED, TAG = re.compile(f"[{SPACE}]+"), re.compile("  +"), re.compile("(</?small>)")
EXPLAINED, HEBREW, MARKS = re.compile(r"\(\s*(פי'|פירוש)\s*", re.ASCII), re.compile(f"[{LETTER}]"), re.compile(f"[{MARK}]")


def _plain(block: str) -> str:
    return SPACES.sub(" ", TAG.sub("", block)).strip(" ")


def _is_citation(s: str) -> bool:
    """is_citation for a text with single spaces."""
    return s == "" or not EXPLAINED.match(s) and (len(s) <= 2 and not HEBREW.search(s) or "(" in s or ")" in s)


def _nested(line: str) -> dict:
    stack, audit, parts = [""], [], TAG.split(line)
    depth = 0
    for t in parts:
        depth += (t == OPEN) - (t == CLOSE and depth > 0)
    for t in [*parts, *[CLOSE] * depth]:
        if t == OPEN:
            stack.append("")
        elif t != CLOSE:
            stack[-1] += t
        elif len(stack) > 1:  # else it closes nothing
            inner = stack.pop()
            if len(stack) > 1:
                content = _plain(inner)
                drop = _is_citation(content)
                audit.append({"action": "DROP" if drop else "KEEP", "depth": len(stack), "content": content})
                if drop:
                    continue
            stack[-1] += OPEN + inner + CLOSE
    return {"line": SQUEEZED.sub(" ", stack[0]), "audit": audit}


def _nested_citations(lines: pa.Array) -> pa.Array:
    return pa.array([_nested(x or "") for x in lines.to_pylist()], NESTED)


def nested_citations(line: Column) -> Column:
    """struct<line, audit>: without the blocks at depth 2 and below that are citations, inner ones first, and what became of each.

    The tokens are folded once with a stack of the texts of the open blocks, so a nest may have any depth. A block is judged
    at its closing tag, by what is left of it, and goes to the block around it or out. The outermost block of a nest is never
    taken out. Closing tags that close nothing are left out, and missing ones are added at the end. audit has action (DROP or
    KEEP), depth and content of each block that was judged, in the order of closing tags.
    """
    return F.arrow_udf(_nested_citations, f"struct<line:string,audit:{AUDIT}>")(line)


def drop_nested_citations(line: Column) -> Column:
    """Without the blocks at depth 2 and below that are citations."""
    return nested_citations(line)["line"]


def _glosses(line: str) -> dict:
    depth, opened, out, block, dropped = 0, False, [], [], 0

    def judge() -> None:
        nonlocal opened, dropped
        text = "".join(block)
        plain = _plain(MARKS.sub("", TAG.sub("", text)))
        if plain.startswith(GLOSS) or opened and plain != "":
            out.append(text)
        else:
            dropped += 1
        opened = opened or plain.startswith(GLOSS)

    for t in TAG.split(line):
        if depth == 0 and t != OPEN:
            out.append(t)
            if t != CLOSE and HEBREW.search(t):
                opened = False
            continue
        block.append(t)
        depth += (t == OPEN) - (t == CLOSE)
        if depth == 0:
            judge()
            block = []
    if block:
        judge()
    return {"line": SQUEEZED.sub(" ", "".join(out)), "dropped": dropped}


def _keep_glosses(lines: pa.Array) -> pa.Array:
    return pa.array([_glosses(x or "") for x in lines.to_pylist()], KEPT)


def keep_glosses(line: Column) -> Column:
    """struct<line, dropped>: without the blocks at depth 1 that are neither glosses nor continue one, and how many went."""
    return F.arrow_udf(_keep_glosses, "struct<line:string,dropped:int>")(line)


def close_parentheses(line: Column) -> Column:
    """A line whose texts at depth 2 and below open more parentheses than they close gets the missing ones after the last such text."""
    state = "struct<depth:int,balance:int,head:string,tail:string,deep:boolean>"

    def step(acc: Column, t: Column) -> Column:
        depth = F.when(t == OPEN, acc["depth"] + 1).when(t == CLOSE, acc["depth"] - 1).otherwise(acc["depth"])
        deep = ~t.isin(OPEN, CLOSE) & (acc["depth"] >= 2) & (strip(t) != "")
        count = F.regexp_count(t, F.lit(r"\(")) - F.regexp_count(t, F.lit(r"\)"))
        return F.struct(
            depth.alias("depth"),
            (acc["balance"] + F.when(deep, count).otherwise(0)).alias("balance"),
            F.when(deep, F.concat(acc["head"], acc["tail"], t)).otherwise(acc["head"]).alias("head"),
            F.when(deep, F.lit("")).otherwise(F.concat(acc["tail"], t)).alias("tail"),
            (acc["deep"] | deep).alias("deep"),
        ).cast(state)

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("balance"), F.lit("").alias("head"), F.lit("").alias("tail"), F.lit(False).alias("deep")).cast(state)
    mended = lambda acc: F.concat(F.regexp_replace(acc["head"], r"\s+$", ""), F.repeat(F.lit(")"), F.greatest(acc["balance"], F.lit(0))), acc["tail"])
    return F.aggregate(tokens(F.coalesce(line, F.lit(""))), start, step, lambda acc: F.when(acc["deep"] & (acc["balance"] > 0), mended(acc)).otherwise(F.coalesce(line, F.lit(""))))
