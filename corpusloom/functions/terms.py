"""Terms: names and abbreviations that mean the same are written alike, and references are taken out. The order matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import LETTER, squeeze_spaces

NB, NA = f"(?<![{LETTER}])", f"(?![{LETTER}])"
PREFIX = "([ובלמשכהד]{0,3})"
NAME = "אלוהים"
HELD = ""

# The words around an abbreviated name that make it a number, the terms and their replacements.
NUMBER_AFTER = "סעיף סעיפים פרק פרקים פ' פ\"ק סימן סימנים כמנין מנין סי' הלכה הלכות ביום יום באות אות דף שער שורה עמוד כלל".split()
NUMBER_BEFORE = "טפחים אמות מילין פרסאות שנים שנה ימים חדשים שבועות שעות דקות טפחים, אמות, ימים, שנים,".split()
STEMS = (('הקב"ה', NAME), ('השי"ת', NAME), ("אלקים", NAME), ("אלהים", NAME), ('עכו"ם', "גוי"), ("כותי", "גוי"), ("נכרי", "גוי"), ("נכרים", "גוים"))
SEE = 'ו?כד?לקמן|ו?כד?לעיל|ו?לקמן|ו?לעיל'
REFERENCES = (
    rf"<small>\s*(?:ו?עיין|ו?ע\"ל|ע\"ל|{SEE})\s*[^<]*?</small>",
    rf"{NB}(?:ו?עיין|ו?ע\"ל)\s+[^.:\n<]{{1,80}}[.:]?",
    rf"{NB}(?:{SEE})\s+[^.,:;\n<]{{0,80}}[.,;:]?",
    rf"{NB}(?:ו?כדלקמן|ו?כדלעיל){NA}",
)
DELETED_STEMS = ("סי'", "סעיף", "עיין")
DELETED_WORDS = ('עי"ש', 'וע"ש')
MEASURES = "אמות טפחים כוסות מינים כנפות פרסאות מילין ציציות ברכות פעמים שעות ימים חדשים שבועות אצבעות זיתים ביצים גריסין רביעיות".split()
COUNTS = (("ד'", "ארבע"), ("ג'", "שלוש"), ("ב'", "שתי"))
BOOKS = ('יו"ד', 'חו"מ', 'או"ח', 'אה"ע', "יורה דעה", "חושן משפט", "אורח חיים", "אבן העזר")
ABBREVIATIONS = (('וה"ה', "והוא הדין"), ('ה"ה', "הוא הדין"), ('נ"ל', "הנזכר לעיל"), ('ג"ט', "שלושה טפחים"), ('ד"ט', "ארבעה טפחים"))


def _once(value: Column, body) -> Column:
    """body(value), with value computed once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _where(text: Column, signs: tuple[str, ...], change) -> Column:
    """change(text) where the text has one of the signs, which are far cheaper to look for than the pattern of a change."""

    def of(t: Column) -> Column:
        there = t.contains(signs[0])
        for sign in signs[1:]:
            there = there | t.contains(sign)
        return F.when(there, change(t)).otherwise(t)

    return _once(text, of)


def name_in_context(text: Column) -> Column:
    """The abbreviated name in full, unless a word before or after it makes it a number."""
    after, before = "|".join(NUMBER_BEFORE), "|".join(NUMBER_AFTER)

    def named(t: Column) -> Column:
        held = F.regexp_replace(t, rf"{NB}ה'{NA}(?!\s*(?:{after})(?:\s|$))", HELD)
        kept = F.regexp_replace(held, rf"((?:^|\s)(?:{before})\s+){HELD}", "$1ה'")
        return F.replace(kept, F.lit(HELD), F.lit(NAME))

    return _where(text, ("ה'",), named)


def rules() -> list[tuple[str, str, str, tuple[str, ...]]]:
    """(rule, pattern, replacement, signs) after the name, in order; a text without any of the signs does not match."""
    out = [(f"stem {stem}", f"{NB}{PREFIX}{stem}{NA}", f"$1{to}", (stem,)) for stem, to in STEMS]
    out += [(f"reference {k}", pattern, "", ("עיין", 'ע"ל', "לקמן", "לעיל")) for k, pattern in enumerate(REFERENCES)]
    out += [("explained", "פי'", "פירוש", ("פי'",)), ("explanation", rf"{NB}פירוש\s*", "", ("פירוש",))]
    out += [(f"drop {stem}", f"{NB}{PREFIX}{stem}{NA}", "", (stem,)) for stem in DELETED_STEMS]
    out += [(f"drop {word}", f"{NB}{word}{NA}", "", (word,)) for word in DELETED_WORDS]
    out += [(f"count {sign}", rf"{sign}(?=\s+(?:{'|'.join(MEASURES)}))", word, (sign,)) for sign, word in COUNTS]
    out += [(f"book {book}", f"{NB}{book}{NA}", "", (book,)) for book in BOOKS]
    out += [(f"short {short}", f"{NB}{short}{NA}", full, (short,)) for short, full in ABBREVIATIONS]
    return out


def unify_terms(text: Column) -> Column:
    out = name_in_context(F.coalesce(text, F.lit("")))
    for _, pattern, to, signs in rules():
        out = _where(out, signs, lambda t, pattern=pattern, to=to: F.regexp_replace(t, pattern, to))
    return F.regexp_replace(squeeze_spaces(out), r"(?m)^ +| +$", "")


def rule_counts(text: Column) -> Column:
    """array<struct<rule, n>>: how often each rule fires in a text, one after another. The rules are data here, so the expression stays small.

    First how often the name is written in full, and how often it stays as a number; last, references of all kinds together.
    """
    kind = "struct<rule:string,pattern:string,to:string,signs:array<string>>"
    given = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(pattern).alias("pattern"), F.lit(to).alias("to"), F.array(*map(F.lit, signs)).alias("signs")).cast(kind) for name, pattern, to, signs in rules()))
    state = "struct<text:string,counts:array<struct<rule:string,n:bigint>>>"

    def step(acc: Column, r: Column) -> Column:
        there = F.exists(r["signs"], lambda sign: F.contains(acc["text"], sign))
        n = F.when(there, F.regexp_count(acc["text"], r["pattern"])).otherwise(F.lit(0)).cast("long")
        changed = F.when(there, F.regexp_replace(acc["text"], r["pattern"], r["to"])).otherwise(acc["text"])
        return F.struct(changed.alias("text"), F.array_append(acc["counts"], F.struct(r["rule"].alias("rule"), n.alias("n"))).alias("counts")).cast(state)

    once = rf"{NB}ה'{NA}"
    count = lambda rule, n: F.struct(F.lit(rule).alias("rule"), n.cast("long").alias("n"))

    def begun(t: Column) -> Column:
        named = name_in_context(t)
        kept = F.regexp_count(named, F.lit(once))
        return F.struct(named.alias("text"), F.array(count("name", F.regexp_count(t, F.lit(once)) - kept), count("name kept", kept)).alias("counts")).cast(state)

    counts = F.aggregate(given, _once(F.coalesce(text, F.lit("")), begun), step)["counts"]
    referred = lambda x: F.aggregate(F.filter(x, lambda r: r["rule"].startswith("reference ")), F.lit(0).cast("long"), lambda n, r: n + r["n"])
    return _once(counts, lambda x: F.array_append(x, count("references", referred(x))))
