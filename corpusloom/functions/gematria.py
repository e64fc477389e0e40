"""Numbers written in Hebrew letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import LETTER, MARK

# Letters, the words of numbers, and abbreviations that are never numbers. Final letters count 0.
VALUES = {c: v for c, v in zip("אבגדהוזחטיכלמנסעפצקרשת", [*range(1, 10), *range(10, 100, 10), 100, 200, 300, 400])} | dict.fromkeys("ךםןףץ", 0)
UNITS = "אחד שניים שלושה ארבעה חמישה שישה שבעה שמונה תשעה".split()
TEENS = ("עשרה", "אחד עשר", "שנים עשר", "שלושה עשר", "ארבעה עשר", "חמישה עשר", "שישה עשר", "שבעה עשר", "שמונה עשר", "תשעה עשר")
TENS = "עשר עשרים שלושים ארבעים חמישים ששים שבעים שמונים תשעים".split()
HUNDREDS = ("מאה", "מאתיים", "שלוש מאות", "ארבע מאות", "חמש מאות", "שש מאות", "שבע מאות", "שמונה מאות", "תשע מאות")
NEVER_NUMBERS = ('נ"ל', 'ה"ה', 'וה"ה', 'ד"מ', 'ר"ת', 'ש"ע', 'ש"ץ', 'נ"ך', 'ס"ת', 'ע"ב', 'ח"ל')
PREFIXES = "בכלמשהוד"
QAMATS = "ָ"


def letter_values(text: Column) -> Column:
    """The value of each character; 0 for what is no letter."""
    values = F.create_map(*(F.lit(x) for kv in VALUES.items() for x in kv))
    return F.transform(F.regexp_extract_all(text, F.lit("."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(values, c), F.lit(0)))


def value(text: Column) -> Column:
    """The sum of the letters' values."""
    return F.aggregate(letter_values(text), F.lit(0), lambda a, v: a + v)


def is_number(text: Column) -> Column:
    """One to five letters, none of value 0, each of less value than the one before."""
    v = letter_values(text)
    falls = lambda a: F.forall(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (F.get(a, i) > 0) & F.coalesce(F.get(a, i) > F.get(a, i + 1), F.lit(True)))
    return F.get(F.transform(F.array(v), lambda a: F.when(F.size(a).between(1, 5), falls(a)).otherwise(F.lit(False))), F.lit(0))


def number_words(n: Column) -> Column:
    """A number from 2 to 999 in words; null for others, and for hundreds with a rest of 1."""
    words = lambda items: F.array(*map(F.lit, items))
    rest, n = n % 100, n.cast("int")
    below = F.when(rest == 0, F.lit("")).when(rest == 1, F.lit(None)).when(rest < 10, F.get(words(UNITS), (rest - 1).cast("int"))).when(rest < 20, F.get(words(TEENS), (rest - 10).cast("int")))
    below = below.otherwise(F.concat_ws(" ", F.get(words(TENS), (F.floor(rest / 10) - 1).cast("int")), F.when(rest % 10 > 0, F.get(words(UNITS), (rest % 10 - 1).cast("int")))))
    hundreds = F.when(n >= 100, F.get(words(HUNDREDS), (F.floor(n / 100) - 1).cast("int")))
    return F.when(n.between(2, 999) & below.isNotNull(), F.concat_ws(" ", hundreds, F.nullif(below, F.lit(""))))


ABBREVIATION = f'[{LETTER}{MARK}]{{1,6}}"[{LETTER}{MARK}]{{1,3}}'
SPELLED = f"([{LETTER}])([{MARK}]*)"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _expanded(token: Column) -> Column:
    """The number in words, if the letters after a voweled prefix carry no marks and are a number from 2 to 99."""
    letters = F.zip_with(F.regexp_extract_all(token, F.lit(SPELLED), F.lit(1)), F.regexp_extract_all(token, F.lit(SPELLED), F.lit(2)), lambda c, m: F.struct(c.alias("c"), m.alias("m")))
    text = lambda part: F.array_join(F.transform(part, lambda x: x["c"]), "")

    def split(x: Column) -> Column:
        is_prefix = lambda y: (y["m"] != "") & y["c"].isin(*PREFIXES)
        k = F.size(F.filter(x, lambda _, i: F.forall(F.slice(x, F.lit(1), i + 1), is_prefix)))
        return F.struct(F.slice(x, F.lit(1), k).alias("prefix"), F.slice(x, k + 1, F.size(x)).alias("core"))

    def written(x: Column) -> Column:
        noun = F.exists(x["prefix"], lambda y: (y["c"] == "ו") & y["m"].contains(QAMATS))
        named = F.exists(x["core"], lambda y: y["m"] != "")
        n = value(text(x["core"]))
        return F.when(~noun & ~named & is_number(text(x["core"])) & n.between(2, 99), F.concat(text(x["prefix"]), number_words(n))).otherwise(token)

    return F.when(F.regexp_replace(token, f"[{MARK}]", "").isin(*NEVER_NUMBERS), token).otherwise(_let(_let(letters, split), written))


def expand_numbers(text: Column) -> Column:
    """Abbreviated numbers of a voweled text in words; which abbreviations are numbers depends on their marks."""

    def joined(x: Column) -> Column:
        rest = F.transform(x["found"], lambda m, i: F.concat(_expanded(m), F.get(x["gaps"], i + 1)))
        return F.concat(F.get(x["gaps"], F.lit(0)), F.array_join(rest, ""))

    both = F.struct(F.regexp_extract_all(text, F.lit(ABBREVIATION), F.lit(0)).alias("found"), F.split(text, ABBREVIATION, -1).alias("gaps"))
    return F.when(text.rlike(ABBREVIATION), _let(both, joined)).otherwise(text)
