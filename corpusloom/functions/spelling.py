"""Voweled Hebrew to full spelling: letters that vowel marks stand for are written out, then the marks go."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import LETTER, MARK

SHVA, HATAF_SEGOL, HATAF_PATAH, HATAF_QAMATS, HIRIQ, TSERE, SEGOL, PATAH, QAMATS, HOLAM, QUBUTS, DAGESH, QAMATS_QATAN = (
    "ְ", "ֱ", "ֲ", "ֳ", "ִ", "ֵ", "ֶ", "ַ", "ָ", "ֹ", "ֻ", "ּ", "ׇ",
)

# Words that stay as they are, letters that are prefixes, letters that carry a vowel without sound.
UNCHANGED = "לא הלא ולא שלא בלא דלא אלא כל וכל בכל לכל מכל שכל דכל ככל כך וכך לכך על של אל עד גם כן פן אם עם מן זה זו את".split()
DUALS = "מים שמים ירושלים מצרים".split()
PREFIXES = "בכלמשהוד"
SILENT = "אעה"
FUTURE = "תינ"
VAV_VOWELS = (QAMATS, PATAH, SHVA, HIRIQ, TSERE, SEGOL, HATAF_PATAH, HATAF_QAMATS, HATAF_SEGOL)


#: Hebrew words with their marks, and what lies between them; a letter with its vowel marks.
TOKEN = re.compile(f"[{LETTER}][{LETTER}{MARK}]*|[^{LETTER}]+")
MARKED_LETTER = re.compile(f"([{LETTER}])([ְ-ׇ]*)")
MARKS = re.compile(f"[{MARK}]")
NOTHING = ("", "")


def _spelled(letters: list[tuple[str, str]]) -> str:
    """Each letter with what its marks stand for; letters without marks, which are most, are passed on as they are."""
    n, out = len(letters), []
    for i, (ch, marks) in enumerate(letters):
        out.append(ch)
        if not marks:
            continue
        before, before_marks = letters[i - 1] if i else NOTHING
        after, after_marks = letters[i + 1] if i + 1 < n else NOTHING
        inner, silent = 0 < i < n - 1, after != "" and after in SILENT
        if after != "ו":
            if ch == "ו":
                out.append("ו" * (inner and before != "ו" and any(v in marks for v in VAV_VOWELS)))
            else:
                out.append("ו" * (QUBUTS in marks))
                out.append("ו" * (HOLAM in marks and not silent and not (i == 0 and ch in FUTURE and n >= 3 and after == "א")))
                out.append("ו" * (QAMATS_QATAN in marks))
                out.append("ו" * (QAMATS in marks and SHVA in after_marks and DAGESH not in marks and ch not in PREFIXES and not silent))
        if ch == "י":
            out.append("י" * (HIRIQ in marks and after in ("ם", "מ") and (PATAH in before_marks or QAMATS in before_marks)))
            earlier_prefixes = all(c in PREFIXES for c, _ in letters[:i])
            out.append("י" * (DAGESH in marks and inner and before != "י" and after not in ("י", "ו") and not earlier_prefixes))
        else:
            out.append("י" * (i > 0 and HIRIQ in marks and after != "י" and DAGESH in after_marks))
    return "".join(out)


@lru_cache(maxsize=100_000)
def full_word(word: str) -> str:
    """One Hebrew word in full spelling. Words that are spelled alike but read in two ways are told apart by their marks."""
    plain, letters = MARKS.sub("", word), MARKED_LETTER.findall(word)
    has = lambda i, *wanted: i < len(letters) and any(m in letters[i][1] for m in wanted)
    if plain in UNCHANGED or plain in DUALS:
        return plain
    if plain == "אחר" and has(1, PATAH):
        return "אחרי"
    if plain == "קדוש" and has(0, HIRIQ):
        return "קידוש"
    if plain == "אסור" and has(0, HIRIQ):
        return "איסור"
    if plain == "דין" and has(0, PATAH) and has(1, QAMATS, PATAH):
        return "דיין"
    return plain if plain in ("עולה", "מותר") else _spelled(letters)


def _token(found: re.Match) -> str:
    t = found[0]
    return t if not MARKS.search(t) else full_word(t) if "א" <= t[0] <= "ת" else MARKS.sub("", t)


def _full_spelling(texts: pa.Array) -> pa.Array:
    return pa.array([TOKEN.sub(_token, t or "") for t in texts.to_pylist()], pa.string())


def full_spelling(text: Column) -> Column:
    """A text in full spelling, word by word; a worker spells each of its latest words once."""
    return F.arrow_udf(_full_spelling, "string")(text)
