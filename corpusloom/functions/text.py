"""Cleaning and counting of plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, as a class that Java's and RE2's expressions read alike.
WS = r"\t\n\x0b\f\r\x1c-\x20\x85\p{Z}"
#: Hebrew letters, and the marks above and below them.
LETTER, MARK = "א-ת", "֑-ׇ"


def strip_marks(text: Column) -> Column:
    """Without vowel and cantillation marks; the joining stroke goes too, so words that it joins become one."""
    return F.regexp_replace(text, f"[{MARK}]", "")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")


def squeeze_spaces(text: Column) -> Column:
    return F.regexp_replace(text, "  +", " ")


def normalize_whitespace(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def tidy_line(line: Column) -> Column:
    """Runs of spaces as one, no white space at the end; a blank line becomes empty."""
    return F.regexp_replace(squeeze_spaces(line), f"[{WS}]+$", "")


def words(text: Column) -> Column:
    """The words between white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WS}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def remove_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def normalize_quotes(text: Column) -> Column:
    """The Hebrew apostrophe and quotation mark as ASCII ones."""
    return F.translate(text, "׳״", "'\"")


def remove_short_parentheses(text: Column, max_len: int = 25) -> Column:
    """Without parentheses that hold at most max_len characters, as citations do."""
    return F.regexp_replace(text, rf"\([^()]{{0,{max_len}}}\)", "")


def final_cleanup(text: Column) -> Column:
    """After all other rules: empty or letterless small marks, space before punctuation, repeated punctuation, spaces."""
    out = F.regexp_replace(text, rf"<small>\s*[^<{LETTER}]{{0,5}}\s*</small>", "")
    out = F.regexp_replace(out, r"<small>\s*</small>", "")
    out = F.regexp_replace(out, r" +([.,:;])", "$1")
    for sign in ".,:;":
        out = F.regexp_replace(out, rf"[{sign}]{{2,}}", sign)
    return strip(squeeze_spaces(out))


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def join_fields(*fields: Column, separator: str = " ") -> Column:
    """Fields joined by a separator; null and empty ones are skipped; '' if there is none."""
    return F.concat_ws(separator, *map(none_if_empty, fields))


def encoding_text(prefix: Column, text: Column, summary: Column, questions: Column) -> Column:
    """What an encoder reads of a paragraph: prefix, text, summary and questions."""
    return join_fields(prefix, text, summary, F.array_join(questions, " "))


def context_prefix(book: str, section: Column, paragraph: Column) -> Column:
    return F.concat(F.lit(f"{book}, Siman "), section.cast("string"), F.lit(", Seif "), paragraph.cast("string"), F.lit(":"))


def truncated(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def file_name(text: Column) -> Column:
    return F.replace(text, F.lit("/"), F.lit("_"))
