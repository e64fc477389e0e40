"""Source references and headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.gematria import value
from corpusloom.functions.text import none_if_empty, normalize_quotes, strip

ROOT = "אורח חיים"
NUMERAL = "[א-ת\"'׳״]+"


def _letters_value(text: Column) -> Column:
    return F.nullif(value(F.regexp_replace(text, "[\"'׳״]", "")), F.lit(0))


def _number(text: Column, pattern: str, group: int) -> Column:
    return none_if_empty(F.regexp_extract(text, pattern, group)).cast("int")


def section_of(reference: Column) -> Column:
    """The section that a reference names: (251, 2), סימן 128, סימן א, שמ"ה, סעיף ז' or תרמ"ג."""
    text = strip(normalize_quotes(reference))
    return F.coalesce(
        _number(text, r"^\(\s*(\d+)\s*,", 1),
        _number(text, r"סימן\s+(\d+)", 1),
        _letters_value(none_if_empty(F.regexp_extract(text, rf"סימן\s+({NUMERAL})", 1))),
        _letters_value(none_if_empty(F.regexp_extract(text, rf"^({NUMERAL})(?:,|$)", 1))),
    )


def paragraph_of(reference: Column) -> Column:
    """The paragraph that a reference names, from 1; null if none."""
    text = strip(normalize_quotes(reference))
    return F.coalesce(
        _number(text, r"^\(\s*\d+\s*,\s*(\d+)\s*\)", 1),
        _number(text, r"סעיף\s+(\d+)", 1),
        _letters_value(none_if_empty(F.regexp_extract(text, rf"סעיף\s+({NUMERAL})", 1))),
    )


def label(section: Column, paragraph: Column | None = None) -> Column:
    """סימן N, סעיף M; without a paragraph סימן N."""
    one = F.concat(F.lit("סימן "), section.cast("string"))
    return one if paragraph is None else F.concat(one, F.lit(", סעיף "), paragraph.cast("string"))


def passage_id(section: Column, paragraph: Column) -> Column:
    return F.concat(F.lit("siman_"), section.cast("string"), F.lit("_seif_"), paragraph.cast("string"))


#: Heading lines, as classes that Java's and RE2's expressions read alike.
DESCRIBED = r"^סימן\s+(\d+)\s*-\s*(.+?)\.?\s*ובו"
BARE = r"^סימן\s+(\d+)\s*-?\s*ובו"
GROUP = r"^הלכות\s"


def heading(line: Column) -> Column:
    """struct<section, title, group> of a heading line: a section's number and title (null without a description), or a group."""
    text = strip(line)
    title = F.rtrim(F.trim(F.regexp_extract(text, DESCRIBED, 2)), F.lit("."))
    return F.struct(
        none_if_empty(F.coalesce(none_if_empty(F.regexp_extract(text, DESCRIBED, 1)), F.regexp_extract(text, BARE, 1))).alias("section"),
        F.when(text.rlike(DESCRIBED), title).alias("title"),
        F.when(text.rlike(GROUP), text).alias("group"),
    )


def breadcrumb(group: Column, title: Column, root: str = ROOT) -> Column:
    """[group > title]; the title is left out if empty or like the group, and a missing group gives the root."""
    parts = F.concat_ws(" > ", none_if_empty(group), F.when(~title.eqNullSafe(group), none_if_empty(title)))
    return F.concat(F.lit("["), F.coalesce(none_if_empty(parts), F.lit(root)), F.lit("]"))
