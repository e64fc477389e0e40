"""DuckDB SQL of the queries on Hebrew spelling, terms and glosses. Words and patterns are written out here, not taken from the functions."""

from __future__ import annotations

LATIN, HEBREW = "bcdfghjklmnpqrstvwxyzaeiou", "בגדפהחיכלמנסקרשתועצטז" + "\u05b8\u05b6\u05b4\u05b9\u05bb"
LINES = r"""l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS line_no FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS x FROM documents))"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Full spelling: letters of Hebrew words with their marks and their neighbours.

PREFIX = "('ב','כ','ל','מ','ש','ה','ו','ד')"
SPELLING = rf"""WITH {LINES}, t AS (SELECT doc_id, line_no, regexp_extract_all(translate(lower(line), '{LATIN}', '{HEBREW}'), '[א-ת][א-ת֑-ׇ]*|[^א-ת]+') AS ts FROM l),
w AS (SELECT doc_id, line_no, unnest(ts) AS tok, generate_subscripts(ts, 1) AS k FROM t),
x AS (SELECT doc_id, line_no, k, regexp_replace(tok, '[֑-ׇ]', '', 'g') AS plain, regexp_extract_all(tok, '[א-ת][ְ-ׇ]*') AS xs FROM w WHERE regexp_matches(tok, '^[א-ת]')),
y AS (SELECT doc_id, line_no, k, plain, len(xs) AS n, unnest(xs) AS z, generate_subscripts(xs, 1) AS i FROM x),
m AS (
  SELECT *, z[1] AS ch, substr(z, 2) AS mk, coalesce(lag(z[1]) OVER o, '') AS pc, coalesce(lag(substr(z, 2)) OVER o, '') AS pm, coalesce(lead(z[1]) OVER o, '') AS nc, coalesce(lead(substr(z, 2)) OVER o, '') AS nm,
         bool_and(z[1] IN {PREFIX}) OVER (PARTITION BY doc_id, line_no, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pre FROM y WINDOW o AS (PARTITION BY doc_id, line_no, k ORDER BY i)
), s AS (
  SELECT doc_id, line_no, k, i, plain, mk, ch
    || CASE WHEN ch = 'ו' AND i > 1 AND i < n AND regexp_matches(mk, '[{chr(0x5B0)}-{chr(0x5B8)}]') AND pc <> 'ו' AND nc <> 'ו' THEN 'ו' ELSE '' END
    || CASE WHEN contains(mk, '{chr(0x5BB)}') AND ch <> 'ו' AND nc <> 'ו' THEN 'ו' ELSE '' END
    || CASE WHEN contains(mk, '{chr(0x5B9)}') AND ch <> 'ו' AND nc NOT IN ('ו','א','ע','ה') AND NOT (i = 1 AND ch IN ('ת','י','נ') AND n >= 3 AND nc = 'א') THEN 'ו' ELSE '' END
    || CASE WHEN contains(mk, '{chr(0x5C7)}') AND ch <> 'ו' AND nc <> 'ו' THEN 'ו' ELSE '' END
    || CASE WHEN contains(mk, '{chr(0x5B8)}') AND contains(nm, '{chr(0x5B0)}') AND NOT contains(mk, '{chr(0x5BC)}') AND nc NOT IN ('ו','א','ע','ה') AND ch NOT IN {PREFIX} THEN 'ו' ELSE '' END
    || CASE WHEN ch = 'י' AND contains(mk, '{chr(0x5B4)}') AND nc IN ('ם','מ') AND regexp_matches(pm, '[{chr(0x5B7)}{chr(0x5B8)}]') THEN 'י' ELSE '' END
    || CASE WHEN ch = 'י' AND contains(mk, '{chr(0x5BC)}') AND i > 1 AND i < n AND pc <> 'י' AND nc NOT IN ('י','ו') AND NOT coalesce(pre, true) THEN 'י' ELSE '' END
    || CASE WHEN i > 1 AND contains(mk, '{chr(0x5B4)}') AND ch <> 'י' AND nc <> 'י' AND contains(nm, '{chr(0x5BC)}') THEN 'י' ELSE '' END AS o FROM m
), g AS (
  SELECT doc_id, line_no, k, any_value(plain) AS plain, string_agg(o, '' ORDER BY i) AS o, coalesce(string_agg(mk, '') FILTER (i = 1), '') AS m1, coalesce(string_agg(mk, '') FILTER (i = 2), '') AS m2 FROM s GROUP BY doc_id, line_no, k
), f AS (
  SELECT doc_id, line_no, k, CASE
    WHEN plain IN ('לא','הלא','ולא','שלא','בלא','דלא','אלא','כל','וכל','בכל','לכל','מכל','שכל','דכל','ככל','כך','וכך','לכך','על','של','אל','עד','גם','כן','פן','אם','עם','מן','זה','זו','את','מים','שמים','ירושלים','מצרים') THEN plain
    WHEN plain = 'אחר' AND contains(m2, '{chr(0x5B7)}') THEN 'אחרי' WHEN plain = 'קדוש' AND contains(m1, '{chr(0x5B4)}') THEN 'קידוש' WHEN plain = 'אסור' AND contains(m1, '{chr(0x5B4)}') THEN 'איסור'
    WHEN plain = 'דין' AND contains(m1, '{chr(0x5B7)}') AND regexp_matches(m2, '[{chr(0x5B7)}{chr(0x5B8)}]') THEN 'דיין' WHEN plain IN ('עולה','מותר') THEN plain ELSE o END AS o FROM g
)
SELECT l.doc_id, l.line_no, coalesce(string_agg(coalesce(f.o, regexp_replace(w.tok, '[֑-ׇ]', '', 'g')), '' ORDER BY w.k), '') AS line
FROM l LEFT JOIN w ON l.doc_id = w.doc_id AND l.line_no = w.line_no LEFT JOIN f ON f.doc_id = w.doc_id AND f.line_no = w.line_no AND f.k = w.k GROUP BY l.doc_id, l.line_no"""

# Terms. The rules that can fire on the words that the queries put in, in their order, as RE2 reads them: as it cannot look
# around, a pattern keeps what comes before in group 1 and what comes after in group 2, and runs twice.

B, A = "(^|[^א-ת])", "($|[^א-ת])"
STEM = "((?:^|[^א-ת])[ובלמשכהד]{0,3})"
STEPS = [
    ('stem הקב"ה', f'{STEM}הקב"ה{A}', "אלוהים"),
    ('stem עכו"ם', f'{STEM}עכו"ם{A}', "גוי"),
    ("stem כותי", f"{STEM}כותי{A}", "גוי"),
    ("stem נכרים", f"{STEM}נכרים{A}", "גוים"),
    ("reference 2", rf"{B}(?:ו?כד?לקמן|ו?כד?לעיל|ו?לקמן|ו?לעיל)\s+[^.,:;\n<]{{0,80}}[.,;:]?()", ""),
    ("reference 3", f"{B}(?:ו?כדלקמן|ו?כדלעיל){A}", ""),
    ("explained", "()פי'()", "פירוש"),
    ("explanation", rf"{B}פירוש\s*()", ""),
    ("drop סעיף", f"{STEM}סעיף{A}", ""),
    ("count ד'", r"()ד'(\s+אמות)", "ארבע"),
    ('book או"ח', f'{B}או"ח{A}', ""),
    ('short וה"ה', f'{B}וה"ה{A}', "והוא הדין"),
    ('short ה"ה', f'{B}ה"ה{A}', "הוא הדין"),
]
ALL_RULES = [
    'stem הקב"ה', 'stem השי"ת', "stem אלקים", "stem אלהים", 'stem עכו"ם', "stem כותי", "stem נכרי", "stem נכרים", "reference 0", "reference 1", "reference 2", "reference 3", "explained", "explanation", "drop סי'", "drop סעיף", "drop עיין",
    'drop עי"ש', 'drop וע"ש', "count ד'", "count ג'", "count ב'", 'book יו"ד', 'book חו"מ', 'book או"ח', 'book אה"ע', "book יורה דעה", "book חושן משפט", "book אורח חיים", "book אבן העזר", 'short וה"ה', 'short ה"ה', 'short נ"ל', 'short ג"ט', 'short ד"ט',
]
PUT_IN = (("the", 'הקב"ה'), ("of", "ה'"), ("in", "ד' אמות"), ("and", 'עכו"ם'), ("to", "סעיף ה'"), ("is", 'כדלעיל סימן מ"ו'), ("with", "לפי' כותי"), ("on", 'וה"ה או"ח'), ("de", "ונכרים"))
SIGN, KEPT = "\ue010", "\ue011"


def with_terms(line: str) -> str:
    for word, term in PUT_IN:
        line = f"replace({line}, ' {word} ', {quoted(f' {term} ')})"
    return line


def named(x: str) -> str:
    """The name in full, but after a paragraph's word, where it is a number."""
    kept = f"regexp_replace({x}, {quoted('סעיף( +)ה' + chr(39))}, {quoted('סעיף' + chr(92) + '1' + KEPT)}, 'g')"
    once = lambda y: f"regexp_replace({y}, {quoted(B + 'ה' + chr(39) + A)}, {quoted(chr(92) + '1אלוהים' + chr(92) + '2')}, 'g')"
    return f"replace({once(once(kept))}, '{KEPT}', {quoted('ה' + chr(39))})"


def chained() -> tuple[str, str]:
    """CTEs that apply STEPS in turn to x, with the counts c0, c1 and so on; and the last one's name."""
    ctes, held = [f"{LINES}, n AS (SELECT doc_id, line_no, {named(with_terms('line'))} AS x FROM l)"], "n"
    for k, (_, pattern, to) in enumerate(STEPS):
        once = lambda x, pattern=pattern: f"regexp_replace({x}, {quoted(pattern)}, '\\1{SIGN}\\2', 'g')"
        ctes.append(f"r{k} AS (SELECT * EXCLUDE x, {once(once('x'))} AS x FROM {held})")
        ctes.append(f"t{k} AS (SELECT * EXCLUDE x, length(x) - length(replace(x, '{SIGN}', '')) AS c{k}, replace(x, '{SIGN}', {quoted(to)}) AS x FROM r{k})")
        held = f"t{k}"
    return ",\n".join(ctes), held


def names(x: str) -> str:
    """How often the abbreviated name stands alone."""
    once = lambda y: f"regexp_replace({y}, {quoted(B + 'ה' + chr(39) + A)}, '\\1{SIGN}\\2', 'g')"
    return f"(length({once(once(x))}) - length(replace({once(once(x))}, '{SIGN}', '')))"


TERMS, LAST = chained()
UNIFIED = f"WITH {TERMS} SELECT doc_id, line_no, regexp_replace(regexp_replace(x, '  +', ' ', 'g'), '^ +| +$', '', 'g') AS line FROM {LAST}"
FIRED = " UNION ALL ".join(f"SELECT {quoted(rule)} AS rule, sum(c{k}) AS n FROM {LAST}" for k, (rule, _, _) in enumerate(STEPS))
FIRED += f" UNION ALL SELECT 'name', sum({names(with_terms('line'))} - {names(named(with_terms('line')))}) FROM l UNION ALL SELECT 'name kept', sum({names('x')}) FROM n"
FIRED += f" UNION ALL SELECT 'references', {' + '.join(f'sum(c{k})' for k, (rule, _, _) in enumerate(STEPS) if rule.startswith('reference'))} FROM {LAST}"
COUNTS = f"WITH {TERMS}, named AS (SELECT unnest([{', '.join(map(quoted, ['name', 'name kept', 'references', *ALL_RULES]))}]) AS rule), fired AS ({FIRED}) SELECT rule, coalesce(fired.n, 0)::BIGINT AS n FROM named LEFT JOIN fired USING (rule)"

ORACLES = {"full_spelling": SPELLING, "term_unification": UNIFIED, "rule_counters": COUNTS}
