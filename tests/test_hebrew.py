"""Spelling, terms, numerals, references and headings, on fixed examples."""

from pyspark.sql import functions as F

from corpusloom.functions import gematria, refs, spelling, terms
from corpusloom.functions import text as T
from corpusloom.operators.enrich import enriched, heading_map, with_breadcrumb, without_heading
from corpusloom.operators.lines import explode_lines

# Fixed examples: voweled text and its full spelling.
SPELLINGS = [
    ("יִתְגַּבֵּר כַּאֲרִי לַעֲמֹד בַּבֹּקֶר", "יתגבר כארי לעמוד בבוקר"),
    ("חָכְמָה", "חוכמה"),
    ("קָרְבָּן", "קורבן"),
    ("אָמְנָם", "אומנם"),
    ("מִצְוָה", "מצווה"),
    ("תִּקְוָה", "תקווה"),
    ("עֵינַיִם", "עיניים"),
    ("רַגְלַיִם", "רגליים"),
    ("יָדַיִם", "ידיים"),
    ("אָזְנַיִם", "אוזניים"),
    ("מַיִם", "מים"),
    ("שָׁמַיִם", "שמים"),
    ("יְרוּשָׁלַיִם", "ירושלים"),
    ("מִצְרַיִם", "מצרים"),
    ('עַכּוּ"ם', 'עכו"ם'),
    ('רַמְבַּ"ם', 'רמב"ם'),
    ("ה'", "ה'"),
    ("בָּרְכוּ", "ברכו"),
    ("הָרְצוּעוֹת", "הרצועות"),
    ("אַחַר", "אחרי"),
    ("אַחֵר", "אחר"),
    ("קִדּוּשׁ", "קידוש"),
    ("קָדוֹשׁ", "קדוש"),
    ("אִסּוּר", "איסור"),
    ("אָסוּר", "אסור"),
    ("שְׁנַיִם", "שניים"),
    ("שָׁנִים", "שנים"),
    ("תְּפִלָּה", "תפילה"),
    ("אֲפִלּוּ", "אפילו"),
    ("תְּפִלִּין", "תפילין"),
    ("חַיָּב", "חייב"),
    ("נִתְפָּרְקוּ", "נתפרקו"),
    ("גָּזְרוּ", "גזרו"),
    ("בַּיּוֹם", "ביום"),
    ("הַיּוֹם", "היום"),
]

# Fixed examples: text and its unified form.
TERMS = [
    ('שהרי הקב"ה מקדים לברך', "שהרי אלוהים מקדים לברך"),
    ('הבורא יתברך השי"ת ברא', "הבורא יתברך אלוהים ברא"),
    ('להקב"ה אין גבול', "לאלוהים אין גבול"),
    ("חייב לברך את ה' אלהינו", "חייב לברך את אלוהים אלהינו"),
    ("סעיף ה' מסכם", "ה' מסכם"),
    ("ה' טפחים", "ה' טפחים"),
    ("ברוך ה'", "ברוך אלוהים"),
    ('עכו"ם שבא לבית', "גוי שבא לבית"),
    ('העכו"ם מחמתו', "הגוי מחמתו"),
    ('ולעכו"ם לא נותנים', "ולגוי לא נותנים"),
    ("כותי אחד ונכרי אחר", "גוי אחד וגוי אחר"),
    ('<small> וע"ל מ"ז י"ג. </small>', ""),
    ('טקסט לפני <small> ע"ל סימן ל"ג. </small> אחרי', "טקסט לפני אחרי"),
    ('טקסט ועיין בסימן מ"ז.', "טקסט"),
    ('כדלקמן סימן רט"ו', ""),
    ('ברכות שמברך קודם נטילה כדלעיל סימן מ"ו.', "ברכות שמברך קודם נטילה"),
    ("ביקר לעיל סימן י\"א ב'. טקסט.", "ביקר טקסט."),
    ('אמר לקמן סימן כ"ה י"ב.', "אמר"),
    ("(פי' מקום שיכולים לראות)", "(מקום שיכולים לראות)"),
    ("(פירוש תלמידים)", "(תלמידים)"),
    ("רבנו תם פי' שהוא כעין עטרה", "רבנו תם שהוא כעין עטרה"),
    ("דברי עצמו לפי' הטור", "דברי עצמו לפירוש הטור"),
    ("ד' אמות", "ארבע אמות"),
    ("ג' פעמים", "שלוש פעמים"),
    ("ב' כוסות", "שתי כוסות"),
    ("ד' על ד' טפחים", "ד' על ארבע טפחים"),
]


def apply(spark, pairs, function):
    df = spark.createDataFrame([(i, a) for i, (a, *_) in enumerate(pairs)], "i int, a string").coalesce(1)
    return [r[0] for r in df.select("i", function(F.col("a")).alias("x")).orderBy("i").select("x").collect()]


def test_full_spelling(spark):
    assert apply(spark, SPELLINGS, spelling.full_spelling) == [b for _, b in SPELLINGS]


def test_terms(spark):
    assert [x.strip() for x in apply(spark, TERMS, terms.unify_terms)] == [b for _, b in TERMS]


def test_rule_counts_follow_the_rewrites(spark):
    found = apply(spark, [('הקב"ה הקב"ה',), ("ד' אמות",)], terms.rule_counts)
    assert {r["rule"]: r["n"] for r in found[0]}['stem הקב"ה'] == 2
    assert {r["rule"]: r["n"] for r in found[1]}["count ד'"] == 1
    lines = [("אמר ה' לו סעיף ה' וגם ה' אמות",), ('טקסט ועיין בסימן מ"ז. <small> וע"ל מ"ז י"ג. </small> סוף כדלקמן סוף',), (None,)]
    found = [{r["rule"]: r["n"] for r in x} for x in apply(spark, lines, terms.rule_counts)]
    assert (found[0]["name"], found[0]["name kept"]) == (1, 2) and found[1]["references"] == sum(found[1][f"reference {k}"] for k in range(4)) == 3
    assert set(found[2].values()) == {0}


def test_whole_words_are_dropped(spark):
    texts = [('דבר עי"ש סוף',), ('דבר וע"ש סוף',), ('דבר ועי"ש סוף',), ('עי"שב',)]
    assert apply(spark, texts, terms.unify_terms) == ["דבר סוף", "דבר סוף", 'דבר ועי"ש סוף', 'עי"שב']
    assert [{r["rule"]: r["n"] for r in x}['drop עי"ש'] for x in apply(spark, texts, terms.rule_counts)] == [1, 0, 0, 0]


def test_marks(spark):
    assert apply(spark, [("שָׁ֑מַיִם",), ("",), (None,)], T.strip_marks) == ["שמים", "", None]


def words_of_number(n: int) -> str | None:
    """number_words for one number."""
    if not 2 <= n <= 999 or n % 100 == 1:
        return None
    rest = n % 100
    parts = [gematria.HUNDREDS[n // 100 - 1]] if n >= 100 else []
    if 10 <= rest < 20:
        parts.append(gematria.TEENS[rest - 10])
    else:
        parts += [gematria.TENS[rest // 10 - 1]] * (rest >= 20) + [gematria.UNITS[rest % 10 - 1]] * (rest % 10 > 0)
    return " ".join(parts)


def test_numerals(spark):
    rows = [("תרמ", 640), ("יה", 15), ("ם", 0), ("", 0)]
    assert apply(spark, rows, gematria.value) == [b for _, b in rows]
    assert apply(spark, [("תרמג",), ("גא",), ("אא",), ("אג",), ("",), ("תשרקצפ",), ("כם",)], gematria.is_number) == [True, True, False, False, False, False, False]
    numbers = spark.range(0, 1101).select("id", gematria.number_words(F.col("id")).alias("w")).collect()
    assert all(r["w"] == words_of_number(r["id"]) for r in numbers)
    assert words_of_number(101) is None and words_of_number(215) == "מאתיים חמישה עשר"


def test_expand_numbers(spark):
    pairs = [('דף י"ב סוף', "דף שנים עשר סוף"), ('לְי"ב', "לשנים עשר"), ('ר"ת', 'ר"ת'), ('רַשִׁ"י', 'רַשִׁ"י'), ('וָי"ו', 'וָי"ו'), ('ק"ה', 'ק"ה'), (None, None)]
    assert apply(spark, pairs, gematria.expand_numbers) == [b for _, b in pairs]


def test_references(spark):
    rows = [("(251, 2)", 251, 2), ("סימן 128", 128, None), ("סימן א, סעיף א", 1, 1), ('שמ"ה, סעיף ז\'', 345, 7), ("תרמ״ג", 643, None), ("", None, None)]
    assert apply(spark, rows, refs.section_of) == [r[1] for r in rows]
    assert apply(spark, rows, refs.paragraph_of) == [r[2] for r in rows]


HEADINGS = """שולחן ערוך, אורח חיים

הלכות הנהגת אדם בבוקר
סימן 1 - דין השכמת הבוקר. ובו 9 סעיפים:
סימן 2 - דיני לבישת הבגדים. ובו 6 סעיפים:

הלכות ציצית
סימן 8 - דין לבישת ציצית. ובו 17 סעיפים:

הלכות יום הכיפורים
סימן 625 - ובו סעיף אחד:
סימן 626 ובו סעיף אחד:
"""


def test_headings_and_breadcrumbs(spark):
    lines = explode_lines(spark.createDataFrame([(0, HEADINGS)], "doc_id int, text string"))
    found = heading_map(lines)
    assert {(r["section"], r["group"], r["title"]) for r in found.collect()} == {
        ("1", "הלכות הנהגת אדם בבוקר", "דין השכמת הבוקר"),
        ("2", "הלכות הנהגת אדם בבוקר", "דיני לבישת הבגדים"),
        ("8", "הלכות ציצית", "דין לבישת ציצית"),
        ("625", "הלכות יום הכיפורים", ""),
        ("626", "הלכות יום הכיפורים", "הלכות יום הכיפורים"),
    }
    sections = spark.createDataFrame([(1, "old"), (625, "old"), (626, "old"), (999, "old")], "section int, title string")
    crumbs = {r["section"]: (r["title"], r["breadcrumb"]) for r in with_breadcrumb(enriched(sections, found), refs.ROOT).collect()}
    assert crumbs == {1: ("דין השכמת הבוקר", "[הלכות הנהגת אדם בבוקר > דין השכמת הבוקר]"), 625: ("", "[הלכות יום הכיפורים]"), 626: ("", "[הלכות יום הכיפורים]"), 999: ("", "[אורח חיים]")}
    assert [r["section"] for r in without_heading(sections, found).collect()] == [999]


def test_spelling_folds_no_letters_in_the_plan(spark):
    df = spark.createDataFrame([("יִתְגַּבֵּר כַּאֲרִי",), (None,)], "a string").select(spelling.full_spelling(F.col("a")).alias("x"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and [r["x"] for r in df.collect()] == ["יתגבר כארי", ""]
