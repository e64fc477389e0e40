"""DuckDB SQL of the queries, where SQL can express them."""

from __future__ import annotations

from corpusloom.functions.text import WS

#: The class of white space for regular expressions in SQL strings.
S = WS
STRIP = lambda x: f"regexp_replace({x}, '^[{S}]+|[{S}]+$', '', 'g')"
WORDS = lambda x: f"list_filter(regexp_split_to_array({x}, '[{S}]+'), lambda w: w <> '')"
LATIN, HEBREW = "bcdfghjklmnpqrstvwxyzaeiou", "בגדפהחיכלמנסקרשתועצטז" + "ִֶָֹֻ"

LINES = r"""l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS line_no FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS x FROM documents))"""
ONE = f"{LINES}, one AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS line_no, line FROM l)"
PARAGRAPHS = f"""{LINES}, p AS (
  SELECT doc_id AS section, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS para_no, line AS text_raw,
         nullif({STRIP("string_split(line, '|')[1]")}, '') AS text,
         nullif({STRIP("CASE WHEN contains(line, '|') THEN substr(line, strpos(line, '|') + 1) END")}, '') AS gloss
  FROM l WHERE {STRIP('line')} <> '')"""
JOINED = "concat_ws(' ', text, gloss)"
MARKED = "replace(replace(text, '.', '<small>'), ',', '</small>')"

HITS = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
u AS (SELECT vec_id, label, list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END) AS v FROM e),
h AS (
  SELECT q.vec_id AS q_id, c.vec_id AS chunk_id, c.label AS section, list_inner_product(q.v, c.v) AS score FROM u q JOIN u c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM h) WHERE rank <= 100
), t AS (SELECT vec_id AS q_id, label AS section FROM embeddings WHERE vec_id % 100 = 0),
best AS (SELECT q_id, section, row_number() OVER (PARTITION BY q_id ORDER BY min(rank)) AS unique_rank, min(rank) AS chunk_rank FROM hits GROUP BY q_id, section),
r AS (SELECT t.q_id, t.section, best.unique_rank AS gt_rank, best.chunk_rank FROM t LEFT JOIN best ON best.q_id = t.q_id AND best.section = t.section)"""

NUMERAL = lambda n: f"(['','ק','ר','ש','ת'][({n}) // 100 + 1] || ['','י','כ','ל','מ','נ','ס','ע','פ','צ'][({n}) % 100 // 10 + 1] || ['','א','ב','ג','ד','ה','ו','ז','ח','ט'][({n}) % 10 + 1])"


def _list(items) -> str:
    return "[" + ",".join(f"'{x}'" for x in items) + "]"


# The words of numbers.
UNITS = _list("אחד שניים שלושה ארבעה חמישה שישה שבעה שמונה תשעה".split())
TEENS = _list(["עשרה", "אחד עשר", "שנים עשר", "שלושה עשר", "ארבעה עשר", "חמישה עשר", "שישה עשר", "שבעה עשר", "שמונה עשר", "תשעה עשר"])
TENS = _list("עשר עשרים שלושים ארבעים חמישים ששים שבעים שמונים תשעים".split())
HUNDREDS = _list(["מאה", "מאתיים", "שלוש מאות", "ארבע מאות", "חמש מאות", "שש מאות", "שבע מאות", "שמונה מאות", "תשע מאות"])


def number_words(n: str) -> str:
    rest = f"({n}) % 100"
    below = f"CASE WHEN {rest} = 0 THEN '' WHEN {rest} < 10 THEN {UNITS}[{rest}] WHEN {rest} < 20 THEN {TEENS}[{rest} - 9] ELSE concat_ws(' ', {TENS}[{rest} // 10], CASE WHEN {rest} % 10 > 0 THEN {UNITS}[{rest} % 10] END) END"
    return f"CASE WHEN ({n}) BETWEEN 2 AND 999 AND {rest} <> 1 THEN concat_ws(' ', CASE WHEN ({n}) >= 100 THEN {HUNDREDS}[({n}) // 100] END, nullif({below}, '')) END"


def windows(keys: str, size: int, step: int) -> str:
    """Windows of words over p, by explicit positions of all words."""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""w AS (SELECT section, para_no, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT section, para_no, {WORDS('coalesce(text, $$$$)')} AS ws FROM p)),
g AS (SELECT *, row_number() OVER ({part} ORDER BY section, para_no, i) - 1 AS pos FROM w),
x AS (SELECT *, unnest(range(greatest(0, (pos - {size} + {step}) // {step}), pos // {step} + 1)) AS "window" FROM g)"""


HEADING_LINES = """hl AS (
  SELECT n_nationkey::BIGINT AS nation, n_nationkey::BIGINT * 1000000000 AS line_no, 'הלכות ' || n_name AS grp, NULL AS section, NULL AS title FROM nation
  UNION ALL
  SELECT c_nationkey, c_nationkey::BIGINT * 1000000000 + c_custkey + 1, NULL, c_custkey::VARCHAR, CASE WHEN c_custkey % 10 <> 0 THEN c_name END FROM customer
), hm AS (
  SELECT section, coalesce(g, '') AS "group", coalesce(title, g, '') AS title
  FROM (SELECT *, last_value(grp IGNORE NULLS) OVER (PARTITION BY nation ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS g FROM hl) WHERE section IS NOT NULL
)"""

ANSWERED = "p AS (SELECT x.conv_id, x.turn, x.text AS given, y.text AS answer FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn = y.turn + 1 AND x.role = 'assistant' AND y.role = 'user')"
GRAMS = f"""w AS (SELECT conv_id, turn, true AS own, {WORDS('lower(given)')} AS w FROM p UNION ALL SELECT conv_id, turn, false, {WORDS('lower(answer)')} FROM p),
g AS (SELECT conv_id, turn, own, n, unnest(list_transform(range(1, len(w) - n::INT + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram FROM w, (SELECT unnest(range(1, {{longest}} + 1)) AS n)),
c AS (SELECT conv_id, turn, n, gram, count(*) FILTER (own) AS a, count(*) FILTER (NOT own) AS b FROM g GROUP BY ALL),
o AS (SELECT conv_id, turn, n, sum(least(a, b))::BIGINT AS matched, sum(a)::BIGINT AS given, sum(b)::BIGINT AS "true" FROM c GROUP BY ALL)"""

ORACLES: dict[str, str] = {
    "line_explode": f"WITH {LINES} SELECT doc_id, line_no, line FROM l",
    "line_classes": rf"""WITH {LINES}, s AS (SELECT *, {STRIP('line')} AS t FROM l)
SELECT doc_id, count(*) FILTER (t <> '' AND NOT regexp_matches(t, '^Siman \d+$') AND NOT regexp_matches(t, '^(Shulchan|שולחן|Torat|http)')) AS content,
  count(*) FILTER (t = '' OR regexp_matches(t, '^(Siman \d+|Shulchan|שולחן|Torat|http)')) AS passed,
  count(*) FILTER ({STRIP("regexp_replace(line, '</?small>', '', 'g')")} = '') AS empty FROM s GROUP BY doc_id""",
    "section_forward_fill": rf"""WITH {LINES}, s AS (SELECT *, len({WORDS('line')}) BETWEEN 1 AND 3 AS mark FROM l),
o AS (SELECT *, sum(mark::INT) OVER w AS section_ord, last_value(CASE WHEN mark THEN length(line)::VARCHAR END IGNORE NULLS) OVER w AS section FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT doc_id, section_ord::BIGINT AS section_ord, section, row_number() OVER (PARTITION BY doc_id, section_ord ORDER BY line_no) AS para_no, line_no
FROM o WHERE NOT mark AND section_ord > 0 AND {STRIP("regexp_replace(line, '</?small>', '', 'g')")} <> '' AND NOT regexp_matches({STRIP('line')}, '^(Shulchan|שולחן|Torat|http)')""",
    "collapse_blank_lines": rf"""WITH {LINES}, s AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^[A-M]') THEN line ELSE ' ' END AS line FROM l),
b AS (SELECT *, {STRIP('line')} = '' AS blank, coalesce(lag({STRIP('line')} = '') OVER (PARTITION BY doc_id ORDER BY line_no), false) AS after FROM s)
SELECT doc_id, line_no, line FROM b WHERE NOT (blank AND after)""",
    "insert_separators": rf"""WITH {LINES}, s AS (SELECT *, {STRIP('line')} <> '' AND NOT regexp_matches({STRIP('line')}, '^Siman \d+$|^(Shulchan|שולחן|Torat|http)') AS content FROM l),
b AS (SELECT *, coalesce(lag(content) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS after FROM s)
SELECT doc_id, line_no, 1::BIGINT AS part, line FROM b UNION ALL SELECT doc_id, line_no, 0, '' FROM b WHERE line_no > 0 AND content AND after""",
    "merge_continuation_lines": rf"""WITH {LINES}, s AS (SELECT *, sum((regexp_matches(line, '^\p{{Lu}}') OR line_no = 0)::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS head FROM l)
SELECT doc_id, min(line_no) AS line_no, string_agg(line, '' ORDER BY line_no) AS line FROM s GROUP BY doc_id, head""",
    "forward_fill_group": "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events",
    "one_document_sections": rf"""WITH {ONE}, s AS (SELECT *, len({WORDS('line')}) BETWEEN 1 AND 3 AS mark FROM one),
o AS (SELECT *, sum(mark::INT) OVER w AS section_ord, last_value(CASE WHEN mark THEN length(line)::VARCHAR END IGNORE NULLS) OVER w AS section FROM s WINDOW w AS (ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT section_ord::BIGINT AS section_ord, section, row_number() OVER (PARTITION BY section_ord ORDER BY line_no) AS para_no, line_no
FROM o WHERE NOT mark AND section_ord > 0 AND {STRIP("regexp_replace(line, '</?small>', '', 'g')")} <> '' AND NOT regexp_matches({STRIP('line')}, '^(Shulchan|שולחן|Torat|http)')""",
    "one_document_blank_lines": rf"""WITH {ONE}, s AS (SELECT line_no, CASE WHEN regexp_matches(line, '^[A-M]') THEN line ELSE ' ' END AS line FROM one),
b AS (SELECT *, {STRIP('line')} = '' AS blank, coalesce(lag({STRIP('line')} = '') OVER (ORDER BY line_no), false) AS after FROM s)
SELECT line_no, line FROM b WHERE NOT (blank AND after)""",
    "one_document_separators": rf"""WITH {ONE}, s AS (SELECT *, {STRIP('line')} <> '' AND NOT regexp_matches({STRIP('line')}, '^Siman \d+$|^(Shulchan|שולחן|Torat|http)') AS content FROM one),
b AS (SELECT *, coalesce(lag(content) OVER (ORDER BY line_no), false) AS after, max(regexp_matches(line, '^[Tt]h')::INT) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS begun FROM s)
SELECT line_no, 1::BIGINT AS part, line FROM b UNION ALL SELECT line_no, 0, '' FROM b WHERE begun = 1 AND content AND after""",
    "one_document_merge": rf"""WITH {ONE}, s AS (SELECT *, sum(regexp_matches(line, '^\p{{Lu}}')::INT) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS head FROM one)
SELECT min(line_no) AS line_no, string_agg(line, '' ORDER BY line_no) AS line FROM s GROUP BY head""",
    "one_document_groups": f"WITH {ONE} SELECT line_no, last_value(CASE WHEN len({WORDS('line')}) <= 2 THEN line END IGNORE NULLS) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS heading FROM one",
    "tag_balance": "WITH c AS (SELECT sum(len(string_split(html, '<p>')) - 1)::BIGINT AS opens, sum(len(string_split(html, '</p>')) - 1)::BIGINT AS closes FROM pages) SELECT opens, closes, opens = closes AS balanced FROM c",
    "whitespace_normalize": f"SELECT doc_id, trim(regexp_replace(text, '[{S}]+', ' ', 'g')) AS text, len({WORDS('text')})::BIGINT AS word_count FROM documents",
    "tidy_lines": f"WITH {LINES} SELECT doc_id, line_no, regexp_replace(regexp_replace(line, '  +', ' ', 'g'), '[{S}]+$', '') AS line FROM l",
    "punctuation_cleanup": rf"""WITH a AS (SELECT doc_id, replace(replace({MARKED}, '!', ' .. '), 'a', ' , ,') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '<small>\s*[^<א-ת]{{0,5}}\s*</small>', '', 'g'), '<small>\s*</small>', '', 'g'), ' +([.,:;])', '\1', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[.]{{2,}}', '.', 'g'), '[,]{{2,}}', ',', 'g'), '[:]{{2,}}', ':', 'g'), '[;]{{2,}}', ';', 'g') AS t FROM b)
SELECT doc_id, {STRIP("regexp_replace(t, '  +', ' ', 'g')")} AS text FROM c""",
    "strip_html": f"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[{S}]+', ' ', 'g')) AS text FROM pages",
    "quote_and_parenthesis_cleanup": r"SELECT doc_id, regexp_replace(translate(translate(text, '!?|;', '׳״()'), '׳״', '''" + '"' + r"'), '\([^()]{0,25}\)', '', 'g') AS text FROM documents",
    "diacritics_strip": f"SELECT doc_id, regexp_replace(translate(lower(text), '{LATIN}', '{HEBREW}'), '[֑-ׇ]', '', 'g') AS text FROM documents",
    "gematria_value": f"SELECT p_partkey, {NUMERAL('p_partkey % 500')} AS letters, (p_partkey % 500)::BIGINT AS value FROM part",
    "gematria_valid": f"""WITH a AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN reverse({NUMERAL('p_partkey % 500')}) ELSE {NUMERAL('p_partkey % 500')} END AS letters, p_size % 2 = 0 AS turned FROM part)
SELECT p_partkey, letters, length(letters) BETWEEN 1 AND 5 AND (NOT turned OR length(letters) = 1) AS valid FROM a""",
    "number_words": f"SELECT p_partkey, p_partkey % 1001 AS n, {number_words('p_partkey % 1001')} AS words FROM part",
    "expand_numerals": f"""WITH a AS (SELECT p_partkey, p_partkey % 120 AS n, {NUMERAL('p_partkey % 120')} AS letters FROM part)
SELECT p_partkey, 'דף ' || CASE WHEN length(letters) = 2 AND n BETWEEN 2 AND 99 AND n <> 72 THEN {number_words('n')} ELSE regexp_replace(letters, '(.)$', '"\\1') END || ' סוף' AS text FROM a""",
    "tag_depth_text": f"""WITH {LINES}, c AS (SELECT doc_id, line_no, unnest(string_split(line, '')) AS ch, generate_subscripts(string_split(line, ''), 1) AS i FROM l),
w AS (SELECT *, sum(CASE ch WHEN '.' THEN 1 WHEN ',' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM c),
d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS UNBOUNDED PRECEDING)) AS depth FROM w)
SELECT doc_id, depth::BIGINT AS depth, count(*) AS chars FROM d WHERE ch NOT IN ('.', ',', '') GROUP BY doc_id, depth""",
    "source_reference_parse": f"""WITH a AS (SELECT p_partkey, p_partkey % 499 + 1 AS n, p_size AS p, p_partkey % 4 AS kind FROM part)
SELECT p_partkey, CASE kind WHEN 0 THEN '(' || n || ', ' || p || ')' WHEN 1 THEN 'סימן ' || n WHEN 2 THEN 'סימן ' || {NUMERAL('n')} || ', סעיף ' || {NUMERAL('p')}
  ELSE regexp_replace({NUMERAL('n')}, '(.)$', '״\\1') || ', סעיף ' || {NUMERAL('p')} || '׳' END AS reference,
  n::BIGINT AS section, CASE WHEN kind <> 1 THEN p::BIGINT END AS paragraph FROM a""",
    "heading_parse": f'WITH {HEADING_LINES} SELECT section, "group", title FROM hm',
    "heading_enrichment": f"""WITH {HEADING_LINES}, c AS (SELECT c.c_custkey AS section, coalesce(hm."group", '') AS "group", CASE WHEN hm.title = hm."group" THEN '' ELSE coalesce(hm.title, '') END AS title FROM customer c LEFT JOIN hm ON hm.section = c.c_custkey::VARCHAR)
SELECT section, "group", title, '[' || coalesce(nullif(concat_ws(' > ', nullif("group", ''), nullif(title, '')), ''), 'אורח חיים') || ']' AS breadcrumb FROM c""",
    "breadcrumb_join": "SELECT c_custkey, '[' || coalesce(nullif(concat_ws(' > ', r_name, n_name), ''), 'root') || ']' AS breadcrumb FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey % 3 > 0",
    "breadcrumb_missing": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "passage_labels": f"WITH {PARAGRAPHS} SELECT section, para_no, 'סימן ' || section || ', סעיף ' || para_no AS label, 'siman_' || section || '_seif_' || para_no AS passage_id FROM p",
    "alignment_check": rf"WITH {LINES} SELECT doc_id, line_no, 'raw' AS side FROM l WHERE {STRIP(chr(114) + 'egexp_replace(line, $$[a-z' + chr(92) + 's.,]$$, $$$$, $$g$$)')} = ''",
    "corpus_coverage": f"WITH {PARAGRAPHS} SELECT count(DISTINCT section) AS sections, count(*) AS paragraphs, count(gloss) AS with_gloss, round(count(gloss) / count(*), 6) AS gloss_share, count(*) FILTER (text IS NULL) AS without_text FROM p",
    "length_stats": f"WITH {PARAGRAPHS}, n AS (SELECT len({WORDS('text_raw')})::BIGINT AS n FROM p) SELECT count(*) AS paragraphs, sum(n)::BIGINT AS words, round(sum(n) / count(*), 6) AS avg_words, max(n) AS longest FROM n",
    "nest_unnest": f"WITH {PARAGRAPHS} SELECT section, para_no, text, gloss FROM p",
    "nested_sections": f"WITH {PARAGRAPHS} SELECT section, count(*) AS n, arg_min(text, para_no) FILTER (para_no = 1) AS first, (list(text ORDER BY para_no))[-1] AS last FROM p GROUP BY section",
    "label_enrichment": "SELECT d.doc_id, coalesce(quality, -1)::BIGINT AS quality, coalesce(toxic, -1)::BIGINT AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "paragraph_chunks": f"WITH {PARAGRAPHS} SELECT section, para_no AS paragraph, 'סימן ' || section || ', סעיף ' || para_no AS label, {JOINED} AS text FROM p",
    "section_chunks": f"WITH {PARAGRAPHS} SELECT section, 'סימן ' || section AS label, coalesce(string_agg(nullif({JOINED}, ''), ' ' ORDER BY para_no), '') AS text FROM p GROUP BY section",
    "sliding_window_chunks": f"""WITH {PARAGRAPHS}, {windows('', 200, 150)}
SELECT "window"::BIGINT AS "window", arg_min(section, pos) AS section, arg_min(section, pos) || ':' || "window" AS label, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n_words FROM x GROUP BY "window" """,
    "section_window_chunks": f"""WITH {PARAGRAPHS}, {windows('section', 200, 200)}
SELECT section, "window"::BIGINT AS "window", string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n_words FROM x GROUP BY section, "window" """,
    "chunk_numbers": f"WITH {PARAGRAPHS} SELECT row_number() OVER (ORDER BY section, para_no) - 1 AS chunk_id, section, para_no AS paragraph FROM p",
    "encoding_text": rf"""WITH {PARAGRAPHS}, e AS (SELECT section, para_no, concat_ws(' ', 'Book, Siman ' || section || ', Seif ' || para_no || ':', text, gloss, regexp_extract(text_raw, '^([^.]*)', 1) || ' why?') AS encoding_text FROM p)
SELECT *, len({WORDS('encoding_text')})::BIGINT AS word_count FROM e""",
    "passage_prefix": "SELECT item_id, 'passage: ' || coalesce(text, '') AS passage, 'query: ' || coalesce(text, '') AS question FROM benchmark",
    "vector_normalize": f"WITH {HITS} SELECT vec_id, list_transform(v, lambda x: round(x, 5) + 0::DOUBLE) AS vector FROM u",
    "embedding_integrity": "SELECT coalesce(doc_id, vec_id) AS chunk_id, CASE WHEN doc_id IS NULL THEN 'clean' ELSE 'raw' END AS side FROM documents FULL JOIN embeddings ON doc_id = vec_id WHERE doc_id IS NULL OR vec_id IS NULL",
    "cosine_topk": f"WITH {HITS} SELECT q_id, rank, chunk_id, round(score, 4) + 0::DOUBLE AS score FROM hits",
    "score_threshold": f"WITH {HITS} SELECT q_id, rank, chunk_id FROM hits WHERE score >= 0.2",
    "unique_section_rank": f"WITH {HITS} SELECT q_id, section::BIGINT AS section, unique_rank FROM best",
    "ground_truth_rank": f"WITH {HITS} SELECT q_id, gt_rank FROM r",
    "recall_at_k": f"WITH {HITS} SELECT k::BIGINT AS k, count(*) FILTER (gt_rank <= k) AS hits, count(*) AS n, round(count(*) FILTER (gt_rank <= k) / count(*), 6) AS recall FROM r, (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY k",
    "mrr": f"WITH {HITS} SELECT count(*) AS n, round(sum(coalesce(1.0::DOUBLE / gt_rank, 0)) / count(*), 6) AS mrr FROM r",
    "target_gate": f"WITH {HITS}, c AS (SELECT count(*) FILTER (gt_rank <= 5) / count(*) AS recall FROM r) SELECT 5::BIGINT AS target_k, round(recall, 6) AS recall, 0.85::DOUBLE AS target_recall, recall >= 0.85 AS passed FROM c",
    "chunk_level_recall": f"WITH {HITS} SELECT k::BIGINT AS k, count(*) FILTER (chunk_rank <= k) AS hits, count(*) AS n, round(count(*) FILTER (chunk_rank <= k) / count(*), 6) AS recall FROM r, (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY k",
    "paragraph_level_recall": f"""WITH {HITS}, pr AS (SELECT t.q_id, min(h.rank) AS rank FROM t LEFT JOIN hits h ON h.q_id = t.q_id AND h.section = t.section AND h.chunk_id // 100 % 4 = t.q_id // 100 % 4 GROUP BY t.q_id)
SELECT k::BIGINT AS k, count(*) FILTER (rank <= k) AS hits, count(*) AS n, round(count(*) FILTER (rank <= k) / count(*), 6) AS recall FROM pr, (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY k""",
    "failure_analysis": f"WITH {HITS} SELECT section::BIGINT AS section, count(*) AS questions, count(*) FILTER (gt_rank IS NULL OR gt_rank > 3) AS missed FROM r GROUP BY section",
    "experiment_compare": f"WITH {HITS}, m AS (SELECT section::VARCHAR AS name, round(avg(coalesce(1.0::DOUBLE / gt_rank, 0)), 6) AS mrr FROM r GROUP BY section) SELECT name, mrr, row_number() OVER (ORDER BY mrr DESC, name) AS place FROM m",
    "max_questions": "SELECT * FROM benchmark ORDER BY item_id LIMIT 25",
    "chat_history_clean": f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
SELECT conv_id, turn, role, substr({STRIP('text')}, 1, 4000) AS text FROM a WHERE k <= 12 AND role IN ('user', 'assistant') AND {STRIP('text')} <> ''""",
    "chat_payload_clean": f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, role, substr({STRIP('text')}, 1, 100) AS content FROM a WHERE k <= 4 AND role IN ('user', 'assistant') AND {STRIP('text')} <> ''""",
    "answer_f1": f"""WITH {ANSWERED}, {GRAMS.replace('{longest}', '1')}
SELECT p.conv_id, p.turn, round(coalesce(2.0::DOUBLE * o.matched / (o.given + o."true"), 1), 6) AS f1 FROM p LEFT JOIN o ON p.conv_id = o.conv_id AND p.turn = o.turn""",
    "answer_overlaps": f"WITH {ANSWERED}, {GRAMS.replace('{longest}', '4')} SELECT * FROM o",
    "answer_bleu": " UNION ALL ".join(f"""SELECT * FROM (WITH {ANSWERED.replace('AS given', given)}, {GRAMS.replace('{longest}', '4')},
s AS (SELECT n, sum(matched) AS m, sum(given) AS g, sum("true") AS t FROM o GROUP BY n),
x AS (SELECT max(g) FILTER (n = 1) AS g1, max(t) FILTER (n = 1) AS t1, exp(sum(ln(m / g)) / 4) AS mean FROM s), y AS (SELECT *, CASE WHEN g1 >= t1 THEN 1 ELSE exp(1 - t1 / g1) END AS brevity FROM x)
SELECT '{name}' AS name, round(brevity * mean, 6) AS bleu, round(brevity, 6) AS brevity, g1::BIGINT AS given, t1::BIGINT AS "true" FROM y)""" for name, given in (("whole", "AS given"), ("half", f"AS old, array_to_string(({WORDS('y.text')})[1:greatest(len({WORDS('y.text')}) // 2, 1)], ' ') || ' and' AS given"))),
}
