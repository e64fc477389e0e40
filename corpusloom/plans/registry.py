"""All queries of the engine, by name. Each takes (spark, sf_dir) and reads whole tables.

The tables hold no Hebrew. Queries on Hebrew text derive it from them: Latin letters are read as Hebrew letters, vowels as
vowel marks. A document is a section, and its lines with text are the section's paragraphs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import gematria, markup, refs, spelling, terms, vectors
from corpusloom.functions import text as T
from corpusloom.operators import answers, chat, chunking, enrich, evaluation, retrieval, semantic, vector_index
from corpusloom.operators import lines as L
from corpusloom.operators.encoding import PASSAGE, QUERY, HashingEncoder, prefixed
from corpusloom.operators.prefix import running_sum
from corpusloom.plans.hebrew_oracles import ORACLES as HEBREW_ORACLES
from corpusloom.plans.oracles import ORACLES as PLAIN_ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES = PLAIN_ORACLES | HEBREW_ORACLES

#: Latin letters and what they are read as: vowels as vowel marks, other letters as Hebrew letters.
LATIN, HEBREW = "bcdfghjklmnpqrstvwxyzaeiou", "בגדפהחיכלמנסקרשתועצטז" + "ִֶָֹֻ"
K_VALUES = (1, 3, 5, 10)
RETRIEVE_K = 100


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.explode_lines(read(spark, sf_dir, "documents"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section, para_no, text, gloss): the lines with text of every document; what stands before a bar in a line is its text, the rest its gloss."""
    content = lines(spark, sf_dir).where(T.strip(F.col("line")) != "").withColumnRenamed("doc", "section")
    number = F.row_number().over(Window.partitionBy("section").orderBy("line_no")).cast("long")
    parts = F.split(F.col("line"), r"\|", 2)
    return content.select("section", number.alias("para_no"), T.none_if_empty(T.strip(F.get(parts, F.lit(0)))).alias("text"), T.none_if_empty(T.strip(F.get(parts, F.lit(1)))).alias("gloss"), F.col("line").alias("text_raw"))


def hebrew(text: Column) -> Column:
    return F.translate(F.lower(text), LATIN, HEBREW)


def marked(text: Column) -> Column:
    """Text with small marks: sentences open them, commas close them."""
    return F.replace(F.replace(text, F.lit("."), F.lit("<small>")), F.lit(","), F.lit("</small>"))


# Lines


@query
def line_explode(spark, sf_dir):
    return lines(spark, sf_dir).withColumnRenamed("doc", "doc_id")


@query
def line_classes(spark, sf_dir):
    line = F.col("line")
    return lines(spark, sf_dir).groupBy("doc").agg(F.count_if(L.is_content(line)).alias("content"), F.count_if(L.is_passed_through(line)).alias("passed"), F.count_if(~L.has_text(line)).alias("empty")).withColumnRenamed("doc", "doc_id")


@query
def section_forward_fill(spark, sf_dir):
    """Lines of at most three words are markers, numbered by their length."""
    few = T.word_count(F.col("line")).between(1, 3)
    found = L.sections(lines(spark, sf_dir), few, F.length("line").cast("string"))
    return found.select(F.col("doc").alias("doc_id"), "section_ord", "section", "para_no", "line_no")


@query
def collapse_blank_lines(spark, sf_dir):
    """Lines without letters A to M count as blank here, as the tables have few blank lines."""
    shown = lines(spark, sf_dir).withColumn("line", F.when(F.col("line").rlike("^[A-M]"), F.col("line")).otherwise(F.lit(" ")))
    return L.collapse_blank_lines(shown).withColumnRenamed("doc", "doc_id")


@query
def insert_separators(spark, sf_dir):
    return L.insert_separators(lines(spark, sf_dir), F.col("line_no") > 0).withColumnRenamed("doc", "doc_id")


@query
def merge_continuation_lines(spark, sf_dir):
    """A line that does not begin with a capital continues the one before."""
    return L.merge_lines(lines(spark, sf_dir), ~F.col("line").rlike(r"^\p{Lu}") & (F.col("line_no") > 0)).withColumnRenamed("doc", "doc_id")


@query
def forward_fill_group(spark, sf_dir):
    """For every event of a user, the latest purchase up to it. A user's events are scanned by days."""
    purchase = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    day = F.coalesce(F.to_date("ts"), F.lit("0001-01-01").cast("date"))
    return L.forward_fill(read(spark, sf_dir, "events"), purchase, "last_purchase", by="user_id", order=("ts", "event_id"), range_of=day).select("event_id", "user_id", "last_purchase")


def one_document(spark, sf_dir) -> DataFrame:
    """The lines of all documents as one document, numbered through."""
    counted = read(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", L.NEWLINE)).cast("long").alias("n"))
    first = running_sum(counted.where("n > 0"), "doc_id", "n", "first").select(F.col("doc_id").alias("of"), "first")
    met = lines(spark, sf_dir).join(first, F.col("doc") == F.col("of"))
    return met.select(F.lit(0).cast("long").alias("doc"), (F.col("first") + F.col("line_no")).alias("line_no"), "line")


@query
def one_document_sections(spark, sf_dir):
    """The sections of section_forward_fill, in one document of all lines."""
    few = T.word_count(F.col("line")).between(1, 3)
    return L.sections(one_document(spark, sf_dir), few, F.length("line").cast("string")).select("section_ord", "section", "para_no", "line_no")


@query
def one_document_blank_lines(spark, sf_dir):
    shown = one_document(spark, sf_dir).withColumn("line", F.when(F.col("line").rlike("^[A-M]"), F.col("line")).otherwise(F.lit(" ")))
    return L.collapse_blank_lines(shown).select("line_no", "line")


@query
def one_document_separators(spark, sf_dir):
    return L.insert_separators(one_document(spark, sf_dir), F.col("line").rlike("^[Tt]h")).drop("doc")


@query
def one_document_merge(spark, sf_dir):
    return L.merge_lines(one_document(spark, sf_dir), ~F.col("line").rlike(r"^\p{Lu}")).drop("doc")


@query
def one_document_groups(spark, sf_dir):
    """For every line, the latest line of two words at most, as a heading."""
    heading = F.when(T.word_count(F.col("line")) <= 2, F.col("line"))
    return L.forward_fill(one_document(spark, sf_dir), heading, "heading").select("line_no", "heading")


@query
def tag_balance(spark, sf_dir):
    return L.tag_balance(read(spark, sf_dir, "pages"), "<p>", "</p>", "html")


# Text


@query
def whitespace_normalize(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"), T.word_count(F.col("text")).alias("word_count"))


@query
def tidy_lines(spark, sf_dir):
    return lines(spark, sf_dir).select(F.col("doc").alias("doc_id"), "line_no", T.tidy_line(F.col("line")).alias("line"))


@query
def punctuation_cleanup(spark, sf_dir):
    spaced = F.replace(F.replace(marked(F.col("text")), F.lit("!"), F.lit(" .. ")), F.lit("a"), F.lit(" , ,"))
    return read(spark, sf_dir, "documents").select("doc_id", T.final_cleanup(spaced).alias("text"))


@query
def strip_html(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.normalize_whitespace(T.remove_tags(F.col("html"))).alias("text"))


@query
def quote_and_parenthesis_cleanup(spark, sf_dir):
    shaped = F.translate(F.col("text"), "!?|;", "׳״()")
    return read(spark, sf_dir, "documents").select("doc_id", T.remove_short_parentheses(T.normalize_quotes(shaped)).alias("text"))


@query
def diacritics_strip(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.strip_marks(hebrew(F.col("text"))).alias("text"))


@query
def full_spelling(spark, sf_dir):
    return lines(spark, sf_dir).select(F.col("doc").alias("doc_id"), "line_no", spelling.full_spelling(hebrew(F.col("line"))).alias("line"))


def with_terms(line: Column) -> Column:
    """A line in which some common words are replaced by terms that the rules know."""
    for word, term in (("the", 'הקב"ה'), ("of", "ה'"), ("in", "ד' אמות"), ("and", 'עכו"ם'), ("to", "סעיף ה'"), ("is", 'כדלעיל סימן מ"ו'), ("with", "לפי' כותי"), ("on", 'וה"ה או"ח'), ("de", "ונכרים")):
        line = F.replace(line, F.lit(f" {word} "), F.lit(f" {term} "))
    return line


@query
def term_unification(spark, sf_dir):
    return lines(spark, sf_dir).select(F.col("doc").alias("doc_id"), "line_no", terms.unify_terms(with_terms(F.col("line"))).alias("line"))


@query
def rule_counters(spark, sf_dir):
    return enrich.rule_totals(lines(spark, sf_dir), terms.rule_counts(with_terms(F.col("line"))))


@query
def split_gloss(spark, sf_dir):
    text = F.replace(marked(hebrew(F.col("line"))), F.lit("תה"), F.lit("הגה: "))
    return lines(spark, sf_dir).withColumn("x", markup.split_gloss(text)).select(F.col("doc").alias("doc_id"), "line_no", "x.text", "x.gloss")


@query
def nested_citations(spark, sf_dir):
    nested = F.replace(F.replace(marked(F.col("line")), F.lit(" and "), F.lit(" <small>(")), F.lit(" to "), F.lit(") </small>"))
    kept = markup.keep_glosses(markup.drop_nested_citations(nested))
    return lines(spark, sf_dir).withColumn("x", kept).select(F.col("doc").alias("doc_id"), "line_no", F.col("x.line").alias("line"), F.col("x.dropped").cast("long").alias("dropped"))


@query
def citation_audit(spark, sf_dir):
    """How many blocks below depth 1 are dropped and kept, by depth."""
    nested = F.replace(F.replace(marked(F.col("line")), F.lit(" and "), F.lit(" <small>(")), F.lit(" to "), F.lit(") </small>"))
    found = lines(spark, sf_dir).select(F.inline(markup.nested_citations(nested)["audit"]))
    return found.groupBy("action", F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("blocks"))


@query
def tag_depth_text(spark, sf_dir):
    """Characters of each document at each depth of small marks."""
    found = lines(spark, sf_dir).select("doc", F.inline(markup.depth_texts(marked(F.col("line")))))
    return found.groupBy("doc", "depth").agg(F.sum(F.length("text")).alias("chars")).select(F.col("doc").alias("doc_id"), F.col("depth").cast("long").alias("depth"), "chars")


# Numerals, references, headings


def numeral(n: Column) -> Column:
    """A number below 500 in Hebrew letters."""
    letters = lambda items: F.array(*map(F.lit, ["", *items]))
    return F.concat(F.get(letters("קרשת"), F.floor(n / 100).cast("int")), F.get(letters("יכלמנסעפצ"), F.floor(n % 100 / 10).cast("int")), F.get(letters("אבגדהוזחט"), (n % 10).cast("int")))


@query
def gematria_value(spark, sf_dir):
    text = numeral(F.col("p_partkey") % 500)
    return read(spark, sf_dir, "part").select("p_partkey", text.alias("letters"), gematria.value(text).cast("long").alias("value"))


@query
def gematria_valid(spark, sf_dir):
    text = F.when(F.col("p_size") % 2 == 0, F.reverse(numeral(F.col("p_partkey") % 500))).otherwise(numeral(F.col("p_partkey") % 500))
    return read(spark, sf_dir, "part").select("p_partkey", text.alias("letters"), gematria.is_number(text).alias("valid"))


@query
def number_words(spark, sf_dir):
    n = F.col("p_partkey") % 1001
    return read(spark, sf_dir, "part").select("p_partkey", n.alias("n"), gematria.number_words(n).alias("words"))


@query
def expand_numerals(spark, sf_dir):
    letters = numeral(F.col("p_partkey") % 120)
    quoted = F.concat(F.lit("דף "), F.regexp_replace(letters, "(.)$", '"$1'), F.lit(" סוף"))
    return read(spark, sf_dir, "part").select("p_partkey", gematria.expand_numbers(quoted).alias("text"))


@query
def source_reference_parse(spark, sf_dir):
    n, p = F.col("p_partkey") % 499 + 1, F.col("p_size")
    kind = F.col("p_partkey") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("("), n.cast("string"), F.lit(", "), p.cast("string"), F.lit(")")))
        .when(kind == 1, F.concat(F.lit("סימן "), n.cast("string")))
        .when(kind == 2, F.concat(F.lit("סימן "), numeral(n), F.lit(", סעיף "), numeral(p)))
        .otherwise(F.concat(F.regexp_replace(numeral(n), "(.)$", "״$1"), F.lit(", סעיף "), numeral(p), F.lit("׳")))
    )
    return read(spark, sf_dir, "part").select("p_partkey", text.alias("reference"), refs.section_of(text).cast("long").alias("section"), refs.paragraph_of(text).cast("long").alias("paragraph"))


def heading_lines(spark, sf_dir) -> DataFrame:
    """Nations as groups with their customers as sections: (doc, line_no, line)."""
    nations = read(spark, sf_dir, "nation").select(F.lit(0).alias("doc"), (F.col("n_nationkey").cast("long") * 1_000_000_000).alias("line_no"), F.concat(F.lit("הלכות "), F.col("n_name")).alias("line"))
    key = F.col("c_custkey").cast("string")
    text = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("סימן "), key, F.lit(" ובו סעיף אחד:"))).otherwise(F.concat(F.lit("סימן "), key, F.lit(" - "), F.col("c_name"), F.lit(". ובו 9 סעיפים:")))
    customers = read(spark, sf_dir, "customer").select(F.lit(0).alias("doc"), (F.col("c_nationkey").cast("long") * 1_000_000_000 + F.col("c_custkey") + 1).alias("line_no"), text.alias("line"))
    return nations.union(customers).withColumn("doc", F.floor(F.col("line_no") / 1_000_000_000))


@query
def heading_parse(spark, sf_dir):
    return enrich.heading_map(heading_lines(spark, sf_dir))


@query
def heading_enrichment(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("section"), F.lit("old").alias("title"))
    return enrich.with_breadcrumb(enrich.enriched(customers, enrich.heading_map(heading_lines(spark, sf_dir))), refs.ROOT)


@query
def breadcrumb_join(spark, sf_dir):
    """Customers under their nation and region; every third nation has no region."""
    regions = read(spark, sf_dir, "region")
    nations = read(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.when(F.col("r_regionkey") % 3 > 0, F.col("r_regionkey")), "left")
    met = read(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return met.select("c_custkey", refs.breadcrumb(F.col("r_name"), F.col("n_name"), "root").alias("breadcrumb"))


@query
def breadcrumb_missing(spark, sf_dir):
    headings = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("section"))
    return enrich.without_heading(read(spark, sf_dir, "documents").select("doc_id"), headings, "doc_id")


@query
def passage_labels(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("section", "para_no", refs.label(F.col("section"), F.col("para_no")).alias("label"), refs.passage_id(F.col("section"), F.col("para_no")).alias("passage_id"))


# Corpus


@query
def alignment_check(spark, sf_dir):
    """Lines of the raw texts that cleaning leaves nothing of."""
    raw = lines(spark, sf_dir)
    clean = raw.where(T.strip(F.regexp_replace("line", r"[a-z\s.,]", "")) != "")
    return enrich.misaligned(raw, clean, ("doc", "line_no")).withColumnRenamed("doc", "doc_id")


@query
def corpus_coverage(spark, sf_dir):
    return enrich.coverage(paragraphs(spark, sf_dir), F.col("text"), F.col("gloss")).withColumn("gloss_share", F.round("gloss_share", 6))


@query
def length_stats(spark, sf_dir):
    counted = paragraphs(spark, sf_dir).select("section", T.word_count(F.col("text_raw")).alias("n"))
    return counted.agg(F.count("*").alias("paragraphs"), F.sum("n").alias("words"), F.round(F.sum("n") / F.count("*"), 6).alias("avg_words"), F.max("n").alias("longest"))


@query
def nest_unnest(spark, sf_dir):
    """Paragraphs nested by section, and taken apart again."""
    return enrich.unnest(enrich.nest(paragraphs(spark, sf_dir))).select("section", F.col("para_no").cast("long").alias("para_no"), "text", "gloss")


@query
def nested_sections(spark, sf_dir):
    nested = enrich.nest(paragraphs(spark, sf_dir))
    return nested.select("section", F.size("paragraphs").cast("long").alias("n"), F.get("paragraphs", F.lit(0))["text"].alias("first"), F.get("paragraphs", F.size("paragraphs") - 1)["text"].alias("last"))


@query
def label_enrichment(spark, sf_dir):
    """Documents with their labels, or defaults."""
    labels = read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "_id")
    met = read(spark, sf_dir, "documents").join(labels, F.col("doc_id") == F.col("_id"), "left")
    return met.select("doc_id", F.coalesce("quality", F.lit(-1)).cast("long").alias("quality"), F.coalesce("toxic", F.lit(-1)).cast("long").alias("toxic"))


# Chunks


@query
def paragraph_chunks(spark, sf_dir):
    return chunking.paragraph_chunks(paragraphs(spark, sf_dir))


@query
def section_chunks(spark, sf_dir):
    return chunking.section_chunks(paragraphs(spark, sf_dir)).select("section", "label", "text")


@query
def sliding_window_chunks(spark, sf_dir):
    return chunking.sliding_chunks(paragraphs(spark, sf_dir)).select("window", "section", "label", "text", "n_words")


@query
def section_window_chunks(spark, sf_dir):
    return chunking.section_windows(paragraphs(spark, sf_dir))


@query
def chunk_numbers(spark, sf_dir):
    """Paragraph chunks with their place in the whole corpus."""
    return chunking.numbered(chunking.paragraph_chunks(paragraphs(spark, sf_dir)), "section", "paragraph").select("chunk_id", "section", "paragraph")


@query
def encoding_text(spark, sf_dir):
    first = F.regexp_extract("text_raw", r"^([^.]*)", 1)
    shown = T.encoding_text(T.context_prefix("Book", F.col("section"), F.col("para_no")), F.col("text"), F.col("gloss"), F.array(first, F.lit("why?")))
    return paragraphs(spark, sf_dir).select("section", "para_no", shown.alias("encoding_text"), T.word_count(shown).alias("word_count"))


@query
def passage_prefix(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", prefixed(PASSAGE, F.col("text")).alias("passage"), prefixed(QUERY, F.col("text")).alias("question"))


# Vectors. Every vector whose id is divisible by 100 is a query against all others; its label is its section.


@query
def vector_normalize(spark, sf_dir):
    unit = vectors.normalized(F.col("embedding"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.transform(unit, lambda v: F.round(v, 5)).alias("vector"))


@query
def embedding_integrity(spark, sf_dir):
    """Documents and vectors that have no counterpart with the same number."""
    docs, vecs = (read(spark, sf_dir, t).select(F.col(c).alias("chunk_id")) for t, c in (("documents", "doc_id"), ("embeddings", "vec_id")))
    return enrich.misaligned(docs, vecs, ("chunk_id",))


def corpus_vectors(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), vectors.normalized(F.col("embedding")).alias("vector"), F.col("label").alias("section"))


def asked(spark, sf_dir) -> DataFrame:
    return corpus_vectors(spark, sf_dir).where(F.col("chunk_id") % 100 == 0).withColumnRenamed("chunk_id", "q_id")


def hits(spark, sf_dir, top_k: int = RETRIEVE_K) -> DataFrame:
    """(q_id, rank, chunk_id, score, section)."""
    corpus = corpus_vectors(spark, sf_dir)
    found = retrieval.search(asked(spark, sf_dir), corpus, top_k, skip_same=True)
    return found.join(corpus.select("chunk_id", "section"), "chunk_id")


def truth(spark, sf_dir) -> DataFrame:
    return asked(spark, sf_dir).select("q_id", "section")


def ranks(spark, sf_dir, unique: bool = True) -> DataFrame:
    return evaluation.ground_truth_ranks(hits(spark, sf_dir), truth(spark, sf_dir), unique)


@query
def cosine_topk(spark, sf_dir):
    return hits(spark, sf_dir).select("q_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 4).alias("score"))


@query
def vector_index_topk(spark, sf_dir):
    """The ten nearest vectors of each question, by the approximate index."""
    corpus = corpus_vectors(spark, sf_dir)
    index = vector_index.fit(corpus)
    found = vector_index.search(asked(spark, sf_dir), corpus, vector_index.stored(corpus, index), index, 10, skip_same=True)
    return found.select("q_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 4).alias("score"))


@query
def score_threshold(spark, sf_dir):
    return hits(spark, sf_dir).where(F.col("score") >= 0.2).select("q_id", F.col("rank").cast("long").alias("rank"), "chunk_id")


@query
def unique_section_rank(spark, sf_dir):
    return evaluation.unique_ranks(hits(spark, sf_dir)).select("q_id", F.col("section").cast("long").alias("section"), F.col("unique_rank").cast("long").alias("unique_rank"))


@query
def ground_truth_rank(spark, sf_dir):
    return ranks(spark, sf_dir).select("q_id", F.col("gt_rank").cast("long").alias("gt_rank"))


@query
def recall_at_k(spark, sf_dir):
    found = ranks(spark, sf_dir)
    return evaluation.recall_at(found, K_VALUES).select(F.col("k").cast("long").alias("k"), "hits", "n", F.round("recall", 6).alias("recall"))


@query
def mrr(spark, sf_dir):
    return evaluation.mrr(ranks(spark, sf_dir)).select("n", F.round("mrr", 6).alias("mrr"))


@query
def target_gate(spark, sf_dir):
    return evaluation.target_gate(ranks(spark, sf_dir), 5).select(F.col("target_k").cast("long").alias("target_k"), F.round("recall", 6).alias("recall"), "target_recall", "passed")


@query
def chunk_level_recall(spark, sf_dir):
    found = ranks(spark, sf_dir, unique=False)
    return evaluation.recall_at(found, K_VALUES).select(F.col("k").cast("long").alias("k"), "hits", "n", F.round("recall", 6).alias("recall"))


@query
def paragraph_level_recall(spark, sf_dir):
    """Recall of the true paragraph: section and paragraph have to agree. Every hundredth vector is the same paragraph of its section, of four."""
    paragraph = lambda key: F.pmod(F.floor(F.col(key) / 100), F.lit(4)).alias("paragraph")
    found = hits(spark, sf_dir).select("*", paragraph("chunk_id"))
    ranked = evaluation.ground_truth_ranks(found, truth(spark, sf_dir).select("*", paragraph("q_id")), unique=False, by=("section", "paragraph"))
    return evaluation.recall_at(ranked, K_VALUES).select(F.col("k").cast("long").alias("k"), "hits", "n", F.round("recall", 6).alias("recall"))


@query
def failure_analysis(spark, sf_dir):
    return evaluation.failures(ranks(spark, sf_dir), truth(spark, sf_dir), 3).select(F.col("section").cast("long").alias("section"), "questions", "missed")


@query
def experiment_compare(spark, sf_dir):
    """Each section's questions as an experiment, best mean reciprocal rank first."""
    met = truth(spark, sf_dir).join(ranks(spark, sf_dir), "q_id")
    results = met.groupBy(F.col("section").cast("string").alias("name")).agg(F.round(F.avg(evaluation.reciprocal(F.col("gt_rank"))), 6).alias("mrr"))
    return evaluation.compare(results, "mrr").select("name", "mrr", F.col("place").cast("long").alias("place"))


@query
def max_questions(spark, sf_dir):
    """The first 25 questions: the limit is what this one is for."""
    return read(spark, sf_dir, "benchmark").orderBy("item_id").limit(25)


@query
def lexical_retrieval(spark, sf_dir):
    """For every benchmark passage the ten documents whose hashed words are nearest."""
    encoder = HashingEncoder()
    questions = encoder.encode(read(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "q_id"), "q_id", "text")
    corpus = encoder.encode(read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "chunk_id"), "chunk_id", "text")
    return retrieval.search(questions, corpus, 10).select("q_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


@query
def semantic_retrieval(spark, sf_dir):
    """For every benchmark passage the ten documents that are nearest by singular vectors of all documents' terms."""
    counts = semantic.counted(read(spark, sf_dir, "documents"), "text", "doc_id")
    encoder = semantic.SemanticEncoder.fit_counts(counts)
    questions = encoder.encode(read(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "q_id"), "q_id", "text")
    return retrieval.search(questions, encoder.encode_counts(counts, "chunk_id"), 10).select("q_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


# Chat


@query
def chat_history_clean(spark, sf_dir):
    return chat.clean_history(read(spark, sf_dir, "conversations"))


@query
def chat_payload_clean(spark, sf_dir):
    """Histories as arrays, cleaned as one value: the last four messages, cut to 100 characters."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    latest = read(spark, sf_dir, "conversations").withColumn("nth", F.row_number().over(order)).where("nth <= 4")  # so that no long conversation is gathered
    messages = latest.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    cleaned = chat.clean_messages(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))), 4, 100)
    return messages.select("conv_id", F.posexplode(cleaned).alias("place", "x")).select("conv_id", F.col("place").cast("long").alias("place"), "x.role", "x.content")


def answered(spark, sf_dir) -> DataFrame:
    """(conv_id, turn, given, answer): each turn of the assistant, with the question before it in place of the true answer."""
    turns = read(spark, sf_dir, "conversations")
    questions = turns.where("role = 'user'").select(F.col("conv_id").alias("c"), (F.col("turn") + 1).alias("t"), F.col("text").alias("answer"))
    met = turns.where("role = 'assistant'").join(questions, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")))
    return met.select("conv_id", "turn", F.col("text").alias("given"), "answer")


@query
def answer_f1(spark, sf_dir):
    """Token F1 of each answer with the question before it, repeats counted."""
    return answers.token_f1(answered(spark, sf_dir), ["conv_id", "turn"]).select("conv_id", "turn", F.round("f1", 6).alias("f1"))


@query
def answer_overlaps(spark, sf_dir):
    """Words, pairs, threes and fours that each answer has in common with the question before it."""
    return answers.overlaps(answered(spark, sf_dir), ["conv_id", "turn"]).withColumn("n", F.col("n").cast("long"))


@query
def answer_bleu(spark, sf_dir):
    """BLEU of all answers against questions, and of the answers cut to half of their question's words, whose brevity counts."""
    whole = answered(spark, sf_dir)
    half = F.array_join(F.slice(T.words(F.col("answer")), F.lit(1), F.greatest(F.floor(T.word_count(F.col("answer")) / 2), F.lit(1)).cast("int")), " ")
    both = {"whole": whole, "half": whole.withColumn("given", F.concat_ws(" ", half, F.lit("and")))}
    scores = [answers.bleu(df, ["conv_id", "turn"]).select(F.lit(name).alias("name"), F.round("bleu", 6).alias("bleu"), F.round("brevity", 6).alias("brevity"), "given", "true") for name, df in both.items()]
    return scores[0].unionByName(scores[1])


@query
def answer_rouge(spark, sf_dir):
    """ROUGE-L of each answer with the question before it."""
    return answers.rouge_l(answered(spark, sf_dir), ["conv_id", "turn"]).select("conv_id", "turn", "common", F.round("rouge_l", 6).alias("rouge_l"))
