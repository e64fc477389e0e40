"""Runners: corpus build, and an experiment whose stages are built where missing.

    python -m corpusloom.plans.pipeline build LINES HEADINGS OUT [--quiet]
    python -m corpusloom.plans.pipeline breadcrumb CORPUS HEADINGS OUT
    python -m corpusloom.plans.pipeline chunk CORPUS OUT [--mode MODE]
    python -m corpusloom.plans.pipeline embed CHUNKS OUT [--collection NAME]
    python -m corpusloom.plans.pipeline run CONFIG MODE [--force] [--max-questions N]
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import gematria, markup, spelling, terms
from corpusloom.functions.refs import ROOT
from corpusloom.functions.text import final_cleanup, join_fields, strip, tidy_line
from corpusloom.operators import lines as L
from corpusloom.operators.cache import CachedEncoder, ContentCache
from corpusloom.operators.chunking import build_chunks
from corpusloom.operators.encoding import PASSAGE, Encoder, HashingEncoder
from corpusloom.operators.enrich import check_aligned, enriched, rule_totals, with_breadcrumb, without_heading
from corpusloom.operators.evaluation import get_evaluator
from corpusloom.operators.retrieval import get_retriever
from corpusloom.sources.config import Config, limit_of, load, resolve_paths
from corpusloom.sources.readers import read_headings, read_lines, read_queries
from corpusloom.sources.scratch import written
from corpusloom.sources.writers import replace_collection, write_table

log = logging.getLogger(__name__)
#: Fixed value: how many sections without a heading are named.
MISSING_SHOWN = 30


def normalized(rows: DataFrame, text: Column) -> DataFrame:
    """rows with out: content through all rules: numbers first, as they need the marks, then spelling, then terms.

    Arrow functions stand in tables of their own, as Spark does not run them on or in expressions with lambdas.
    """
    cited = written(rows.withColumn("out", text), "cited")
    counted = written(cited.withColumn("out", gematria.expand_numbers(F.col("out"))), "counted")
    spelled = written(counted.withColumn("out", spelling.full_spelling(F.col("out"))), "spelled")
    return spelled.withColumn("out", final_cleanup(terms.unify_terms(F.col("out"))))


def raw_paragraphs(raw: DataFrame) -> DataFrame:
    """(doc, section_ord, section, para_no, text_raw): the lines as they are, but for orphan tags, which belong to the line before."""
    return L.sections(L.merge_orphan_tags(raw, keep_leading=False)).select("doc", "section_ord", "section", "para_no", F.col("line").alias("text_raw"))


def clean_paragraphs(raw: DataFrame) -> DataFrame:
    """(doc, section_ord, section, para_no, line): the paragraphs of the lines once all rules have run on them."""
    line = F.col("line")
    cited = markup.keep_glosses(markup.drop_nested_citations(line))["line"]
    processed = normalized(L.basic_fixes(raw), cited).withColumn("line", F.when(L.is_passed_through(line), line).otherwise(F.col("out"))).drop("out")
    return L.sections(processed).drop("line_no")


KEYS = ("doc", "section_ord", "section", "para_no")


def build_corpus(raw: DataFrame, check: bool = True) -> DataFrame:
    """(doc, section_ord, section, para_no, text, gloss, text_raw) of lines (doc, line_no, line).

    Raw and cleaned lines are parsed on their own and meet by place; where one has a paragraph that the other has not, which
    would shift all that follow, check raises an error.
    """
    before, after = raw_paragraphs(raw), clean_paragraphs(raw)
    if check:
        check_aligned(before, after, KEYS)
    met = after.withColumn("split", markup.split_gloss(F.col("line"))).join(before, list(KEYS))
    return met.select("doc", "section_ord", F.col("section").cast("int").alias("section"), "para_no", "split.text", "split.gloss", "text_raw")


def build_statistics(raw: DataFrame) -> DataFrame:
    """(stage, name, n): what each stage of the build changes; rules by how often they fire, in the stage terms."""
    line = F.col("line")
    count = lambda condition: F.count_if(condition)
    merged = L.merge_orphan_tags(raw, keep_leading=False)
    closed = merged.withColumn("closed", markup.close_parentheses(line)).withColumn("tidy", tidy_line(F.col("closed")))
    fixed = L.basic_fixes(raw)
    content = fixed.where(~L.is_passed_through(line)).withColumn("nested", markup.nested_citations(line)).withColumn("kept", markup.keep_glosses(F.col("nested.line")))
    content = written(content, "content")
    dropped = F.size(F.filter("nested.audit", lambda x: x["action"] == "DROP"))
    tables = [
        ("fixes", raw.agg(count(strip(line) == markup.CLOSE).alias("orphans"), count(L.is_section(line)).alias("sections"), F.count("*").alias("lines"))),
        ("fixes", closed.agg(count(F.col("closed") != line).alias("parentheses"), count(F.col("tidy") != F.col("closed")).alias("spaces"))),
        ("fixes", L.tag_balance(fixed).select("opens", "closes")),
        ("tags", content.agg(F.count("*").alias("content"), count(F.col("kept.line") != line).alias("cleaned"), F.sum(F.size("nested.audit")).alias("deep"), F.sum(dropped).alias("deep_dropped"), F.sum("kept.dropped").alias("references_dropped"))),
    ]
    stacked = None
    for stage, one in tables:
        rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.coalesce(c, F.lit(0)).cast("long").alias("n")) for c in one.columns))).alias("x")).select(F.lit(stage).alias("stage"), "x.*")
        stacked = rows if stacked is None else stacked.union(rows)
    fired = rule_totals(content, terms.rule_counts(F.col("kept.line"))).where("n > 0")
    return stacked.union(fired.select(F.lit("terms").alias("stage"), F.col("rule").alias("name"), "n"))


def log_statistics(raw: DataFrame, top: int = 30) -> None:
    """The statistics of a build as log lines, the rules that fire most often first."""
    for r in build_statistics(raw).orderBy("stage", F.col("n").desc(), "name").limit(top + 20).collect():
        log.info("%s %s: %s", r["stage"], r["name"], r["n"])


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def ensure(spark: SparkSession, output: str, inputs: list[str], build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """What is at output; built and written there first, if it is missing or force is set."""
    if force or not exists(spark, f"{output}/_SUCCESS"):
        if missing := [p for p in inputs if not exists(spark, p)]:
            raise FileNotFoundError(", ".join(missing))
        log.info("building %s", output)
        write_table(build(), output)
    else:
        log.info("there already: %s", output)
    return spark.read.parquet(output)


def with_enrichment(chunks: DataFrame, fields: tuple[str, ...], separator: str = " ") -> DataFrame:
    """chunks with those of the fields that they have before the text; arrays are joined by spaces, null and empty ones skipped."""
    there = [F.array_join(F.col(c), " ") if dict(chunks.dtypes)[c].startswith("array") else F.col(c).cast("string") for c in fields if c in chunks.columns]
    return chunks.withColumn("text", join_fields(*there, F.col("text"), separator=separator)) if there else chunks


def run_experiment(spark: SparkSession, config: Config, mode: str, encoder: Encoder | None = None, force: bool = False, max_questions=None) -> tuple[dict, str]:
    """Chunk, embed, retrieve, evaluate: the result and its report. The folders hold corpus, chunks, vectors and questions.

    What is encoded of a chunk is config.enrich_fields, those that it has, before its text. With a folder for cache, a text
    that was encoded before is not encoded again.
    """
    paths, encoder = resolve_paths(config, mode), encoder or HashingEncoder()
    if "cache" in paths:
        encoder = CachedEncoder(encoder, ContentCache(spark, paths["cache"], encoder.version(), "array<double>"))
    fields = tuple(config.chunk_fields)
    windows = {"size": config.window_size, "overlap": config.window_overlap} if config.chunk_mode == "sliding" else {}
    chunks = ensure(spark, paths["chunks"], [paths["corpus"]], lambda: build_chunks(spark.read.parquet(paths["corpus"]), config.chunk_mode, fields=fields, **windows), force)
    vectors = ensure(spark, paths["vectors"], [paths["chunks"]], lambda: encoder.encode(with_enrichment(chunks, config.enrich_fields, config.enrich_separator), "chunk_id", "text", PASSAGE), force)
    retriever = get_retriever(config.retriever, chunks, vectors, encoder, threshold=config.score_threshold)
    retriever.check()
    questions = read_queries(spark, paths["questions"])
    if n := limit_of(max_questions, config.max_questions):
        questions = questions.orderBy("q_id").limit(n)
    evaluator = get_evaluator(config.evaluator, k_values=config.k_values, retrieve_k=config.retrieve_k, target_k=config.target_k, target_recall=config.target_recall)
    result = evaluator.evaluate(retriever, questions)
    if "results" in paths:
        evaluator.save(result, paths["results"])
    return result, evaluator.format_report(result)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    for name in ("lines", "headings", "out"):
        build.add_argument(name)
    build.add_argument("--quiet", action="store_true")
    crumbs = commands.add_parser("breadcrumb")
    for name in ("corpus", "headings", "out"):
        crumbs.add_argument(name)
    cut = commands.add_parser("chunk")
    cut.add_argument("corpus")
    cut.add_argument("out")
    cut.add_argument("--mode", default="paragraph")
    embed = commands.add_parser("embed")
    embed.add_argument("chunks")
    embed.add_argument("out")
    embed.add_argument("--collection")
    run = commands.add_parser("run")
    run.add_argument("config")
    run.add_argument("mode")
    run.add_argument("--force", action="store_true")
    run.add_argument("--max-questions")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "build":
        raw = read_lines(spark, args.lines)
        if not args.quiet:
            log_statistics(raw)
        write_table(enriched(build_corpus(raw), read_headings(spark, args.headings)), args.out)
    elif args.command == "breadcrumb":
        corpus, headings = spark.read.parquet(args.corpus), read_headings(spark, args.headings)
        if rows := without_heading(corpus, headings).select("section").distinct().orderBy("section").limit(MISSING_SHOWN).collect():
            log.warning("sections without a heading, the first %d: %s", MISSING_SHOWN, [r["section"] for r in rows])
        write_table(with_breadcrumb(enriched(corpus, headings), ROOT), args.out)
    elif args.command == "chunk":
        write_table(build_chunks(spark.read.parquet(args.corpus), args.mode), args.out)
    elif args.command == "embed":
        chunks = spark.read.parquet(args.chunks)
        write_table(HashingEncoder().encode(chunks, "chunk_id", "text", PASSAGE), args.out)
        if args.collection:
            replace_collection(chunks.join(spark.read.parquet(args.out), "chunk_id"), args.collection)
    else:
        print(run_experiment(spark, load(args.config), args.mode, force=args.force, max_questions=args.max_questions)[1])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
