"""Token counts: rollups by source, language and tokenizer version that are maintained by signed deltas.

Rows: a null text has 0 tokens; null sources and languages are groups of their own. Repeated rows count as often as they
are. Texts are counted whole, however long. Extra columns are ignored; an empty batch is a commit without totals. Totals that
come to no documents stay, with 0.

A batch of changes is summed to one row for each group before it is stored. It is written aside and then renamed to a folder
named by its identifier, which fails where that folder is there already: of two writers of one batch one commits, and a
batch that comes again is skipped. Compaction writes the totals of all batches with the list of their identifiers, so that
they are known as committed even after their folders are gone. Totals are the latest compaction and the batches after it.
"""

from __future__ import annotations

import logging
import re
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import bpe
from corpusloom.llm.common import n_words
from corpusloom.sources.scratch import shared_dir, written

log = logging.getLogger(__name__)

KEYS = ("source", "lang", "tokenizer")
CHANGE_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Tokenizer versions that count without a vocabulary: words, and words with punctuation apart.
TOKENIZERS = {
    "words/1": lambda text: n_words(text),
    "pieces/1": lambda text: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]")).cast("long"),
}


class Rollup:
    """Additive totals in a folder of batches (batch=ID) and compactions (compact=N, with totals and ids)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self, batch: str) -> str:
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a batch identifier: {batch!r}")
        return f"{self.path}/batch={batch}"

    def _complete(self, folder: str) -> bool:
        mark, files = self._file(f"{folder}/_SUCCESS")
        return files.exists(mark)

    def _named(self, kind: str) -> list[str]:
        """What follows the kind in the names of complete folders."""
        root, files = self._file(self.path)
        names = [f.getPath().getName() for f in files.listStatus(root)] if files.exists(root) else []
        return [n.removeprefix(f"{kind}=") for n in names if n.startswith(f"{kind}=") and self._complete(f"{self.path}/{n}" + ("/ids" if kind == "compact" else ""))]

    def _latest(self) -> int | None:
        return max(map(int, self._named("compact")), default=None)

    def _compacted(self, among: list[str], k: int | None) -> set[str]:
        """Which of these batches compaction k holds."""
        if k is None or not among:
            return set()
        ids = self.spark.read.schema("batch string").parquet(f"{self.path}/compact={k}/ids")
        return {r["batch"] for r in ids.where(F.col("batch").isin(among)).collect()}

    def _move(self, source: str, target: str) -> bool:
        """Rename a folder; False, and without it, if the target is there already."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        (old, files), (new, _) = self._file(source), self._file(target)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf)
        try:
            context.rename(old, new, self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if not files.exists(new):
                raise
            log.info("there already: %s (%s)", target, e.java_exception.getMessage())
            files.delete(old, True)
            return False
        return True

    def has(self, batch: str) -> bool:
        return self._complete(self._folder(batch)) or bool(self._compacted([batch], self._latest()))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Store a batch of changes (source, lang, tokenizer, n_docs, n_tokens; signed). False if it was there already."""
        if self.has(batch):
            return False
        aside, folder = f"{self.path}/_aside-{uuid.uuid4().hex}", self._folder(batch)
        changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(aside)
        broken, files = self._file(folder)
        if files.exists(broken) and not self._complete(folder):
            files.delete(broken, True)
        return self._move(aside, folder)

    def totals(self) -> DataFrame:
        return self._sum(self._named("batch"), self._latest())

    def _sum(self, batches: list[str], k: int | None) -> DataFrame:
        """The totals of these batches and of compaction k, each batch once."""
        held = self._compacted(batches, k)
        parts = [self._folder(b) for b in batches if b not in held] + ([] if k is None else [f"{self.path}/compact={k}/totals"])
        if not parts:
            return self.spark.createDataFrame([], CHANGE_SCHEMA)
        stored = self.spark.read.schema(CHANGE_SCHEMA).parquet(*parts)
        return stored.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self) -> bool:
        """The totals so far as one table, with the identifiers of all its batches. False if another compaction came first.

        The batches are listed once: one that is committed meanwhile is neither in the totals nor in the identifiers.
        """
        batches, k = self._named("batch"), self._latest()
        aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        self._sum(batches, k).write.parquet(f"{aside}/totals")
        ids = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        if k is not None:
            ids = ids.union(self.spark.read.schema("batch string").parquet(f"{self.path}/compact={k}/ids"))
        ids.distinct().write.parquet(f"{aside}/ids")
        return self._move(aside, f"{self.path}/compact={0 if k is None else k + 1}")

    def vacuum(self) -> None:
        """Delete the folders of batches and compactions that the latest compaction holds. No one may be reading them."""
        k = self._latest()
        gone = [self._folder(b) for b in self._compacted(self._named("batch"), k)] + [f"{self.path}/compact={n}" for n in self._named("compact") if int(n) != k]
        for folder in gone:
            path, files = self._file(folder)
            files.delete(path, True)


def counted(docs: DataFrame, *tokenizers: str) -> DataFrame:
    """doc_id, source, lang and one count a tokenizer, from one pass over the texts.

    A tokenizer is one of TOKENIZERS, or a version of a vocabulary such as word_bpe_49k/1, whose file is named before the slash.
    """
    text = F.col("text").cast("string")
    native = [t for t in tokenizers if t in TOKENIZERS]
    counts = docs.select("doc_id", "source", "lang", *(TOKENIZERS[t](text).alias(t) for t in native), text.alias("text"))
    for name in tokenizers:
        if name not in TOKENIZERS:
            counts = _with_vocabulary(counts, name)
    return counts.select("doc_id", "source", "lang", *(f"`{t}`" for t in tokenizers))


def _with_vocabulary(counts: DataFrame, name: str) -> DataFrame:
    path = bpe.tokenizer_path(f"{name.partition('/')[0]}.json")

    def run(batches):
        own = bpe.tokenizer(path)
        for batch in batches:
            n = [sum(e[2] for e in own.entries(t or "")) for t in batch.column("text").to_pylist()]
            yield batch.append_column(name, pa.array(n, pa.int64()))

    schema = T.StructType([*counts.schema.fields, T.StructField(name, T.LongType())])
    return counts.mapInArrow(run, schema)


def inserted(counts: DataFrame, tokenizer: str) -> DataFrame:
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), F.col(f"`{tokenizer}`").alias("n_tokens"))


def deleted(counts: DataFrame, tokenizer: str) -> DataFrame:
    return inserted(counts, tokenizer).withColumns({"n_docs": -F.col("n_docs"), "n_tokens": -F.col("n_tokens")})


def revised(counts: DataFrame, tokenizer: str, before: Column, after: Column) -> DataFrame:
    """Documents whose count changes: the difference, and no change of the number of documents."""
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("long").alias("n_docs"), (after - before).cast("long").alias("n_tokens"))


def query(spark, sf_dir: str) -> DataFrame:
    """The totals after four batches over all documents, the first of which arrives twice.

    insert: every document under both tokenizers; delete: those labelled of quality 0; revise: those labelled toxic that
    are still there, whose pieces are counted as twice their words from now on; again: the insert batch once more.
    """
    rollup = Rollup(spark, f"{shared_dir(spark)}/corpusloom/rollup-{uuid.uuid4().hex}")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).withColumnRenamed("doc_id", "label_id")
    counts = written(counted(spark.read.parquet(f"{sf_dir}/documents.parquet"), *TOKENIZERS), "counts")
    marked = counts.join(labels, F.col("doc_id") == F.col("label_id"))
    inserts = inserted(counts, "words/1").union(inserted(counts, "pieces/1"))
    rollup.commit("insert", inserts)
    low = marked.where("quality = 0")
    rollup.commit("delete", deleted(low, "words/1").union(deleted(low, "pieces/1")))
    toxic = marked.where("toxic = 1 and quality is distinct from 0")
    rollup.commit("revise", revised(toxic, "pieces/1", F.col("`pieces/1`"), 2 * F.col("`words/1`")))
    rollup.commit("insert", inserts)
    return rollup.totals().select(*KEYS, F.col("n_docs").cast("long").alias("n_docs"), F.col("n_tokens").cast("long").alias("n_tokens"))


ORACLE = r"""
WITH c AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words,
         len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]'))::BIGINT AS pieces FROM documents
), l AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT c.*, l.quality, l.toxic FROM c LEFT JOIN l USING (doc_id)),
x AS (
  SELECT source, lang, 'words/1' AS tokenizer, CASE WHEN quality = 0 THEN 0 ELSE 1 END AS n_docs, CASE WHEN quality = 0 THEN 0 ELSE words END AS n_tokens FROM m
  UNION ALL
  SELECT source, lang, 'pieces/1', CASE WHEN quality = 0 THEN 0 ELSE 1 END, CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 2 * words ELSE pieces END FROM m
)
SELECT source, lang, tokenizer, sum(n_docs)::BIGINT AS n_docs, sum(n_tokens)::BIGINT AS n_tokens FROM x GROUP BY 1, 2, 3
"""
