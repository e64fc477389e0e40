"""A cache of what is made of texts, by their content: summaries, questions, vectors. Only texts that are new or changed are made again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.encoding import Encoder, prefixed
from corpusloom.sources.scratch import written

#: Makes (digest, output) of (digest, text): the place to plug in a model, be it a library in the tasks or a service.
Maker = Callable[[DataFrame], DataFrame]
#: Texts that hold over one in HOT_SHARE of all rows; fewer than HOT_SHARE, whatever the table, so their outputs are broadcast.
HOT_SHARE = 1000


def digest(version: str, text: Column) -> Column:
    """The SHA-256 of a version (of prompt, model and settings) and a text; null counts as empty."""
    return F.sha2(F.concat(F.lit(f"{version}\0"), F.coalesce(text.cast("string"), F.lit(""))), 256)


class ContentCache:
    """Outputs by digest, in a folder of Parquet parts. Parts are only ever added, each with one name of its own, so that a run that fails leaves what is there.

    kind: the type of an output, as in a schema. made: how many texts the latest call of filled() gave out.
    """

    def __init__(self, spark: SparkSession, path: str, version: str, kind: str = "string"):
        self.spark, self.path, self.version, self.kind = spark, path.rstrip("/"), version, kind
        self.made = 0

    def _parts(self) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(root)] if files.exists(root) else []
        return [f"{self.path}/{n}" for n in names if n.startswith("part=") and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]

    def stored(self) -> DataFrame:
        """(digest, output), one row a digest, of all complete parts."""
        schema = f"digest string, output {self.kind}"
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*parts).dropDuplicates(["digest"])

    def filled(self, rows: DataFrame, text: Column, out: str, make: Maker) -> DataFrame:
        """rows with out: the output of each text. The distinct texts that are not stored go to make, and what it returns is stored.

        A text that make returns nothing for has a null output, and is given out again the next time.
        """
        named = written(rows.withColumns({"_digest": digest(self.version, text), "_text": F.coalesce(text.cast("string"), F.lit(""))}), "named")
        sizes = written(named.groupBy(F.col("_digest").alias("digest")).agg(F.count("*").alias("n"), F.first("_text").alias("text")), "distinct")
        missing = written(sizes.join(self.stored(), "digest", "left_anti").select("digest", "text"), "missing")
        self.made = missing.count()
        if self.made:
            make(missing).select("digest", F.col("output").cast(self.kind)).write.parquet(f"{self.path}/part={uuid.uuid4().hex}")
        outputs = written(sizes.select("digest", "n").join(self.stored(), "digest", "left"), "outputs")
        most = F.lit(named.count()) / HOT_SHARE
        hot = outputs.where(F.col("n") > most).select(F.col("digest").alias("_of"), F.col("output").alias(out))
        cold = outputs.where(F.col("n") <= most).select(F.col("digest").alias("_of"), F.col("output").alias(out))
        same = F.col("_digest") == F.col("_of")
        met = named.join(F.broadcast(hot), same).unionByName(named.join(F.broadcast(hot.select("_of")), same, "left_anti").join(cold, same))
        return met.select(*rows.columns, out)


class CachedEncoder(Encoder):
    """An encoder whose vectors are kept by content: a text with its prefix is encoded once."""

    def __init__(self, encoder: Encoder, cache: ContentCache):
        self.encoder, self.cache = encoder, cache

    def encode(self, texts: DataFrame, key: str, text: str, prefix: str = "") -> DataFrame:
        make = lambda missing: self.encoder.encode(missing, "digest", "text").withColumnRenamed("vector", "output")
        rows = texts.select(F.col(key), prefixed(prefix, F.col(text)).alias("_shown"))
        return self.cache.filled(rows, F.col("_shown"), "vector", make).select(key, "vector")
