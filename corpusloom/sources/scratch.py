"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only in local mode, where there is one machine, may it be unset; then a temporary folder is used.
    """
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not set_to:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        own = getattr(shared_dir, "own", None)
        if own is None:
            own = shared_dir.own = tempfile.mkdtemp(prefix="corpusloom-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        set_to = f"file://{own}"
    return set_to.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
