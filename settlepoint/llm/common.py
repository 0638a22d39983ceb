"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; only a local session gets one here."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="settlepoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/settlepoint/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder once and read back (each run has its own path)."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clean_up(spark: SparkSession) -> None:
    """Delete what the operators have written for this application, once no result is read any more."""
    delete_path(spark, own_dir(spark))


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bound what one Arrow batch of whole texts holds in a Python worker.

    Plans read these settings when they run, so they stay; they are only ever lowered, and so hold for every
    plan of the session whatever order its operators are called in.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", 32 << 20)):
        now = re.match(r"[0-9]+", spark.conf.get(f"spark.sql.execution.arrow.{key}"))
        if now is None or not 0 < int(now[0]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def spare(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as none of the columns (in any case) bears it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
