"""Session defaults shared by the entry points, the tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(app: str = "settlepoint", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings a cluster would also use (AQE, UTC, Kryo-free defaults)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from its checkout, whatever folder the driver was started in.

    It changes nothing where the package is installed on the executors; the path is only added.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); only a local session gets one here."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="settlepoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/settlepoint/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete_path(spark: SparkSession, path: str) -> None:
    files, target = _file_system(spark, path)
    files.delete(target, True)


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Put a written folder in the place of another (one rename in the same store)."""
    files, to = _file_system(spark, target)
    files.delete(to, True)
    if not files.rename(_file_system(spark, source)[1], to):
        raise OSError(f"{source} could not be moved to {target}")


def clean_up(spark: SparkSession) -> None:
    """Delete what this application has put under the shared folder, once no result is read any more."""
    delete_path(spark, shared_path(spark, "x").rpartition("/")[0])
