"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode a new one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sequor-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def temporary(spark: SparkSession, label: str, write: Callable[[str], None]) -> str:
    """A new path in the shared folder that ``write`` fills, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/sequor-{label}-{uuid.uuid4().hex}"
    write(path)
    fs, at = _filesystem(spark, path)
    fs.deleteOnExit(at)
    return path


def materialize(df: DataFrame, label: str = "t", codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so that later steps start from files.

    The files outlive lost executors and go when the session's JVM ends, or
    earlier through :func:`release`.  ``codec`` is Parquet's, the session's if it is not given.
    """
    spark = df.sparkSession
    path = temporary(spark, label, lambda p: df.write.parquet(p, compression=codec))
    out = spark.read.schema(df.schema).parquet(path)
    out._sequor_path = path
    return out


def materialize_bucketed(df: DataFrame, key: str, buckets: int, label: str = "t") -> DataFrame:
    """As :func:`materialize`, in ``buckets`` by hash of ``key``: joins on it with rows dealt likewise leave these where they are."""
    spark = df.sparkSession
    name = f"sequor_{label}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/{name}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    fs, at = _filesystem(spark, path)
    fs.deleteOnExit(at)
    out = spark.table(name)
    out._sequor_path, out._sequor_table = path, name
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` or :func:`materialize_bucketed`."""
    if name := getattr(df, "_sequor_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    path = getattr(df, "_sequor_path", None)
    if path:
        fs, at = _filesystem(df.sparkSession, path)
        fs.delete(at, True)


def tasks(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for ``rows`` at ``per_task`` each, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))
