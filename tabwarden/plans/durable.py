"""Intermediates that outlive the executors that made them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a local session that names none gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tabwarden-")


def durable(df: DataFrame) -> DataFrame:
    """Compute once, keep in the shared folder, and cut the lineage."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


_KEPT: list[tuple[SparkSession, str]] = []


def kept_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, until the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/tabwarden-table-{uuid.uuid4().hex}"
    _KEPT.append((spark, path))
    return path


def kept_table(df: DataFrame) -> DataFrame:
    """Write a table as Parquet into the shared folder and go on from there, until the driver ends.

    Names are kept beside the files, so they may repeat or hold any character.
    """
    spark = df.sparkSession
    path = kept_folder(spark)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain.write.parquet(path)
    return spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)


@atexit.register
def _remove_kept() -> None:
    for spark, path in _KEPT:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended already; the folder's owner clears it
            return
