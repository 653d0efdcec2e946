"""Tables that a job writes to the shared folder and reads again, so that no executor's loss undoes them."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.durable import shared_folder

_MADE: dict[str, SparkSession] = {}


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is there goes when the driver ends, or by `dropped`."""
    path = f"{shared_folder(spark).rstrip('/')}/tabwarden-{label}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Compute once, keep as Parquet in the shared folder, and go on from there."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for df in tables:
        _remove(getattr(df, "_stored_path", None))


def _remove(path: str | None) -> None:
    spark = _MADE.pop(path, None)
    if spark is None or spark.sparkContext._jsc is None:
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def remove_path(path: str) -> None:
    _remove(path)


@atexit.register
def _remove_all() -> None:
    for path in list(_MADE):
        try:
            _remove(path)
        except Exception:  # the session may be gone by now; the folder's owner clears it then
            return
