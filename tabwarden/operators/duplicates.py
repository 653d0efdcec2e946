"""Files (or rows) with equal content, and results copied onto duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .skew import join_many_to_few


def content_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def duplicate_groups(files: DataFrame, path: str = "path", digest: str = "digest",
                     within: str | None = None) -> DataFrame:
    """(within, digest, primary_path, n_files) per content; the least path is the primary.

    Copies fold into one row per task before the shuffle, however many there are.
    """
    keys = [digest] if within is None else [within, digest]
    return (files.filter(F.col(digest).isNotNull()).groupBy(*keys)
            .agg(F.min(path).alias("primary_path"), F.count(F.lit(1)).alias("n_files")))


def with_primary(files: DataFrame, path: str = "path", digest: str = "digest", within: str | None = "dataset_id",
                 at_least: int = 100_000) -> DataFrame:
    """Add primary_path; files that are unique or have no digest are their own primary.

    Only files of one dataset are copies of each other.
    """
    keys = [digest] if within is None else [within, digest]
    groups = duplicate_groups(files, path, digest, within).select(*keys, "primary_path")
    known = join_many_to_few(files.filter(F.col(digest).isNotNull()), groups, keys, path, at_least=at_least)
    unknown = files.filter(F.col(digest).isNull()).withColumn("primary_path", F.col(path))
    return known.unionByName(unknown)


def copy_to_duplicates(results: DataFrame, files: DataFrame, at_least: int = 100_000) -> DataFrame:
    """Results of primaries plus a copy for each duplicate file of the same dataset.

    results: rows with dataset_id, file and duplicate_of. files: (dataset_id, path,
    primary_path). Only primaries with results pass any on.
    """
    dups = (files.filter(F.col("path") != F.col("primary_path"))
            .select("dataset_id", F.col("path").alias("dup_path"), F.col("primary_path").alias("file")))
    copied = join_many_to_few(dups, results, ["dataset_id", "file"], "dup_path", at_least=at_least)
    copied = copied.withColumn("duplicate_of", F.col("file")).withColumn("file", F.col("dup_path"))
    return results.unionByName(copied.select(*results.columns))
