"""File inventory: listing, junk filter, digests, format gate, archive manifest."""

from __future__ import annotations

import hashlib
import sys
from urllib.parse import quote

from pyarrow.fs import FileSystem
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import paths
from ..plans.durable import durable
from .sinks import LedgerStore

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE_BYTES = 4 << 20


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with scheme and authority, as file listings show it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modificationTime and content below folder; unused columns are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def inventory(spark: SparkSession, folder: str, dataset_id: str) -> DataFrame:
    """Files of one package without junk, with relative paths and how each would be read."""
    rel = paths.relative_to(F.col("path"), F.lit(qualified(spark, folder)))
    return (list_files(spark, folder)
            .select(F.lit(dataset_id).alias("dataset_id"), F.col("path").alias("full_path"),
                    rel.alias("path"), "length")
            .filter(~paths.is_junk(F.col("path")))
            .withColumns({"archive_kind": paths.archive_kind(F.col("path")),
                          "load_kind": paths.load_kind(F.col("path"))}))


def file_digests(files: DataFrame) -> DataFrame:
    """Add digest and problem to rows with full_path. Contents of any size pass through the tasks in pieces.

    A file that cannot be read has no digest, and the reason stands in problem.
    """
    schema = files.withColumns({"digest": F.lit(None).cast("string"), "problem": F.lit(None).cast("string")}).schema

    def run(batches):
        for batch in batches:
            found = [_digest(path) for path in batch["full_path"]]
            yield batch.assign(digest=[d for d, _ in found], problem=[p for _, p in found])

    return files.mapInPandas(run, schema)


def kept_digests(files: DataFrame, index: LedgerStore) -> DataFrame:
    """The same, where contents are read only of files that the index does not know.

    files: full_path, length, modified and others. A file is known by path, length and time of change;
    one that changed twice within that time and kept its length is not noticed. The index is a versioned
    table, so that several drivers may add to it; what has no digest stays out and is tried again.
    """
    key = ["full_path", "length", "modified"]
    held = index.read()
    known = files.limit(0).select(*key, F.lit("").alias("digest")) if held is None else held.select(*key, "digest")
    marked = files.join(known, key, "left")
    new = durable(file_digests(marked.filter("digest IS NULL").drop("digest").repartition(
        files.sparkSession.sparkContext.defaultParallelism)))
    fresh = new.filter("digest IS NOT NULL").select(*key, "digest").dropDuplicates(["full_path"])
    if not fresh.isEmpty():
        index.update(lambda now: fresh if now is None else
                     now.join(fresh.select("full_path"), "full_path", "left_anti").select(*key, "digest").unionByName(fresh), keep=2)
    return marked.filter("digest IS NOT NULL").withColumn("problem", F.lit(None).cast("string")).unionByName(new)


def _digest(path: str) -> tuple[str | None, str | None]:
    whole = hashlib.sha256()
    try:
        system, inner = FileSystem.from_uri(quote(path, safe=":/"))
        with system.open_input_stream(inner, compression=None) as stream:
            while piece := stream.read(PIECE_BYTES):
                whole.update(piece)
    except (OSError, ValueError) as e:
        return None, str(e).splitlines()[0] if str(e) else type(e).__name__
    return whole.hexdigest(), None


def archive_manifest(files: DataFrame, by: str = "dataset_id") -> DataFrame:
    """Names, sizes in MB and digests of the top-level archives of each package, joined in name order.

    files: (dataset_id, path, length, digest). The three cells are part of the
    package's summary row, so a package's archive list is one row by design.
    """
    top: Column = ~F.col("path").contains("/") & paths.archive_kind(F.col("path")).isNotNull()
    size = F.format_string("%s", F.round(F.col("length") / 1024 / 1024, 2))
    listed = F.array_sort(F.collect_list(F.struct("path", size.alias("size"), "digest")))
    per = files.filter(top).groupBy(by).agg(listed.alias("a"))
    return per.select(by, *[
        F.array_join(F.col(f"a.{f}"), "; ").alias(n)
        for f, n in (("path", "archive_files"), ("size", "archive_sizes_mb"), ("digest", "archive_sha256s"))])
