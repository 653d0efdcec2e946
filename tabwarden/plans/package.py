"""From a folder of files to screened tables: one dataset per folder."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import rules
from ..functions import paths
from ..operators.duplicates import with_primary
from ..sources import files as listing, text_tables
from ..sources.sinks import LedgerStore
from ..sources.tables import Table, read_table
from .bisect import first_line
from .durable import durable
from .local import local_relation

ISSUES = "dataset_id string, level string, message string"


@dataclass(frozen=True)
class Package:
    """Tables of one folder, its file list with primaries, its archives and its issues."""

    tables: list[Table]
    files: DataFrame       # dataset_id, path, primary_path, loaded
    manifest: DataFrame    # dataset_id, archive_files, archive_sizes_mb, archive_sha256s
    issues: DataFrame      # dataset_id, level, message


def load_package(spark: SparkSession, folder: str, dataset_id: str,
                 labels: Mapping[str, Mapping[str, str]] | None = None, digests: LedgerStore | None = None) -> Package:
    """List files, find duplicates, and read every primary file that is a table.

    Only the file catalog reaches the driver, which has to plan one read per file.
    Contents are hashed for archives, and for files that have the length of another one.
    Archives are listed and not opened. Parquet, ORC and JSON files named part-* in one
    folder are one table. labels: optional column labels per relative path. digests: an index of
    digests from earlier runs, by which unchanged files are not hashed again.
    """
    labels = labels or {}
    rel = paths.relative_to(F.col("path"), F.lit(listing.qualified(spark, folder)))
    found = listing.list_files(spark, folder).select(F.col("path").alias("full_path"), rel.alias("path"), "length",
                                                       F.col("modificationTime").alias("modified"))
    is_archive = paths.archive_kind(F.col("path")).isNotNull() & ~paths.is_packed_text(F.col("path"))
    clean = durable(found.filter(~paths.is_junk(F.col("path"))).withColumn("is_archive", is_archive))

    shared = clean.filter("not is_archive").groupBy("length").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    twins = clean.filter("not is_archive").join(shared.select("length"), "length", "left_semi")
    to_hash = twins.unionByName(clean.filter("is_archive")).select("path", "full_path", "length", "modified")
    if digests is None:
        hashed = durable(listing.file_digests(to_hash.repartition(spark.sparkContext.defaultParallelism)))
    else:
        hashed = durable(listing.kept_digests(to_hash, digests))
    known = clean.join(hashed.select("path", "digest", "problem"), "path", "left").withColumn("dataset_id", F.lit(dataset_id))
    manifest = durable(listing.archive_manifest(known.filter("is_archive").select("dataset_id", "path", "length", "digest")))
    plain = known.filter("not is_archive").select("dataset_id", "path", "full_path", "digest")
    catalog = durable(with_primary(plain).withColumn("kind", paths.load_kind(F.col("path"))))

    to_read = [r for r in catalog.filter("path = primary_path and kind is not null").orderBy("path").collect()]
    tables, notes, loaded = _read_tables(spark, dataset_id, to_read, labels)
    done = local_relation(spark, [(p,) for p in loaded], "path string").distinct()
    files = (catalog.join(done.withColumn("loaded", F.lit(True)), "path", "left")
             .select("dataset_id", "path", "primary_path", F.coalesce("loaded", F.lit(False)).alias("loaded")))
    said = known.select(
        "dataset_id", F.when(F.col("problem").isNotNull(), "ERROR").when(F.col("is_archive"), "WARNING").alias("level"),
        F.concat("path", F.coalesce(F.concat(F.lit(": could not be read: "), "problem"),
                                    F.lit(": archives are not opened, unpack it first"))).alias("message"))
    issues = said.filter("level is not null").unionByName(local_relation(spark, [(dataset_id, lv, m) for lv, m in notes], ISSUES))
    return Package(tables, files, manifest, issues)


def _read_tables(spark, dataset_id, to_read, labels):
    """Tables, notes for the issues, and the paths that were loaded."""
    tables: list[Table] = []
    notes: list[tuple[str, str]] = []
    loaded: list[str] = []
    plain = [r for r in to_read if r.kind in ("delimited", "sniffed")]
    by_path = {re.sub("^[a-z0-9]+:/+", "/", r.full_path): r.path for r in plain}
    parts: dict[tuple[str, str], list] = {}
    for r in to_read:
        folder, _, name = r.path.rpartition("/")
        if r.kind == "columnar" and folder and name.startswith("part-"):
            parts.setdefault((folder, name.rsplit(".", 1)[1].lower()), []).append(r)

    dialects: dict[str, tuple] = {}
    if plain:
        lines = text_tables.file_lines(spark, [r.full_path for r in plain])
        heads = lines.filter("in_head")
        csv = F.lower("path").rlike(r"\.csv(\.(gz|bz2))?$")
        marks = text_tables.detect_csv_delimiters(heads.filter(csv)).unionByName(
            text_tables.detect_delimiters(heads.filter(~csv)))
        checked = (text_tables.line_checks(lines).join(marks, "path", "left")
                   .join(text_tables.first_lines(lines), "path", "left").collect())      # one row per file
        dialects = {by_path[r.path]: r for r in checked}

    for (folder, ending), own in parts.items():
        try:
            whole = own[0].full_path.rpartition("/")[0]
            tables.append(read_table(spark, f"{whole}/part-*.{ending}", ending, file=folder, dataset_id=dataset_id,
                                     labels=labels.get(folder, {})))
            loaded += [r.path for r in own]
        except Exception as e:
            notes.append(("ERROR", f"{folder}: could not be read: {e}"))
    in_folders = {r.path for own in parts.values() for r in own}
    alone: dict[str, tuple] = {}
    alike: dict[str, text_tables.TextFile] = {}
    for r in plain:
        d = dialects.get(r.path)
        delimiter, encoding, multi_line = (d.delimiter, d.encoding, d.multi_line) if d else (None, "UTF-8", False)
        if encoding != "UTF-8":
            notes.append(("WARNING", f"{r.path}: not UTF-8, read as {encoding}"))
        if r.kind == "sniffed" and delimiter is None:
            continue
        name = re.sub(r"\.(gz|bz2)$", "", r.path.lower())
        if r.kind == "delimited" and not name.endswith(".csv"):
            delimiter = "\t"
        elif delimiter is None:
            notes.append(("WARNING", f"{r.path}: no delimiter found, read with commas"))
            delimiter = ","
        header = None if d is None else d.latin_header if encoding == "windows-1252" else d.header
        names = text_tables.header_names(header, delimiter) if header and encoding != "UTF-16" else None
        if names is None:
            alone[r.path] = (delimiter, encoding, multi_line)
        else:
            alike[r.path] = text_tables.TextFile(r.full_path, delimiter, encoding, multi_line, names)
    copies, failed = text_tables.load_many(spark, list(alike.values()))
    problems = {f.path: first_line(e) for f, e in failed}
    for r in to_read:
        if r.path in in_folders:
            continue
        args = {"file": r.path, "dataset_id": dataset_id, "labels": labels.get(r.path, {})}
        try:
            if r.kind == "columnar":
                tables.append(read_table(spark, r.full_path, r.path.rsplit(".", 1)[1].lower(), **args))
                loaded.append(r.path)
                continue
            if r.path in alike:
                if r.full_path in problems:
                    raise ValueError(problems[r.full_path])
                df, too_long = copies[r.full_path]
                table = Table(df, **args)
            elif r.path in alone:
                table, too_long = text_tables.load_delimited(spark, r.full_path, *alone[r.path], **args)
            else:
                continue
            if too_long:
                notes.append(("WARNING", f"{r.path}: {too_long} lines with more fields than the header were left out"))
            tables.append(table)
            loaded.append(r.path)
        except Exception as e:  # one unreadable file must not end the run
            notes.append(("ERROR", f"{r.path}: could not be read: {first_line(e)}"))
    return tables, notes, loaded
