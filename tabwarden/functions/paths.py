"""Path expressions: parts, extension, junk and archive tests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import rules

TAR_ENDINGS = (".tar.gz", ".tar.bz2", ".tgz", ".tar")
TEXT_ENDINGS = ("csv", "tsv", "tab")
SNIFFED_ENDINGS = ("txt", "dat")
COLUMNAR_ENDINGS = ("parquet", "orc", "json")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case ending after the last dot, '' when there is none."""
    return F.lower(F.regexp_extract(base_name(path), r".\.([^.]*)$", 1))


def relative_to(path: Column, root: Column) -> Column:
    """The part of path below root; the scheme of either side does not matter."""
    def bare(c: Column) -> Column:
        return F.regexp_replace(c, r"^[a-z0-9]+:/+", "/")
    return F.regexp_replace(F.substr(bare(path), F.length(bare(root)) + 1), "^/+", "")


def is_junk(rel_path: Column) -> Column:
    """Hidden entries, desktop leftovers and resource-fork folders, at any depth."""
    parts = F.split(rel_path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.lower(F.element_at(parts, -1))
    return (
        name.startswith(".")
        | name.isin(*rules.JUNK_FILES)
        | F.exists(folders, lambda p: p.startswith(".") | (F.lower(p) == rules.JUNK_FOLDER))
    )


def archive_kind(path: Column) -> Column:
    """zip, tar, gz, 7z, rar, or null for a file that is no archive."""
    name = F.lower(base_name(path))
    tar = F.lit(False)
    for ending in TAR_ENDINGS:
        tar = tar | name.endswith(ending)
    return (
        F.when(tar, "tar").when(name.endswith(".gz"), "gz").when(name.endswith(".zip"), "zip")
        .when(name.endswith(".rar"), "rar").when(name.endswith(".7z"), "7z")
    )


def is_packed_text(path: Column) -> Column:
    """A single delimited text under gzip or bzip2, which Spark reads by itself."""
    return F.lower(path).rlike(r"\.(csv|tsv|tab|txt|dat)\.(gz|bz2)$")


def load_kind(path: Column) -> Column:
    """How a file is read: delimited, sniffed, columnar, or null when it is not a table."""
    ext = extension(F.regexp_replace(path, r"(?i)(\.(?:csv|tsv|tab|txt|dat))\.(?:gz|bz2)$", "$1"))
    return (
        F.when(ext.isin(*TEXT_ENDINGS), "delimited").when(ext.isin(*SNIFFED_ENDINGS), "sniffed")
        .when(ext.isin(*COLUMNAR_ENDINGS), "columnar")
    )
