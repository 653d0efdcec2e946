"""Digests kept between runs: only files that are new or changed are opened."""

import hashlib
import os

from pyspark.sql import functions as F

from tabwarden.plans.package import load_package
from tabwarden.sources import files
from tabwarden.sources.sinks import LedgerStore


def listed(spark, folder):
    return files.list_files(spark, str(folder)).select(F.col("path").alias("full_path"), "length", F.col("modificationTime").alias("modified"))


def test_unchanged_files_are_not_opened(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(4):
        (folder / f"f{i}.bin").write_bytes(b"x" * i + b"y")
    index = LedgerStore(spark, str(tmp_path / "index"))

    def digests():
        return {r.full_path.rsplit("/", 1)[1]: (r.digest, r.problem) for r in files.kept_digests(listed(spark, folder), index).collect()}

    first = digests()
    assert first == {f"f{i}.bin": (hashlib.sha256(b"x" * i + b"y").hexdigest(), None) for i in range(4)}
    at = (folder / "f1.bin").stat()
    (folder / "f1.bin").write_bytes(b"zz")                      # other content behind the same length and time:
    os.utime(folder / "f1.bin", ns=(at.st_atime_ns, at.st_mtime_ns))
    (folder / "f2.bin").write_bytes(b"changed")
    (folder / "f9.bin").write_bytes(b"new")
    second = digests()
    assert second["f1.bin"] == first["f1.bin"] and second["f0.bin"] == first["f0.bin"]     # so it was not opened
    assert second["f2.bin"][0] == hashlib.sha256(b"changed").hexdigest() and second["f9.bin"][0]
    assert index.read().count() == 5 and index.versions() == [1, 2]
    assert digests() == second and index.versions() == [1, 2]


def test_a_file_that_cannot_be_read_is_tried_again(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"a")
    rows = listed(spark, tmp_path).unionByName(
        listed(spark, tmp_path).withColumn("full_path", F.concat("full_path", F.lit(".gone"))))
    index = LedgerStore(spark, str(tmp_path / "index"))
    got = {r.full_path[-6:]: r for r in files.kept_digests(rows, index).collect()}
    assert got["n.gone"[-6:]].problem and got["/a.bin"].digest and index.read().count() == 1


def test_packages_take_their_digests_from_the_index(spark, tmp_path, monkeypatch):
    folder = tmp_path / "pkg"
    folder.mkdir()
    for name in ("a.csv", "b.csv"):
        (folder / name).write_text("id,who\n" + "".join(f"{i + 5000},person {i}\n" for i in range(5)))
    index = LedgerStore(spark, str(tmp_path / "index"))

    def primaries():
        pkg = load_package(spark, str(folder), "d", digests=index)
        return sorted((r.path, r.primary_path, r.loaded) for r in pkg.files.collect())

    want = primaries()
    assert want == [("a.csv", "a.csv", True), ("b.csv", "a.csv", False)]
    monkeypatch.setattr(files, "file_digests", lambda rows: rows.filter("false").withColumns(
        {"digest": F.lit(None).cast("string"), "problem": F.lit(None).cast("string")}))
    assert primaries() == want
