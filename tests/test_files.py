"""Folders, delimited text, and the resumable batch."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tabwarden import rules
from tabwarden.plans.batch import list_packages, run_folder, screen_packages
from tabwarden.plans.package import load_package
from tabwarden.sources import files, text_tables
from tabwarden.sources.sinks import LedgerStore
from tabwarden.sources.tables import read_table

CSV = "id,name,when\n1,Ann Lee,2020-01-01\n2,NA,\n3,Bob,x\n"


@pytest.fixture
def package(tmp_path):
    root = tmp_path / "pkgs" / "study one"
    (root / "sub").mkdir(parents=True)
    (root / "a.csv").write_text(CSV)
    (root / "sub" / "copy of a.csv").write_text(CSV)
    (root / "b.tsv").write_text("x\ty\n1\t2.5\n-3\t1e3\n")
    (root / "c.txt").write_text("k;v\n\n1;a,b\n2;c\n")
    (root / "prose.txt").write_text("Dear reader,\nthis, that, and more.\nBye\n")
    (root / "d.dat").write_text("p|q\n1|2\n")
    (root / "quoted.csv").write_text('k,text\n1,"two\nlines"\n2,"a ""b"""\n')
    (root / "latin.csv").write_bytes("city;n\nMálaga – x;1\n".encode("cp1252"))
    (root / "image.png").write_bytes(b"\x89PNG")
    (root / ".DS_Store").write_text("junk")
    (root / "__MACOSX").mkdir()
    (root / "__MACOSX" / "z.csv").write_text(CSV)
    (root / "semi.csv").write_text('k;v\n1;"a;b"\n2;c\n')
    (root / "ragged.csv").write_text("a,b,c\n1,2,3\n4,5\n6,7,8,9\n")
    (root / "late.csv").write_bytes(b"t,n\n" + b"plain,1\n" * 300_000 + "café,2\n".encode("cp1252"))
    (root / "wide.csv").write_text("p,q\n1,é\n", encoding="utf-16")
    (root / "packed.csv.gz").write_bytes(gzip.compress(b"w,z\n1,2\n"))
    (root / "pack.zip").write_bytes(b"zip bytes")
    (root / "tape.tar.gz").write_bytes(b"tar bytes")
    return root


def test_inventory_and_manifest(spark, package):
    listed = {r.path: r for r in files.inventory(spark, str(package), "d").collect()}
    assert ".DS_Store" not in listed and "__MACOSX/z.csv" not in listed
    assert listed["sub/copy of a.csv"].load_kind == "delimited" and listed["pack.zip"].archive_kind == "zip"
    assert listed["image.png"].load_kind is None
    m = load_package(spark, str(package), "d").manifest.first()
    assert m.archive_files == "pack.zip; tape.tar.gz" and m.archive_sizes_mb == "0.0; 0.0"
    assert m.archive_sha256s == "; ".join(hashlib.sha256(b).hexdigest() for b in (b"zip bytes", b"tar bytes"))


def test_files_of_any_size_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PIECE_BYTES", 7)
    (tmp_path / "a b%.bin").write_bytes(b"x" * 100)
    with open(tmp_path / "huge.bin", "wb") as f:
        f.truncate(3 << 30)
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    rows = spark.createDataFrame([(f"file:{tmp_path}/a b%.bin",), (f"file:{tmp_path}/none",)], "full_path string")
    got = {r.full_path.rsplit("/", 1)[1]: r for r in files.file_digests(rows).collect()}
    assert got["a b%.bin"].digest == hashlib.sha256(b"x" * 100).hexdigest() and got["none"].digest is None
    assert got["none"].problem
    pkg = load_package(spark, str(tmp_path), "d")     # a length of its own needs no hash
    assert [t.file for t in pkg.tables] == ["t.csv"] and pkg.files.count() == 3


def test_package_tables(spark, package):
    spark.range(100).write.parquet(f"file:{package}/lake")
    pkg = load_package(spark, str(package), "d", labels={"a.csv": {"name": "Full name"}})
    tables = {t.file: t for t in pkg.tables}
    assert sorted(tables) == ["a.csv", "b.tsv", "c.txt", "d.dat", "lake", "late.csv", "latin.csv", "packed.csv.gz", "quoted.csv",
                              "ragged.csv", "semi.csv", "wide.csv"]
    assert tables["lake"].df.count() == 100
    assert [tuple(r) for r in tables["quoted.csv"].df.collect()] == [(1, "two\nlines"), (2, 'a "b"')]
    assert tables["a.csv"].df.dtypes == [("id", "bigint"), ("name", "string"), ("when", "string")]
    assert [tuple(r) for r in tables["a.csv"].df.orderBy("id").collect()] == [
        (1, "Ann Lee", "2020-01-01"), (2, None, None), (3, "Bob", "x")]
    assert tables["b.tsv"].df.dtypes == [("x", "bigint"), ("y", "double")]
    assert tables["c.txt"].df.columns == ["k", "v"] and tables["c.txt"].df.count() == 2
    assert tables["latin.csv"].df.first().city == "Málaga – x"
    assert [tuple(r) for r in tables["packed.csv.gz"].df.collect()] == [(1, 2)]
    assert sorted(tuple(r) for r in tables["semi.csv"].df.collect()) == [(1, "a;b"), (2, "c")]
    assert sorted(map(tuple, tables["ragged.csv"].df.collect())) == [(1, 2, 3), (4, 5, None)]
    assert tables["late.csv"].df.filter("t = 'café'").count() == 1
    assert [tuple(r) for r in tables["wide.csv"].df.collect()] == [(1, "é")]
    rows = {r.path: (r.primary_path, r.loaded) for r in pkg.files.collect()}
    assert rows["sub/copy of a.csv"] == ("a.csv", False) and "pack.zip" not in rows
    assert rows["prose.txt"] == ("prose.txt", False) and rows["a.csv"] == ("a.csv", True)
    levels = sorted((r.level, r.message.split(":")[0]) for r in pkg.issues.collect())
    assert levels == [("WARNING", n) for n in ("late.csv", "latin.csv", "pack.zip", "ragged.csv", "tape.tar.gz", "wide.csv")]


def test_dialects(spark):
    texts = {"comma": ["a,b", "c,d"], "ragged": ["a,b", "c"], "blank": ["a;b", "  ", "c;d"], "both": ["a,b;c;d", "e,f;g;h"],
             "none": ["word"], "late": ["a|b"] * 10 + ["x"], "tie": ["a,b\tc"]}
    lines = spark.createDataFrame([(p, i, s) for p, ls in texts.items() for i, s in enumerate(ls)],
                                  "path string, line_no bigint, line string")
    got = {r.path: r.delimiter for r in text_tables.detect_delimiters(lines).collect()}
    assert got == {"comma": ",", "ragged": None, "blank": ";", "both": ";", "none": None, "late": "|", "tie": "\t"}


def test_csv_marks_are_counted_outside_quotes(spark):
    texts = {"semi": ['k;v', '1;"a;b"', '2;c'], "comma": ['a,b', '"x;y;z",2', '"p;q;r",4'], "none": ["word"],
             "mostly": ["a|b", "1|2", "3|4", "oops"], "open": ['a,b', '1,"x;;;;']}
    lines = spark.createDataFrame([(p, i, s) for p, ls in texts.items() for i, s in enumerate(ls)],
                                  "path string, line_no bigint, line string")
    got = {r.path: r.delimiter for r in text_tables.detect_csv_delimiters(lines).collect()}
    assert got == {"semi": ";", "comma": ",", "mostly": "|", "open": ","}


def test_missing_markers_and_types(spark):
    near = ["Na", " NA", "nil", "NULLs", "-"]
    df = spark.createDataFrame([(t,) for t in [*rules.MISSING_TOKENS, *near]], "v string")
    assert [r.v for r in text_tables.null_missing(df).filter("v is not null").collect()] == near
    rows = [("1", "True", "1.5", "007", "x", None, "True", "9" * 25), ("2", "False", "inf", "8", "1", None, None, "1")]
    df = spark.createDataFrame(rows, "i string, b string, d string, z string, s string, e string, bn string, big string")
    assert dict(text_tables.infer_types(df).dtypes) == {
        "i": "bigint", "b": "boolean", "d": "double", "z": "bigint", "s": "string", "e": "double", "bn": "string", "big": "double"}


def test_bad_lines_and_row_cap(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("a,b\n1,2\n3,4,5\n6,7\n")
    assert text_tables.read_delimited(spark, str(path)).df.count() == 2
    assert text_tables.read_delimited(spark, str(path), max_rows=9).df.count() == 2
    assert text_tables.read_delimited(spark, str(path), max_rows=1).df.count() == 1
    spark.range(9).write.parquet(str(tmp_path / "p"))
    assert read_table(spark, str(tmp_path / "p"), max_rows=4).df.count() == 4


def test_batch_resumes(spark, package, tmp_path):
    root = package.parent
    (root / "empty").mkdir()
    (root / "only_rar").mkdir()
    (root / "only_rar" / "x.rar").write_bytes(b"r")
    (root / "__MACOSX").mkdir()
    assert [p.rsplit("/", 1)[1] for p in list_packages(spark, str(root))] == ["empty", "only_rar", "study one"]
    store = LedgerStore(spark, str(tmp_path / "ledger"))
    seen = []

    def responder(ps):
        return ['{"evaluation": "direct_pii", "reasoning": "r"}' if "Column: name" in p else '{"evaluation": "not_pii"}' for p in ps]

    done = run_folder(spark, str(root), store, str(tmp_path / "out"), responder=responder, model="m", waits=(0, 0, 0))
    got = {r.package_path.rsplit("/", 1)[1]: r for r in done.collect()}
    assert got["empty"].status == rules.STATUS_NO_FILES and got["only_rar"].status == rules.STATUS_RAR
    one = got["study one"]
    assert (one.status, one.n_data_files, one.n_duplicates, one.n_direct_pii, one.model) == ("done", 11, 1, 2, "m")
    saved = spark.read.parquet(f"{tmp_path}/out/results")
    assert saved.filter("dataset_id = 'study one' and duplicate_of = 'a.csv'").count() == 2

    def never(folders):
        seen.extend(folders)
        raise RuntimeError("boom")

    again = run_folder(spark, str(root), store, str(tmp_path / "out"), run_many=never)
    assert not seen and sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, done.collect()), key=repr)
    store.write(store.read().withColumn("status", F.when(F.col("status") == "done", "running").otherwise(F.col("status"))))
    failed = run_folder(spark, str(root), store, str(tmp_path / "out"), run_many=never)
    assert len(seen) == 1 and failed.filter("status = 'error' and n_data_files = 11").count() == 1


def test_packages_share_a_run_and_fail_alone(spark, tmp_path):
    root = tmp_path / "pkgs"
    for name in ("p1", "p2", "p3"):
        (root / name).mkdir(parents=True)
        (root / name / "t.csv").write_text("id,who\n" + "".join(f"{i + 5000},person {name} {i}\n" for i in range(5)))
    store = LedgerStore(spark, str(tmp_path / "ledger"))
    asked = []

    def run_many(folders):
        asked.append([f[-2:] for f in folders])
        if any(f.endswith("p2") for f in folders):
            raise RuntimeError("p2 is bad")
        return screen_packages(spark, folders, str(tmp_path / "out"))

    done = run_folder(spark, str(root), store, str(tmp_path / "out"), run_many=run_many)
    assert asked == [["p1", "p2", "p3"], ["p1"], ["p2"], ["p3"]]
    assert {r.package_path[-2:]: r.status for r in done.collect()} == {"p1": "done", "p2": "error", "p3": "done"}
    both = screen_packages(spark, [f"{root}/p1", f"{root}/p2"], str(tmp_path / "both"))
    assert [both[f"{root}/{p}"]["n_checked"] for p in ("p1", "p2")] == [2, 2]
    saved = spark.read.parquet(f"{tmp_path}/both/results")
    assert sorted((r.dataset_id, r.col_name) for r in saved.collect()) == [
        ("p1", "id"), ("p1", "who"), ("p2", "id"), ("p2", "who")]
    assert spark.read.parquet(f"{tmp_path}/both/metadata").filter("package_path like '%p1'").count() == 1
