"""Duplicates, counts, overview, throughput, ledger."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabwarden import rules
from tabwarden.operators import duplicates, ledger, reports, skew
from tabwarden.sources.sinks import LedgerStore, save_results


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join_equals_plain_join(spark, how):
    many = spark.range(3000).selectExpr("id as r", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then 'warm' "
                                        "else concat('k', id % 90) end as k")
    few = spark.range(80).selectExpr("concat('k', id) as k", "id as x").unionByName(
        spark.createDataFrame([("hot", 1), ("hot", 2)], "k string, x bigint"))
    plain = many.join(few, "k", how)
    assert same(skew.join_many_to_few(many, few, "k", "r", how, at_least=500, salts=8), plain)
    assert same(skew.join_many_to_few(many, few, "k", "r", how), plain)
    assert skew.hot_keys(many, "k", 500).count() == 2


def test_duplicates_least_path_wins_and_unhashed_stand_alone(spark):
    files = spark.createDataFrame([("b", "1"), ("a", "1"), ("c", "2"), ("d", None), ("e", None)], "path string, digest string")
    two = files.withColumn("dataset_id", F.lit("p")).unionByName(files.filter("path <> 'a'").withColumn("dataset_id", F.lit("q")))
    for at_least in (1, 100):
        got = {r.path: r.primary_path for r in duplicates.with_primary(files, within=None, at_least=at_least).collect()}
        assert got == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}
        got = {(r.dataset_id, r.path): r.primary_path for r in duplicates.with_primary(two, at_least=at_least).collect()}
        assert got[("p", "b")] == "a" and got[("q", "b")] == "b" and len(got) == 9
    import hashlib
    data = b"hello world" * 5000
    df = spark.createDataFrame([(bytearray(data),)], "content binary")
    assert df.select(duplicates.content_digest(F.col("content"))).first()[0] == hashlib.sha256(data).hexdigest()


def test_copies_come_only_from_primaries_with_results(spark):
    results = spark.createDataFrame([("p", "a", "c1", "direct_pii", ""), ("p", "a", "c2", "not_pii", ""), ("q", "a", "c1", "error", "")],
                                    "dataset_id string, file string, col_name string, evaluation string, duplicate_of string")
    files = spark.createDataFrame([("p", "a", "a"), ("p", "b", "a"), ("p", "x", "x"), ("p", "y", "x"), ("q", "a", "a")],
                                  "dataset_id string, path string, primary_path string")
    for at_least in (1, 100):
        got = sorted(map(tuple, duplicates.copy_to_duplicates(results, files, at_least).collect()))
        assert got == [("p", "a", "c1", "direct_pii", ""), ("p", "a", "c2", "not_pii", ""),
                       ("p", "b", "c1", "direct_pii", "a"), ("p", "b", "c2", "not_pii", "a"), ("q", "a", "c1", "error", "")]


def test_result_and_issue_counts(spark):
    results = spark.createDataFrame([("d", "direct_pii", ""), ("d", "direct_pii", "a.csv"), ("d", "internal_id", ""),
                                     ("d", "not_pii", ""), ("e", "error", "")],
                                    "dataset_id string, evaluation string, duplicate_of string")
    got = {r.dataset_id: tuple(r)[1:] for r in reports.result_counts(results).collect()}
    assert got == {"d": (3, 2, 0, 1), "e": (1, 0, 0, 0)}
    issues = spark.createDataFrame([("d", "WARNING"), ("d", "ERROR"), ("d", "WARNING")], "dataset_id string, level string")
    assert tuple(reports.issue_counts(issues).first()) == ("d", 2, 1)


def test_overview_of_an_unfinished_run(spark):
    run = spark.createDataFrame([("p", "p", 2, "", 5)], "dataset_id string, package_name string, n_direct_pii bigint, "
                                                         "ended string, other bigint")
    rows = [(r.metric, r.value) for r in reports.overview(run).orderBy("ord").collect()]
    assert rows == [("Package", "p"), ("Flagged: direct PII", "2"), ("Run finished", "not finished (partial results)")]
    done = reports.overview(run.withColumn("ended", F.lit("2026-01-01 00:00:00")))
    assert done.filter("metric = 'Run finished'").first().value == "2026-01-01 00:00:00"
    assert reports.key_values(run).count() == 4


def test_usage_and_throughput(spark):
    log = spark.createDataFrame([("d", 10, 5, 1.5), ("d", 20, 1, 0.5)],
                                "dataset_id string, prompt_tokens bigint, completion_tokens bigint, seconds double")
    assert tuple(reports.usage_totals(log, "dataset_id").first()) == ("d", 2, 30, 6, 2.0)
    t = dt.datetime(2024, 1, 1, 10, 0, 59)
    times = spark.createDataFrame([(t,), (t + dt.timedelta(seconds=1),), (t + dt.timedelta(seconds=30),)], "ts timestamp")
    assert sorted(map(tuple, reports.throughput(times).collect())) == [
        ("2024-01-01 10:00", 1), ("2024-01-01 10:01", 2), ("TOTAL", 3)]


def known(spark):
    rows = [("p1", "pending", None, 1), ("p2", "running", "n", 2), ("p3", "done", None, 3), ("p4", "skip", "why", 4),
            ("p5", rules.STATUS_RAR, None, 5)]
    return spark.createDataFrame(rows, "package_path string, status string, notes string, priority bigint")


def test_reconcile(spark):
    found = spark.createDataFrame([("p1",), ("p9",), ("p9",)], "package_path string")
    out = ledger.reconcile(known(spark), found)
    assert out.columns == [*ledger.COLUMNS, "priority"]
    got = {r.package_path: (r.status, r.notes, r.priority) for r in out.collect()}
    assert got == {"p1": ("pending", None, 1), "p2": ("pending", "n", 2), "p3": ("done", None, 3), "p4": ("skip", "why", 4),
                   "p5": (rules.STATUS_RAR, None, 5), "p9": ("pending", None, None)}
    assert tuple(ledger.status_counts(out).first()) == (3, 1, 1)
    again = ledger.reconcile(out, found)
    assert same(out, again)


@pytest.mark.parametrize("archives, n, failed, status", [
    ("a.zip; B.RAR", 0, False, rules.STATUS_RAR), ("a.rar", 3, False, rules.STATUS_RAR), ("a.rar.zip", 3, False, "done"),
    ("", 0, False, rules.STATUS_NO_FILES), (None, None, False, rules.STATUS_NO_FILES), ("a.rar", 0, True, "error"),
    ("", 2, False, "done")])
def test_final_status(spark, archives, n, failed, status):
    base = ledger.with_standard_columns(known(spark))
    s = spark.createDataFrame([("p1", failed, archives, n)], "package_path string, failed boolean, archive_files string, n_files_total bigint")
    got = {r.package_path: r for r in ledger.finish(base, s).collect()}
    assert got["p1"].status == status and got["p1"].priority == 1
    assert got["p4"].status == "skip" and got["p4"].notes == "why"


def test_ledger_store_switches_only_to_complete_versions(spark, tmp_path):
    import os
    store = LedgerStore(spark, str(tmp_path / "ledger"))
    assert store.read() is None
    store.write(known(spark))
    second = store.write(known(spark).filter("package_path = 'p1'"))
    assert second.count() == 1 and store.versions() == [1, 2]
    os.makedirs(tmp_path / "ledger" / "v3")        # an interrupted write
    assert store.versions() == [1, 2] and store.read().count() == 1
    for _ in range(7):
        store.write(store.read())
    assert len(store.versions()) == 6


def test_sinks_replace_only_their_datasets(spark, tmp_path):
    out = str(tmp_path / "out")
    base = "dataset_id string, file string, sheet string, col_name string, label string, n_rows bigint, filter_reason string, " \
           "evaluation string, reasoning string, tabulation string, duplicate_of string"
    issues = spark.createDataFrame([], "dataset_id string, level string, message string")

    def save(ds, names):
        res = spark.createDataFrame([(ds, "f", "—", n, n, 1, "r", "not_pii", "", "", "") for n in names], base)
        run = spark.createDataFrame([(ds, "x")], "dataset_id string, version string")
        save_results(out, res, issues, run, reports.overview(run.withColumn("package_name", F.col("dataset_id"))))

    save("d1", ["a", "b"])
    save("d2", ["c"])
    save("d1", ["z"])
    assert sorted((r.dataset_id, r.col_name) for r in spark.read.parquet(f"{out}/results").collect()) == [("d1", "z"), ("d2", "c")]
    assert not (tmp_path / "out" / "issues").exists()
    save("d3", [])
    save("d2", [])
    assert [r.dataset_id for r in spark.read.parquet(f"{out}/results").collect()] == ["d1"]
    assert sorted(r.dataset_id for r in spark.read.parquet(f"{out}/messages").collect()) == ["d2", "d3"]
    assert spark.read.parquet(f"{out}/messages").first().message == "No variables were evaluated"
