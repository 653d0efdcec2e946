"""What several drivers, and drivers that stop midway, leave behind."""

import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tabwarden import rules
from tabwarden.operators import ledger
from tabwarden.plans.batch import Lease, run_folder
from tabwarden.sources import sinks
from tabwarden.sources.sinks import LedgerConflict, LedgerStore, finish_commits, read_results, save_results
from tabwarden.sources.storage import Storage

KIND = ("dataset_id string, file string, sheet string, col_name string, label string, n_rows bigint, filter_reason string, "
        "evaluation string, reasoning string, tabulation string, duplicate_of string")


def test_one_of_many_puts_a_name(spark, tmp_path):
    at = Storage(spark, str(tmp_path))
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: at.put_if_absent({"by": i}, "names", "x.json"), range(16)))
    assert sum(won) == 1 and at.read("names", "x.json") == {"by": won.index(True)}
    assert at.listed("names") == ["x.json"] and at.listed("nothing") == []


def saved(spark, out, names, dataset="d 1"):
    rows = spark.createDataFrame([(dataset, "f", "—", n, n, 1, "r", "not_pii", "", "", "") for n in names], KIND)
    run = spark.createDataFrame([(dataset, "x")], "dataset_id string, version string")
    over = run.select("dataset_id", F.lit("m").alias("metric"), F.col("version").alias("value"))
    save_results(out, rows, spark.createDataFrame([], "dataset_id string, level string, message string"), run, over)


def names_in(df):
    return None if df is None else sorted((r.dataset_id, r.col_name) for r in df.collect())


def in_place(spark, out):
    return names_in(spark.read.parquet(f"{out}/results"))


class Stopped(Exception):
    pass


def stopped(*_, **__):
    raise Stopped


def test_a_save_that_stops_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    assert read_results(spark, out) is None
    saved(spark, out, ["a", "b"])
    saved(spark, out, ["x"], "d2")
    with monkeypatch.context() as m:
        m.setattr(Storage, "put_if_absent", stopped)
        with pytest.raises(Stopped):
            saved(spark, out, ["c"])
    old = [("d 1", "a"), ("d 1", "b"), ("d2", "x")]
    assert in_place(spark, out) == old == names_in(read_results(spark, out))
    saved(spark, out, ["c"])
    assert in_place(spark, out) == [("d 1", "c"), ("d2", "x")] == names_in(read_results(spark, out))
    assert [n for n in Storage(spark, out).listed("_commits") if n.endswith(".json")] == []


@pytest.mark.parametrize("moved", [0, 1])
def test_a_save_that_stops_after_its_commit_is_finished_later(spark, tmp_path, monkeypatch, moved):
    out = str(tmp_path / "out")
    saved(spark, out, ["a", "b"])
    plain = sinks._exchange

    def some(at, token, commit):
        if moved:       # all but one kind of rows had been moved
            plain(at, token, {**commit, "held": {**commit["held"]}})
        raise Stopped

    with monkeypatch.context() as m:
        m.setattr(sinks, "_exchange", some)
        with pytest.raises(Stopped):
            saved(spark, out, ["c"])
    new = [("d 1", "c")]
    assert names_in(read_results(spark, out)) == new
    assert read_results(spark, out, "metadata").count() == 1 and read_results(spark, out, "messages") is None
    saved(spark, out, ["x"], "d2")      # the claim is fresh: its driver may be at work
    assert names_in(read_results(spark, out)) == [*new, ("d2", "x")]
    monkeypatch.setattr(sinks, "STALE_SECONDS", -1)
    finish_commits(spark, out)
    assert in_place(spark, out) == [*new, ("d2", "x")] == names_in(read_results(spark, out))
    saved(spark, out, [])
    assert names_in(read_results(spark, out)) == [("d2", "x")] and read_results(spark, out, "messages").count() == 1


def rows(spark, *statuses):
    return spark.createDataFrame([(f"p{i}", s) for i, s in enumerate(statuses)], "package_path string, status string")


def test_no_update_is_lost(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    LedgerStore(spark, folder).write(rows(spark, *["pending"] * 4))

    def mark(i):
        return LedgerStore(spark, folder).update(
            lambda known: known.withColumn("status", F.when(F.col("package_path") == f"p{i}", "done").otherwise(F.col("status"))))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(mark, range(4)))
    store = LedgerStore(spark, folder)
    assert store.versions() == [1, 2, 3, 4, 5] and store.read().filter("status = 'done'").count() == 4
    assert store.read(1).filter("status = 'done'").isEmpty()
    with pytest.raises(LedgerConflict):
        store._commit(store.read(), 5, 5)
    assert len(Storage(spark, folder).listed()) == 6      # five versions' data and the folder of their numbers


def test_two_drivers_share_a_folder(spark, tmp_path):
    root, folder = tmp_path / "pkgs", str(tmp_path / "ledger")
    for i in range(7):
        (root / f"p{i}").mkdir(parents=True)
    asked, lock = [], threading.Lock()

    def run_many(folders):
        with lock:
            asked.extend(f[-2:] for f in folders)
        time.sleep(0.5)
        if any(f.endswith("p3") for f in folders):
            raise RuntimeError("p3 is bad")
        return {f: {"n_files_total": 1, "archive_files": ""} for f in folders}

    def drive(_):
        return run_folder(spark, str(root), LedgerStore(spark, folder), str(tmp_path / "out"), run_many, packages_per_run=1)

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(drive, range(2)))
    assert sorted(asked) == [f"p{i}" for i in range(7)]       # none twice
    got = {r.package_path[-2:]: r.status for r in LedgerStore(spark, folder).read().collect()}
    assert got == {f"p{i}": "error" if i == 3 else "done" for i in range(7)}
    assert LedgerStore(spark, folder).alive(1e6) == []


def test_packages_of_a_driver_that_stopped_are_taken_again(spark, tmp_path):
    (tmp_path / "pkgs" / "p1").mkdir(parents=True)
    store, path = LedgerStore(spark, str(tmp_path / "ledger")), f"{tmp_path}/pkgs/p1"
    found = spark.createDataFrame([(path,)], "package_path string")
    store.write(ledger.start(ledger.reconcile(spark.createDataFrame([], "package_path string, status string"), found), found, "other"))
    store.renew("other")
    asked = []

    def run_many(folders):
        asked.extend(folders)
        return {f: {"n_files_total": 1} for f in folders}

    def run(seconds):
        return run_folder(spark, str(tmp_path / "pkgs"), store, "out", run_many, lease_seconds=seconds).first()

    assert run(300).status == rules.STATUS_RUNNING and not asked       # its driver is alive
    time.sleep(1.2)
    assert run(1).status == "done" and len(asked) == 1
    late = spark.createDataFrame([(path, True)], "package_path string, failed boolean")
    assert store.update(lambda known: ledger.finish(known, late, "other")).first().status == "done"     # too late


def test_a_lease_is_renewed_while_its_driver_works(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "ledger"))
    with Lease(store, 2.0) as lease:
        time.sleep(3)
        assert store.alive(2.0) == [lease.owner]
    assert store.alive(1e6) == []
