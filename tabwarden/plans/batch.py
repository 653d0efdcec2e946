"""Resumable screening of a folder of packages."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import __version__, rules
from ..operators import ledger as steps
from ..operators.classify import Responder
from ..operators.reports import overview
from ..sources.answer_store import AnswerStore
from ..sources.sinks import LedgerStore, save_results
from .bisect import first_line
from .durable import durable
from .local import local_relation
from .package import load_package
from .screen import finished, screen_dataset

SUMMARY = "package_path string, failed boolean, " + ", ".join(f"{k} {v}" for k, v in steps.SUMMARY.items())


def list_packages(spark: SparkSession, root: str) -> list[str]:
    """Direct subfolders of root in name order, without resource-fork folders."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(Path(root)) if s.isDirectory()]
    names = sorted(p.getName() for p in found if p.getName() != "__MACOSX")
    return [f"{root.rstrip('/')}/{n}" for n in names]


def dataset_of(folder: str) -> str:
    return folder.rstrip("/").rsplit("/", 1)[-1]


def screen_packages(spark: SparkSession, folders: list[str], output: str, land: DataFrame | None = None,
                    responder: Responder | None = None, model: str = "", cells_per_degree: int = 1,
                    waits=rules.ATTEMPT_WAITS, answers: AnswerStore | None = None,
                    calls_per_second: float | None = None, digests: LedgerStore | None = None) -> dict[str, dict]:
    """Screen packages together, save their results below output, and return a ledger summary each.

    The tables of all packages share every job of the run, so that many small
    packages keep a cluster as busy as a large one.
    """
    loaded = {folder: load_package(spark, folder, dataset_of(folder), digests=digests) for folder in folders}
    summaries: dict[str, dict] = {}
    for folder, pkg in loaded.items():
        archive = pkg.manifest.first()
        summaries[folder] = {k: (archive[k] if archive else "") for k in
                             ("archive_files", "archive_sizes_mb", "archive_sha256s")}
        summaries[folder]["n_files_total"] = pkg.files.count()
    held = {f: p for f, p in loaded.items() if summaries[f]["n_files_total"]}
    if not held:
        return summaries
    res = screen_dataset(
        spark, [t for p in held.values() for t in p.tables], land, responder, cells_per_degree,
        files=reduce(DataFrame.unionByName, [p.files for p in held.values()]),
        issues=reduce(DataFrame.unionByName, [p.issues for p in held.values()]),
        run_info={"model": model}, waits=waits, answers=answers, calls_per_second=calls_per_second)
    facts = local_relation(
        spark, [(dataset_of(f), f, *[summaries[f][k] for k in list(summaries[f])[:3]]) for f in held],
        "dataset_id string, package_path string, archive_files string, archive_sizes_mb string, archive_sha256s string")
    run = durable(finished(res.run).join(facts, "dataset_id", "left"))
    save_results(output, res.results, durable(res.issues), run, overview(run))
    by_dataset = {r.dataset_id: r for r in run.collect()}    # one row per package
    for folder in held:
        r = by_dataset[dataset_of(folder)]
        summaries[folder] |= {k: r[k] for k in (
            "n_files_total", "n_data_files", "n_duplicates", "n_direct_pii", "n_indirect", "n_internal_id",
            "n_warnings", "n_errors")}
        summaries[folder] |= {
            "n_checked": r.n_columns_checked, "model": model, "version": __version__,
            "run_date": datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M"), "output_path": output}
    return summaries


class Lease:
    """A driver's sign of life in the ledger's folder, renewed by a thread while it works."""

    def __init__(self, store: LedgerStore, seconds: float):
        self.store, self.seconds = store, seconds
        self.owner = uuid.uuid4().hex
        self._over = threading.Event()
        self._thread = threading.Thread(target=self._renew, daemon=True)

    def _renew(self) -> None:
        while not self._over.wait(self.seconds / 5):
            try:
                self.store.renew(self.owner)
            except Exception as e:  # the next renewal may succeed before the lease runs out
                print(f"lease not renewed: {first_line(e)}")

    def __enter__(self) -> Lease:
        self.store.renew(self.owner)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._over.set()
        self._thread.join()
        self.store.release(self.owner)


def run_folder(spark: SparkSession, root: str, store: LedgerStore, output: str,
               run_many: Callable[[list[str]], dict[str, dict]] | None = None, packages_per_run: int = 8,
               lease_seconds: float = 300, **screen_args) -> DataFrame:
    """Screen every pending package of root and keep the ledger; safe to stop and rerun.

    Several drivers may work on one folder. Each takes a group of pending packages by a ledger
    version of its own, which no other can have taken too, and shows by its lease that it is
    alive. Packages found running without a live lease were interrupted and are taken again.

    The loop runs over groups of package names, each step a few Spark jobs. A group
    that fails is taken again package by package, so that one bad package fails
    alone. Results of all packages lie below output, split by dataset_id.
    """
    run_many = run_many or (lambda folders: screen_packages(spark, folders, output, **screen_args))
    discovered = local_relation(spark, [(p,) for p in list_packages(spark, root)], "package_path string")
    nothing = local_relation(spark, [], "package_path string, status string")
    with Lease(store, lease_seconds) as lease:
        while True:
            taken: list[str] = []

            def take(known: DataFrame | None) -> DataFrame:
                alive = store.alive(lease_seconds)
                current = steps.reconcile(nothing if known is None else known, discovered, alive)
                pending = current.filter(F.col("status") == rules.STATUS_PENDING)
                taken[:] = [r[0] for r in pending.select("package_path").orderBy("package_path").limit(packages_per_run).collect()]
                group = local_relation(spark, [(p,) for p in taken], "package_path string")
                return steps.start(current, group, lease.owner)

            current = store.update(take)
            if not taken:
                return current
            rows = [(path, summary is None, *[(summary or {}).get(k) for k in steps.SUMMARY])
                    for path, summary in _run_group(run_many, list(taken)).items()]
            done = local_relation(spark, rows, SUMMARY)
            store.update(lambda known: steps.finish(known, done, lease.owner))


def _run_group(run_many, group: list[str]) -> dict[str, dict | None]:
    """Summaries per package; None for a package that fails also by itself."""
    try:
        return run_many(group)
    except Exception as e:
        if len(group) == 1:
            print(f"package {group[0]} failed: {e}")
            return {group[0]: None}
        return {p: s for one in group for p, s in _run_group(run_many, [one]).items()}
