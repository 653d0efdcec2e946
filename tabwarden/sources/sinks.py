"""Result sinks and the versioned ledger store."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import rules
from .storage import Storage

RESULT_COLUMNS = ("dataset_id", "file", "sheet", "col_name", "label", "n_rows", "filter_reason",
                  "evaluation", "reasoning", "tabulation", "duplicate_of")
RESULT_SETS = ("overview", "results", "messages", "issues", "metadata")
STAGED, COMMITS = "_staged", "_commits"
STALE_SECONDS = 600


def save_results(folder: str, results: DataFrame, issues: DataFrame, run: DataFrame,
                 overview: DataFrame, fmt: str = "parquet") -> None:
    """Four datasets below folder: overview, results, issues (if any) and metadata.

    A dataset without results leaves a one-row message instead. Datasets are split
    by dataset_id, and only those of this run are replaced, so partial results of a
    long run can be saved as it goes; what an earlier run of them left and this one
    has no rows for is removed.

    Everything is written aside first. One small file then commits it, and only after that
    are folders exchanged. A run that stops before the commit leaves the old results as
    they were; one that stops after it is finished by the next save, and `read_results`
    gives the new results meanwhile.
    """
    finish_commits(run.sparkSession, folder)
    token = commit_results(folder, results, issues, run, overview, fmt)
    finish_commits(run.sparkSession, folder, token)


def commit_results(folder: str, results: DataFrame, issues: DataFrame, run: DataFrame, overview: DataFrame,
                   fmt: str = "parquet") -> str:
    """Write results aside and commit them; the name of the commit, which is still to be finished."""
    spark = run.sparkSession
    at = Storage(spark, folder)
    token = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    empty = run.select("dataset_id").join(results.select("dataset_id"), "dataset_id", "left_anti").distinct()
    sets = {"overview": overview, "results": results.select(*RESULT_COLUMNS), "issues": issues, "metadata": run,
            "messages": empty.withColumn("message", F.lit(rules.NO_RESULTS))}
    for name, df in sets.items():
        df.write.format(fmt).partitionBy("dataset_id").save(f"{at.folder}/{STAGED}/{token}/{name}")
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    ids = [r[0] for r in run.select("dataset_id").distinct().collect()]    # of this run: its packages
    held = {name: [n for n in at.listed(STAGED, token, name) if n.startswith("dataset_id=")] for name in sets}
    own = sorted({f"dataset_id={escape(i)}" for i in ids}.union(*held.values()))
    at.put_if_absent({"datasets": own, "held": held, "format": fmt}, COMMITS, f"{token}.json")
    return token


def finish_commits(spark: SparkSession, folder: str, token: str | None = None) -> None:
    """Exchange the folders of committed saves: of one, or of all that no one is working on.

    A save is claimed by the file that `put_if_absent` gives to one driver only; a claim older than
    STALE_SECONDS is of a driver that stopped. Each step can be repeated.
    """
    at = Storage(spark, folder)
    for name in at.listed(COMMITS):
        own = name.removesuffix(".json")
        if not name.endswith(".json") or name.startswith(".") or token not in (None, own):
            continue
        if not at.put_if_absent({}, COMMITS, f"{own}.claim"):
            try:
                at.write("", COMMITS, f".{own}.now")       # what the file system's clock says
                age = at.modified(COMMITS, f".{own}.now") - at.modified(COMMITS, f"{own}.claim")
                at.delete(COMMITS, f".{own}.now")
            except Exception:   # its driver has just finished it
                continue
            if age < 1000 * STALE_SECONDS:
                continue
        _exchange(at, own, at.read(COMMITS, name))
        at.delete(COMMITS, name)
        at.delete(STAGED, own)
        at.delete(COMMITS, f"{own}.claim")


def _exchange(at: Storage, token: str, commit: dict) -> None:
    for name in RESULT_SETS:
        for dataset in commit["datasets"]:
            staged = at.path(STAGED, token, name, dataset)
            if dataset not in commit["held"][name]:
                at.delete(name, dataset)
            elif at.fs.exists(staged):      # else an earlier attempt has moved it
                at.delete(name, dataset)
                at.fs.mkdirs(at.path(name))
                if not at.fs.rename(staged, at.path(name, dataset)):
                    raise OSError(f"{staged} could not be moved")


def read_results(spark: SparkSession, folder: str, name: str = "results", fmt: str = "parquet") -> DataFrame | None:
    """One of RESULT_SETS as the last commit left it, also while folders are being exchanged; None if empty.

    Where a save is committed but not yet in place, its datasets are read from where they wait.
    """
    at = Storage(spark, folder)
    commits = {n.removesuffix(".json"): at.read(COMMITS, n) for n in at.listed(COMMITS)
               if n.endswith(".json") and not n.startswith(".")}
    waiting = {d: token for token, c in sorted(commits.items()) for d in c["datasets"]}     # the last commit counts
    placed = [n for n in at.listed(name) if n.startswith("dataset_id=") and n not in waiting]
    found: dict[str, list[str]] = {f"{at.folder}/{name}": placed}
    for dataset, token in waiting.items():
        if dataset in commits[token]["held"][name]:
            base = f"{STAGED}/{token}/{name}" if at.exists(STAGED, token, name, dataset) else name
            found.setdefault(f"{at.folder}/{base}", []).append(dataset)
    parts = [spark.read.format(fmt).option("basePath", base).load([f"{base}/{n}" for n in names])
             for base, names in found.items() if names]
    parts = [p.withColumn("dataset_id", F.col("dataset_id").cast("string")) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


class LedgerConflict(Exception):
    """Another writer has committed the version that was to be written."""


class LedgerStore:
    """Ledger versions that several drivers may write.

    A version is a folder of data and a small file that gives it a number. The file is put only
    if that number is free, so of two writers one finds it taken, reads again and repeats its
    step; no update is lost. A crash while writing leaves the previous version in force.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    @property
    def _at(self) -> Storage:
        return Storage(self.spark, self.folder)

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._at.listed("versions") if n.startswith("v") and n.endswith(".json"))

    def read(self, version: int | None = None) -> DataFrame | None:
        """A version, the last if left out; None if there is none."""
        if version is None:
            versions = self.versions()
            if not versions:
                return None
            version = versions[-1]
        return self.spark.read.parquet(f"{self.folder}/{self._at.read('versions', f'v{version}.json')['data']}")

    def _commit(self, ledger: DataFrame, version: int | None, keep: int) -> DataFrame:
        at, data = self._at, f"data-{uuid.uuid4().hex}"
        ledger.write.parquet(f"{self.folder}/{data}")
        while True:
            versions = self.versions()
            number = (versions[-1] if versions else 0) + 1 if version is None else version
            if at.put_if_absent({"data": data}, "versions", f"v{number}.json"):
                break
            if version is not None:
                at.delete(data)
                raise LedgerConflict(number)
        for old in versions:
            if old <= number - 1 - keep:
                try:
                    gone = at.read("versions", f"v{old}.json")["data"]
                except Exception:       # another writer has just removed it
                    continue
                at.delete("versions", f"v{old}.json")
                at.delete(gone)
        return self.spark.read.parquet(f"{self.folder}/{data}")

    def write(self, ledger: DataFrame, keep: int = 5) -> DataFrame:
        """Write the next version whatever others have written, drop old ones, and read it back."""
        return self._commit(ledger, None, keep)

    def update(self, step: Callable[[DataFrame | None], DataFrame], keep: int = 5, attempts: int = 50) -> DataFrame:
        """step(last version) as the next version; taken again from what another writer put first."""
        for attempt in range(attempts):
            versions = self.versions()
            last = versions[-1] if versions else 0
            try:
                return self._commit(step(self.read(last) if last else None), last + 1, keep)
            except LedgerConflict:
                time.sleep(min(0.05 * 2 ** min(attempt, 6), 2) * (0.5 + (uuid.uuid4().int % 1000) / 1000))
        raise LedgerConflict(f"{attempts} attempts")

    # Leases: a file per driver, touched while it works. Packages of a driver without a fresh one are free.

    def renew(self, owner: str) -> None:
        self._at.write("", "leases", owner)

    def release(self, owner: str) -> None:
        self._at.delete("leases", owner)

    def alive(self, seconds: float) -> list[str]:
        """Drivers whose lease was renewed within so many seconds, by the clock of the file system."""
        at, probe = self._at, f".{uuid.uuid4().hex}"
        at.write("", "leases", probe)
        now, out = at.modified("leases", probe), []
        at.delete("leases", probe)
        for name in at.listed("leases"):
            try:
                if not name.startswith(".") and now - at.modified("leases", name) <= 1000 * seconds:
                    out.append(name)
            except Exception:   # released meanwhile
                continue
        return out
