"""The status ledger of a folder of packages: pure steps from ledger to ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules

SUMMARY = {
    "archive_files": "string", "archive_sizes_mb": "string", "archive_sha256s": "string",
    "n_files_total": "bigint", "n_data_files": "bigint", "n_duplicates": "bigint",
    "n_checked": "bigint", "n_direct_pii": "bigint", "n_indirect": "bigint",
    "n_internal_id": "bigint", "n_warnings": "bigint", "n_errors": "bigint",
    "model": "string", "version": "string", "run_date": "string", "output_path": "string",
}
COLUMNS = {"package_path": "string", "status": "string", "notes": "string", **SUMMARY}


def with_standard_columns(ledger: DataFrame) -> DataFrame:
    """Standard columns first, in order; columns a person added stay behind them."""
    extra = [c for c in ledger.columns if c not in COLUMNS]
    standard = [
        (F.col(c) if c in ledger.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()]
    return ledger.select(*standard, *extra)


OWNER = "lease_owner"   # the driver that has a running package


def recover(ledger: DataFrame, alive: Sequence[str] = ()) -> DataFrame:
    """Packages that an interrupted run left running are pending again; those of drivers alive are not."""
    lost = F.col("status") == rules.STATUS_RUNNING
    if OWNER in ledger.columns:
        lost &= ~F.coalesce(F.col(OWNER).isin(list(alive)), F.lit(False))
    return ledger.withColumn("status", F.when(lost, rules.STATUS_PENDING).otherwise(F.col("status")))


def reconcile(ledger: DataFrame, discovered: DataFrame, alive: Sequence[str] = ()) -> DataFrame:
    """Recovered ledger plus a pending row for each package not in it yet."""
    known = recover(with_standard_columns(ledger), alive)
    new = (discovered.select("package_path").distinct()
           .join(known.select("package_path"), "package_path", "left_anti")
           .withColumn("status", F.lit(rules.STATUS_PENDING)))
    return known.unionByName(new, allowMissingColumns=True)


def status_counts(ledger: DataFrame) -> DataFrame:
    """Pending, done and skipped packages."""
    return ledger.agg(*[
        F.count_if(F.col("status") == s).alias(f"n_{s}")
        for s in (rules.STATUS_PENDING, rules.STATUS_DONE, rules.STATUS_SKIP)])


def final_status(archive_files: Column, n_files_total: Column, failed: Column) -> Column:
    """Status after a run: error, then rar archives, then no files, else done."""
    has_rar = F.lower(F.coalesce(archive_files, F.lit(""))).rlike(r"\.rar(; |$)")
    return (
        F.when(F.coalesce(failed, F.lit(False)), rules.STATUS_ERROR)
        .when(has_rar, rules.STATUS_RAR)
        .when(F.coalesce(n_files_total, F.lit(0)) == 0, rules.STATUS_NO_FILES)
        .otherwise(rules.STATUS_DONE))


def start(ledger: DataFrame, packages: DataFrame, owner: str | None = None) -> DataFrame:
    """Mark the given packages as running, as the owner's if one is named."""
    marked = packages.select("package_path", F.lit(True).alias("_start"))
    out = ledger.join(marked, "package_path", "left").withColumn(
        "status", F.when(F.col("_start"), rules.STATUS_RUNNING).otherwise(F.col("status")))
    if owner is None:
        return out.select(*ledger.columns)
    before = F.col(OWNER) if OWNER in ledger.columns else F.lit(None).cast("string")
    return out.withColumn(OWNER, F.when(F.col("_start"), owner).otherwise(before)).drop("_start")


def finish(ledger: DataFrame, summaries: DataFrame, owner: str | None = None) -> DataFrame:
    """Write the summaries of finished runs into their rows and set their status.

    With an owner, only rows that are still the owner's are written.

    summaries: package_path, failed, and any of the summary columns. Rows without
    a summary stay as they are, as do notes and columns a person added. A failed
    run leaves earlier summary values in place.
    """
    given = [c for c in summaries.columns if c in SUMMARY]
    s = summaries.select("package_path", F.lit(True).alias("_done"), F.col("failed").alias("_failed"),
                         *[F.col(c).alias(f"_{c}") for c in given])
    joined = ledger.join(s, "package_path", "left")
    done, failed = F.col("_done"), F.coalesce("_failed", F.lit(False))
    if owner is not None:
        done &= (F.col(OWNER) == owner) & (F.col("status") == rules.STATUS_RUNNING)

    def of(name: str) -> Column:
        return F.col(f"_{name}") if name in given else F.lit(None)

    changed = {c: F.when(done & ~failed, F.col(f"_{c}").cast(SUMMARY[c])).otherwise(F.col(c)) for c in given}
    changed["status"] = F.when(done, final_status(
        of("archive_files").cast("string"), of("n_files_total").cast("bigint"), failed)
    ).otherwise(F.col("status"))
    if OWNER in ledger.columns:
        changed[OWNER] = F.when(~F.coalesce(done, F.lit(False)), F.col(OWNER))
    return joined.withColumns(changed).select(*ledger.columns)
