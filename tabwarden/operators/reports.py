"""Counts, overviews, usage totals and throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules


def result_counts(results: DataFrame, by: str = "dataset_id") -> DataFrame:
    """Columns checked (copies left out) and verdicts (copies included) per dataset."""
    def n(evaluation: str) -> Column:
        return F.count_if(F.col("evaluation") == evaluation)

    return results.groupBy(by).agg(
        F.count_if(F.col("duplicate_of") == "").alias("n_columns_checked"),
        n("direct_pii").alias("n_direct_pii"), n("possible_indirect").alias("n_indirect"),
        n("internal_id").alias("n_internal_id"))


def issue_counts(issues: DataFrame, by: str = "dataset_id") -> DataFrame:
    return issues.groupBy(by).agg(
        F.count_if(F.col("level") == "WARNING").alias("n_warnings"),
        F.count_if(F.col("level") == "ERROR").alias("n_errors"))


def file_counts(files: DataFrame, by: str = "dataset_id") -> DataFrame:
    """files: (dataset_id, path, primary_path, loaded). Every file is a loaded
    data file, a duplicate, or not loaded."""
    dup = F.col("path") != F.col("primary_path")
    total, dups = F.count(F.lit(1)), F.count_if(dup)
    data = F.count_if(~dup & F.col("loaded"))
    return files.groupBy(by).agg(
        total.alias("n_files_total"), data.alias("n_data_files"), dups.alias("n_duplicates"),
        (total - dups - data).alias("n_files_not_loaded"))


def column_counts(columns: DataFrame, by: str = "dataset_id") -> DataFrame:
    return columns.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_columns_total"),
        F.count_if("is_candidate").alias("n_columns_candidate"))


def dataset_summary(base: DataFrame, *counts: DataFrame, by: str = "dataset_id") -> DataFrame:
    """One row per dataset with all counts; counts a dataset has no rows for are 0."""
    out = base
    for part in counts:
        out = out.join(part, by, "left")
    filled = [c for part in counts for c in part.columns if c != by]
    return out.fillna(0, subset=filled)


def usage_totals(attempts: DataFrame, by: str) -> DataFrame:
    """Calls, tokens and seconds per group of the attempts log."""
    return attempts.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.round(F.sum("seconds"), 3).alias("seconds"))


def key_values(run: DataFrame, by: str = "dataset_id") -> DataFrame:
    """One (key, value) row per column of the run record."""
    cols = [c for c in run.columns if c != by]
    text = run.select(by, *[F.col(c).cast("string").alias(c) for c in cols])
    return text.unpivot([by], cols, "key", "value")


def overview(run: DataFrame, by: str = "dataset_id") -> DataFrame:
    """(dataset, ord, metric, value) in display order; a run without an end says so."""
    labels = dict(rules.OVERVIEW_LABELS)
    order = {key: i for i, key in enumerate(labels, start=1)}
    present = [c for c in labels if c in run.columns]
    rows = key_values(run.select(by, *present), by)
    for_key = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("key")]
    value = F.when((F.col("key") == "ended") & (F.coalesce("value", F.lit("")) == ""),
                   rules.UNFINISHED).otherwise(F.coalesce("value", F.lit("")))
    return rows.select(by, for_key(order).alias("ord"), for_key(labels).alias("metric"),
                       value.alias("value"))


def throughput(log: DataFrame, ts: str = "ts") -> DataFrame:
    """Columns processed per minute, and a TOTAL row."""
    per_minute = log.groupBy(F.date_trunc("minute", ts).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    rolled = per_minute.rollup("m").agg(F.sum("n").alias("columns_processed"), F.grouping("m").alias("g"))
    return rolled.select(
        F.when(F.col("g") == 1, "TOTAL")
        .otherwise(F.date_format("m", "yyyy-MM-dd HH:mm")).alias("minute"), "columns_processed")
