"""Screening of whole datasets: which columns could hold personal data, and why."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import __version__, rules
from ..functions import text
from ..operators.cascade import apply_cascade
from ..operators.classify import (Responder, build_prompts, first_valid, merge_verdicts, run_classifier,
                                  unexpected_evaluations)
from ..operators.coordinates import CANDIDATES, gps_candidates
from ..operators.duplicates import copy_to_duplicates
from ..operators.patterns import pattern_floors
from ..operators.profile import profile_rows, profile_some, profiled_columns
from ..operators.reports import (column_counts, dataset_summary, file_counts, issue_counts, result_counts,
                                 usage_totals)
from ..operators.tabulate import render, tabulate_columns
from ..operators.values import distinct_stats, melt_all, needs_distinct_test, value_counts
from ..sources.answer_store import AnswerStore
from ..sources.tables import Table, catalog, column_label
from .bisect import bisected, first_line
from .durable import durable
from .local import local_relation

NO_STATS = "col_id int, n_unique bigint, min_count bigint"


def open_category_stats(spark: SparkSession, tables: list[Table], columns: DataFrame) -> DataFrame:
    """Exact distinct statistics of the text columns the profile could not rule out."""
    profiles = {r.col_id: r.asDict() for r in columns.filter("kind = 'string' and n_nonnull > 0").collect()}
    refs = [r for r in catalog(tables)
            if r.col_id in profiles and needs_distinct_test(profiles[r.col_id])]
    if not refs:
        return local_relation(spark, [], NO_STATS)
    return distinct_stats(value_counts(melt_all(tables, refs)))


def screen_columns(spark: SparkSession, tables: list[Table], land: DataFrame | None = None,
                   cells_per_degree: int = 1, columns: DataFrame | None = None) -> DataFrame:
    """One row per column with reason_code, reason and is_candidate."""
    if columns is None:
        columns = profiled_columns(spark, tables)
    stats = open_category_stats(spark, tables, columns)
    gps = gps_candidates(spark, tables, columns, land, cells_per_degree)
    return apply_cascade(columns, stats, gps)


def readable_tables(spark: SparkSession, tables: list[Table]) -> tuple[list[Table], DataFrame, list[tuple]]:
    """Tables that can be scanned, their profiled columns, and an issue per table or column that cannot."""
    return readable_columns(spark, tables)[:3]


def readable_columns(spark: SparkSession, tables: list[Table]
                     ) -> tuple[list[Table], DataFrame, list[tuple], list[tuple]]:
    """The same, and (dataset_id, file, sheet, col_name, label, n_rows, message) per column that cannot be read.

    All tables are profiled in one job. If it fails the tables are halved until the
    damaged ones stand alone, and then the columns of a damaged table, as long as its
    rows can be counted; what was profiled on the way is kept.
    """
    issues: list[tuple] = []
    bad_columns: list[tuple] = []
    rows: dict[int, list[tuple | None]] = {}
    unread: dict[int, frozenset[int]] = {}
    done, failed = bisected(list(enumerate(tables)), lambda part: profile_rows([t for _, t in part]))
    for part, profiles in done:
        rows.update((i, own) for (i, _), own in zip(part, profiles))
    for (i, table), error in failed:
        idxs = list(range(len(table.df.columns)))
        try:
            n_rows = table.cells([]).count()
            parts, broken = bisected(idxs, lambda chosen: profile_some(table, list(chosen)))
        except Exception as e:
            parts, broken, error = [], [], e
        if not parts:    # nothing of it can be read
            issues.append((table.dataset_id, "ERROR", f"{table.file}: could not be read: {first_line(error)}"))
            continue
        own: list[tuple | None] = [None] * len(idxs)
        for chosen, profiles in parts:
            for idx, p in zip(chosen, profiles):
                own[idx] = p
        rows[i], unread[i] = own, frozenset(idx for idx, _ in broken)
        for idx, e in broken:
            f = table.field(idx)
            said = first_line(e)
            issues.append((table.dataset_id, "ERROR", f"{table.file}: column {f.name} could not be read: {said}"))
            bad_columns.append((table.dataset_id, table.file, table.sheet or rules.NO_SHEET, f.name,
                                column_label(table, f), n_rows, f"the column could not be read: {said}"))
    good = [replace(t, unread=unread[i]) if i in unread else t for i, t in enumerate(tables) if i in rows]
    return good, profiled_columns(spark, good, [rows[i] for i in sorted(rows)]), issues, bad_columns


def coordinate_columns(spark: SparkSession, tables: list[Table], columns: DataFrame, land: DataFrame | None,
                       cells_per_degree: int) -> tuple[DataFrame, list[tuple]]:
    """Coordinate columns of all tables, and an issue per table whose test failed.

    The tables share their jobs; after a failure each is tested by itself.
    """
    try:
        return gps_candidates(spark, tables, columns, land, cells_per_degree), []
    except Exception:
        found, issues = local_relation(spark, [], CANDIDATES), []
        for table_id, table in enumerate(tables):
            try:
                own = columns.filter(F.col("table_id") == table_id)
                found = found.unionByName(gps_candidates(spark, tables, own, land, cells_per_degree))
            except Exception as e:    # whatever it is, the other rules can still decide
                issues.append((table.dataset_id, "ERROR", f"{table.file}: coordinate test failed: {first_line(e)}"))
        return found, issues


@dataclass(frozen=True)
class ScreenResult:
    """Lazy outcome of one screening run; nothing is written until a sink asks."""

    results: DataFrame      # one row per checked column and copied duplicate
    columns: DataFrame      # every column with profile, reason and is_candidate
    tabulation: DataFrame   # the values shown per candidate column
    prompts: DataFrame
    attempts: DataFrame | None
    issues: DataFrame
    run: DataFrame          # one row per dataset


ISSUES = "dataset_id string, level string, message string"
ERROR_ROWS = ("dataset_id string, file string, sheet string, col_name string, label string, n_rows bigint, "
              "filter_reason string, reasoning string")
SHOWN = "col_id int, grp string, rank int, digest string, value string, cnt bigint, pct double, n_unique bigint"


def floors_of(columns: DataFrame) -> DataFrame:
    """(col_id, floor_met, pii_type, note) from profiled columns."""
    return pattern_floors(columns).select("col_id", "floor_met", "pii_type", "note")


def tabulate_candidates(spark: SparkSession, tables: list[Table], screened: DataFrame,
                        seed: str = "0") -> DataFrame:
    """Value samples of the candidate columns; no other column is read."""
    rows = screened.filter("is_candidate").select("col_id", "n_rows", "sum_len", "n_nonnull").collect()
    wanted = {r.col_id for r in rows}
    mean_len = {r.col_id: (r.sum_len or 0) / max(r.n_nonnull, 1) for r in rows}
    refs = [r for r in catalog(tables) if r.col_id in wanted]
    if not refs:
        return local_relation(spark, [], SHOWN)
    n_rows = local_relation(spark, [(r.col_id, r.n_rows) for r in rows], "col_id int, n_rows bigint")
    return tabulate_columns(tables, refs, n_rows, mean_len, seed)


def sampled_candidates(spark: SparkSession, tables: list[Table], screened: DataFrame, seed: str = "0"
                       ) -> tuple[DataFrame, list[tuple[int, str]]]:
    """Value samples of all candidates as one job, and (col_id, message) of those that cannot be sampled."""
    wanted = sorted(r.col_id for r in screened.filter("is_candidate").select("col_id").collect())
    done, failed = bisected(wanted, lambda ids: durable(tabulate_candidates(
        spark, tables, screened.filter(F.col("col_id").isin(list(ids))), seed)))
    shown = [df for _, df in done] or [local_relation(spark, [], SHOWN)]
    return reduce(DataFrame.unionByName, shown), [(i, first_line(e)) for i, e in failed]


def screen_dataset(spark: SparkSession, tables: list[Table], land: DataFrame | None = None,
                   responder: Responder | None = None, cells_per_degree: int = 1,
                   files: DataFrame | None = None, run_info: dict[str, str] | None = None,
                   seed: str = "0", waits: Sequence[float] = rules.ATTEMPT_WAITS,
                   issues: DataFrame | None = None, answers: AnswerStore | None = None,
                   calls_per_second: float | None = None) -> ScreenResult:
    """Screen tables of one or many datasets.

    Without a responder this is a dry run: prompts are built, nothing is asked.
    files: optional (dataset_id, path, primary_path, loaded); results of a primary
    file are copied onto its duplicates. answers: where answers are kept, so that a run
    that is repeated asks only what has none.
    """
    started = datetime.now(timezone.utc)
    datasets = sorted({t.dataset_id for t in tables})
    tables, columns, unread, bad_columns = readable_columns(spark, tables)
    found = local_relation(spark, unread, ISSUES)
    issues = found if issues is None else issues.unionByName(found)
    if files is not None and unread:
        kept = local_relation(spark, [(t.dataset_id, t.file) for t in tables], "dataset_id string, path string")
        files = files.join(kept.withColumn("kept", F.lit(True)).distinct(), ["dataset_id", "path"], "left").withColumn(
            "loaded", F.col("loaded") & F.coalesce("kept", F.lit(False))).drop("kept")
    gps, untested = coordinate_columns(spark, tables, columns, land, cells_per_degree)
    issues = issues.unionByName(local_relation(spark, untested, ISSUES))
    screened = apply_cascade(columns, open_category_stats(spark, tables, columns), gps)
    rows = [tuple(r) for r in screened.collect()]    # one per column, like the schemas
    screened = local_relation(spark, rows, screened.schema)
    shown, unsampled = sampled_candidates(spark, tables, screened, seed)
    errors = [(*r[:6], "error", r[6]) for r in bad_columns]
    if unsampled:
        said = dict(unsampled)
        lost = screened.filter(F.col("col_id").isin(list(said))).collect()    # columns that failed alone
        errors += [(r.dataset_id, r.file, r.sheet, r.col_name, r.label, r.n_rows, r.reason,
                    f"the column could not be sampled: {said[r.col_id]}") for r in lost]
        issues = issues.unionByName(local_relation(
            spark, [(r.dataset_id, "ERROR", f"{r.file}: column {r.col_name} could not be sampled: {said[r.col_id]}")
                    for r in lost], ISSUES))
    candidates = screened.filter(F.col("is_candidate") & ~F.col("col_id").isin([i for i, _ in unsampled]))
    cells = render(shown)
    prompts = durable(build_prompts(candidates, cells))
    rowed = (candidates.join(cells, "col_id", "left")
             .join(prompts.select("col_id", "prompt_id"), "col_id")
             .join(floors_of(candidates), "col_id"))
    if responder is None:
        attempts = None
        verdicts = rowed.withColumns({"evaluation": F.lit(rules.DRY_RUN_EVALUATION),
                                      "reasoning": F.lit("dry run, nothing was asked")})
    else:
        attempts = run_classifier(prompts, responder, waits, store=answers, calls_per_second=calls_per_second)
        answered = first_valid(attempts).select("prompt_id", "value", F.col("reasoning").alias("answer_reasoning"))
        verdicts = merge_verdicts(rowed.join(answered, "prompt_id", "left")
                                  .withColumn("is_gps", F.col("reason_code") == "gps"))
        failed = verdicts.filter("value is null").select(
            "dataset_id", F.lit("ERROR").alias("level"),
            F.concat(F.lit("no usable answer for column "), "col_name", F.lit(" in "), "file").alias("message"))
        issues = issues.unionByName(failed).unionByName(unexpected_evaluations(verdicts))
    results = verdicts.select(
        "dataset_id", "file", "sheet", "col_name", text.strip_controls(F.col("label")).alias("label"),
        "n_rows", F.col("reason").alias("filter_reason"), "evaluation", "reasoning",
        F.coalesce("tabulation", F.lit("")).alias("tabulation"), F.lit("").alias("duplicate_of"))
    if errors:
        results = results.unionByName(local_relation(spark, errors, ERROR_ROWS).select(
            "dataset_id", "file", "sheet", "col_name", text.strip_controls(F.col("label")).alias("label"), "n_rows",
            "filter_reason", F.lit("error").alias("evaluation"), "reasoning", F.lit("").alias("tabulation"),
            F.lit("").alias("duplicate_of")))
    if files is not None:
        results = copy_to_duplicates(results, files)

    base = local_relation(spark, [(d,) for d in datasets], "dataset_id string")
    results = durable(results)
    counted = screened.select("dataset_id", "is_candidate")
    if bad_columns:
        counted = counted.unionByName(local_relation(spark, [(r[0], False) for r in bad_columns],
                                                     "dataset_id string, is_candidate boolean"))
    parts = [column_counts(counted), result_counts(results), issue_counts(issues)]
    if files is not None:
        parts.insert(0, file_counts(files))
        base = base.unionByName(files.select("dataset_id").distinct()).distinct()
    run = dataset_summary(base, *parts)
    if attempts is not None:
        asked = prompts.join(screened.select("col_id", "dataset_id"), "col_id").select("prompt_id", "dataset_id").distinct()
        run = run.join(usage_totals(attempts.filter("attempt > 0").join(asked, "prompt_id"), "dataset_id"), "dataset_id", "left")
    info = {"package_name": None, "version": __version__, "model": "", **(run_info or {}),
            "started": started.strftime("%Y-%m-%d %H:%M:%S"), "ended": ""}
    run = run.select("*", *[
        (F.col("dataset_id") if v is None else F.lit(v)).alias(k) for k, v in info.items()])
    return ScreenResult(results, screened, shown, prompts, attempts, issues, run)


def finished(run: DataFrame, ended: datetime | None = None) -> DataFrame:
    """The run record with its end and duration in seconds."""
    ended = ended or datetime.now(timezone.utc)
    return (run.withColumn("ended", F.lit(ended.strftime("%Y-%m-%d %H:%M:%S")))
            .withColumn("duration_s", F.timestamp_diff("SECOND", F.to_timestamp("started"), F.to_timestamp("ended"))))
