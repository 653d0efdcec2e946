"""One Spark query per screening operator, over whole driver tables."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import answers, names, paths, text
from ..operators import cascade, coordinates, duplicates, ledger, patterns, reports, tabulate, values
from ..operators.classify import first_valid, merge_verdicts
from ..operators.profile import profiled_columns
from ..plans.durable import durable, shared_folder
from ..plans.local import local_relation
from ..plans.package import load_package
from ..plans.screen import floors_of, screen_columns, screen_dataset, tabulate_candidates
from ..sources import text_tables
from ..sources.answer_store import AnswerStore
from ..sources.files import archive_manifest
from ..sources.sinks import RESULT_COLUMNS, LedgerStore, commit_results, read_results, save_results
from ..sources.tables import Table, catalog
from ..streaming.incremental import ArrivingTable
from ..streaming.throughput import throughput_stream as stream_minutes
from . import planted

# Python workers get the stand-in classifier itself and need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def survey_table(spark: SparkSession, sf_dir: str) -> Table:
    return Table(planted.survey(spark, sf_dir), "survey", row_key=("respondent_id",))


def stops_table(spark: SparkSession, sf_dir: str) -> Table:
    return Table(planted.stops(spark, sf_dir), "stops", row_key=("stop_id",))


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return Table(planted.table(spark, sf_dir, name), name)


def driver_tables(spark: SparkSession, sf_dir: str) -> list[Table]:
    return [driver_table(spark, sf_dir, n) for n in planted.TABLES]


# --- profiles and the cascade -----------------------------------------------

def _full_profile(spark: SparkSession, tables: list[Table]) -> DataFrame:
    stats = values.distinct_stats(values.count_columns(tables, catalog(tables)))
    return (profiled_columns(spark, tables).join(stats, "col_id", "left")
            .select("col_idx", "col_name", "n_rows", "n_nonnull", "max_abs", "has_frac", "max_len",
                    F.coalesce("n_unique", F.lit(0).cast("bigint")).alias("n_unique"), "min_count"))


@query
def column_profile(spark, sf_dir):
    return _full_profile(spark, [survey_table(spark, sf_dir)])


@query
def column_profile_lineitem(spark, sf_dir):
    return _full_profile(spark, [driver_table(spark, sf_dir, "lineitem")])


@query
def arriving_profile(spark, sf_dir):
    """Orders that arrive in three batches, one of them twice, folded once on the way."""
    state = _arrived(spark, driver_table(spark, sf_dir, "orders"), "o_orderkey")
    return state.columns().select("col_idx", "col_name", "n_rows", "n_nonnull", "max_abs", "has_frac", "max_len")


def _arrived(spark: SparkSession, table: Table, key: str, **kept: bool) -> ArrivingTable:
    """A table that came in three batches by key, the second of them twice, folded once on the way."""
    state = ArrivingTable(spark, _folder(spark, "arriving"), table.df.schema, table.file, row_key=table.row_key, **kept)
    for batch_id in (0, 1, 1, 2):
        state.add_batch(table.df.filter(F.col(key) % 3 == batch_id), batch_id)
        if batch_id == 1:
            state.compact()
    return state


def _arrived_samples(spark: SparkSession, sf_dir: str, name: str, key: str, column: str) -> DataFrame:
    state = _arrived(spark, driver_table(spark, sf_dir, name), key, samples=True)
    shown = state.tabulation(state.columns().filter(F.col("col_name") == column))
    return shown.select("grp", "rank", "value", "cnt", "pct", "n_unique")


@query
def arriving_samples(spark, sf_dir):
    """Samples of customers' names from the state that three batches left."""
    return _arrived_samples(spark, sf_dir, "customer", "c_custkey", "c_name")


@query
def arriving_samples_documents(spark, sf_dir):
    """The same of long texts, which are counted by digest."""
    return _arrived_samples(spark, sf_dir, "documents", "doc_id", "text")


@query
def arriving_coordinates(spark, sf_dir):
    """Shares of points on land of stops that came in three batches."""
    state = _arrived(spark, stops_table(spark, sf_dir), "stop_id", points=True)
    return state.pair_shares(planted.land(spark))


@query
def candidate_columns(spark, sf_dir):
    screened = screen_columns(spark, [survey_table(spark, sf_dir)], planted.land(spark))
    return screened.select("col_idx", "col_name", "reason_code", "reason", "is_candidate")


@query
def candidate_columns_catalog(spark, sf_dir):
    screened = screen_columns(spark, driver_tables(spark, sf_dir), planted.land(spark))
    return screened.select(F.col("file").alias("table_name"), "col_idx", "col_name", "reason_code",
                           "is_candidate")


@query
def name_predicates(spark, sf_dir):
    words = (planted.table(spark, sf_dir, "documents")
             .select(F.explode(F.split("text", "[^A-Za-z]+")).alias("word")).distinct()
             .filter(F.length("word") > 0))
    label = (F.when(F.length("word") % 5 == 0, F.concat(F.lit(" MTurk"), "word"))
             .when(F.length("word") % 5 == 1, F.concat(F.lit("mturkcode"), "word"))
             .when(F.length("word") % 5 == 2, F.lit(" WorkerID ")).otherwise(""))
    named = words.withColumn("label", label)
    return named.select("word", names.is_forced_name(F.col("word"), F.col("label")).alias("forced"),
                        names.is_platform_name(F.col("word"), F.col("label")).alias("platform"))


# --- long form and value counts ----------------------------------------------

def _with_names(spark: SparkSession, tables: list[Table], rows: DataFrame) -> DataFrame:
    named = local_relation(spark, [(r.col_id, r.col_idx, r.col_name) for r in catalog(tables)],
                           "col_id int, col_idx int, col_name string")
    return rows.join(named, "col_id").drop("col_id")


@query
def melted_cells(spark, sf_dir):
    tables = [driver_table(spark, sf_dir, "part")]
    return _with_names(spark, tables, values.melt_all(tables, catalog(tables)))


@query
def value_counts_segment(spark, sf_dir):
    tables = [survey_table(spark, sf_dir)]
    refs = [r for r in catalog(tables) if r.col_name == "segment"]
    counts = values.value_counts(values.melt_all(tables, refs))
    return (counts.groupBy(text.strip_controls(F.col("value")).alias("value"))
            .agg(F.sum("cnt").alias("cnt")))


@query
def value_counts_orders(spark, sf_dir):
    tables = [driver_table(spark, sf_dir, "orders")]
    return _with_names(spark, tables, values.count_columns(tables, catalog(tables)))


@query
def sketched_distinct(spark, sf_dir):
    """Line items that came in three batches: exact distinct counts, and whether the sketches' bounds hold them."""
    table = driver_table(spark, sf_dir, "lineitem")
    bounds = _arrived(spark, table, "l_orderkey", sketches=True).distinct_estimates()
    exact = values.distinct_stats(values.count_columns([table], catalog([table]))).select("col_id", F.col("n_unique").alias("exact"))
    held = F.col("exact").between(F.col("at_least"), F.col("at_most"))
    return _with_names(spark, [table], bounds.join(exact, "col_id").select(
        "col_id", F.col("exact").alias("n_unique"), held.alias("in_bounds"))).drop("col_idx")


# --- value samples -------------------------------------------------------------

def _samples(spark: SparkSession, table: Table, column: str, mean_len: float = 0) -> DataFrame:
    refs = [r for r in catalog([table]) if r.col_name == column]
    cells = values.melt_all([table], refs)
    n_rows = cells.groupBy("col_id").agg(F.count(F.lit(1)).alias("n_rows"))
    shown = tabulate.tabulate_columns([table], refs, n_rows, {refs[0].col_id: mean_len})
    return shown.select("grp", "rank", "value", "cnt", "pct", "n_unique")


@query
def tabulation_all(spark, sf_dir):
    return _samples(spark, driver_table(spark, sf_dir, "orders"), "o_orderpriority")


@query
def tabulation_sampled(spark, sf_dir):
    return _samples(spark, survey_table(spark, sf_dir), "note")


@query
def tabulation_names(spark, sf_dir):
    return _samples(spark, driver_table(spark, sf_dir, "customer"), "c_name")


@query
def tabulation_documents(spark, sf_dir):
    return _samples(spark, driver_table(spark, sf_dir, "documents"), "text", mean_len=1000)


@query
def tabulation_pages(spark, sf_dir):
    return _samples(spark, driver_table(spark, sf_dir, "pages"), "html", mean_len=1000)


@query
def tabulation_conversations(spark, sf_dir):
    return _samples(spark, driver_table(spark, sf_dir, "conversations"), "text")


@query
def pattern_reserve(spark, sf_dir):
    tables = [survey_table(spark, sf_dir)]
    refs = [r for r in catalog(tables) if r.col_name in ("note", "email")]
    counts = tabulate.clean_counts(values.melt_all(tables, refs))
    return _with_names(spark, tables, tabulate.reserved_values(counts)).select(
        "col_name", "pattern", "value", "cnt")


@query
def rendered_samples(spark, sf_dir):
    tables = [driver_table(spark, sf_dir, "part")]
    shown = tabulate_candidates(spark, tables, screen_columns(spark, tables))
    return _with_names(spark, tables, tabulate.render(shown)).drop("col_idx")


# --- text patterns ---------------------------------------------------------------

@query
def text_identifier_rates(spark, sf_dir):
    parts = []
    for name, column in (("documents", "text"), ("pages", "url"), ("pages", "html"),
                         ("conversations", "text")):
        v = F.col(column)
        parts.append(planted.table(spark, sf_dir, name).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(text.has_email(v)).alias("n_email"),
            F.count_if(text.has_web(v)).alias("n_web"),
            F.count_if(text.has_long_digits(v)).alias("n_long_digit"),
        ).withColumn("source", F.lit(f"{name}.{column}")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def token_identifiers(spark, sf_dir):
    """Every distinct word of the documents through all value patterns."""
    w = F.col("word")
    words = (planted.table(spark, sf_dir, "documents")
             .select(F.explode(F.split("text", "[ \n]+")).alias("word")).distinct().filter(F.length(w) > 0))
    return words.select(
        "word", text.has_email(w).alias("email"), text.has_web(w).alias("web"),
        text.has_long_digits(w).alias("long_digit"), text.is_prolific(w).alias("prolific"),
        text.is_mturk(w).alias("mturk"), text.ip_class(w).alias("ip_class"))


def _floors(spark: SparkSession, table: Table, columns: tuple[str, ...]) -> DataFrame:
    profiled = profiled_columns(spark, [table]).filter(F.col("col_name").isin(*columns))
    return patterns.pattern_floors(profiled)


@query
def platform_id_floor(spark, sf_dir):
    return _floors(spark, survey_table(spark, sf_dir), ("prolific_pid", "panel_code")).select(
        "col_name", "n_nonnull", "prolific_n", "mturk_n", "floor_met", "pii_type", "note")


@query
def ip_floor(spark, sf_dir):
    return _floors(spark, survey_table(spark, sf_dir), ("ip_addr",)).select(
        "col_name", "ip_loose_n", "ip_strict_n", "ip_public_n", "floor_met", "pii_type", "note")


@query
def pattern_floors(spark, sf_dir):
    table = survey_table(spark, sf_dir)
    strings = tuple(r.col_name for r in catalog([table]) if r.kind == "string")
    return _floors(spark, table, strings).select("col_name", "floor_met", "pii_type", "note")


@query
def pattern_stats_catalog(spark, sf_dir):
    """Pattern matches of all text columns of all tables, from the one-scan profile."""
    p = profiled_columns(spark, driver_tables(spark, sf_dir)).filter("kind = 'string'")
    return p.select(F.col("file").alias("table_name"), "col_name", "n_nonnull", "prolific_n", "mturk_n",
                    "ip_loose_n", "ip_strict_n", "ip_public_n")


@query
def pattern_stats_counts(spark, sf_dir):
    """The same statistics from value counts."""
    tables = [survey_table(spark, sf_dir)]
    refs = [r for r in catalog(tables) if r.kind == "string"]
    stats = patterns.pattern_stats(values.value_counts(values.melt_all(tables, refs)))
    return _with_names(spark, tables, stats).drop("col_idx")


# --- coordinates ---------------------------------------------------------------------

@query
def gps_precheck(spark, sf_dir):
    p = profiled_columns(spark, [survey_table(spark, sf_dir), stops_table(spark, sf_dir)])
    return p.filter("kind = 'numeric'").select(
        F.col("file").alias("table_name"), "col_idx", "col_name", "gps_precheck")


def _pair_shares(spark: SparkSession, tables: list[Table]) -> DataFrame:
    columns = profiled_columns(spark, tables)
    pairs = coordinates.list_pairs(columns)
    complete = coordinates.pair_completeness(tables, pairs).filter(
        coordinates.is_complete(F.col("n_either"), F.col("n_both")))
    rows = {r.pair_id: r for r in complete.collect()}    # at most two pairs per column
    pairs = [p for p in pairs if p.pair_id in rows]
    points = coordinates.sample_points(tables, pairs, {i: r.n_both for i, r in rows.items()})
    info = local_relation(
        spark, [(p.pair_id, p.a_idx, p.b_idx, rows[p.pair_id].n_either, rows[p.pair_id].n_both) for p in pairs],
        "pair_id int, a_idx int, b_idx int, n_either bigint, n_both bigint")
    return coordinates.land_shares(points, planted.land(spark)).join(info, "pair_id").drop("pair_id")


@query
def gps_pairs(spark, sf_dir):
    return _pair_shares(spark, [survey_table(spark, sf_dir)])


@query
def gps_pairs_sampled(spark, sf_dir):
    return _pair_shares(spark, [stops_table(spark, sf_dir)])


@query
def gps_edges(spark, sf_dir):
    return _pair_shares(spark, [Table(planted.edges(spark, sf_dir), "edges", row_key=("edge_id",))])


@query
def gps_candidates(spark, sf_dir):
    tables = [survey_table(spark, sf_dir), stops_table(spark, sf_dir)]
    columns = profiled_columns(spark, tables)
    found = coordinates.gps_candidates(spark, tables, columns, planted.land(spark))
    return found.join(columns.select("col_id", "file", "col_name"), "col_id").select(
        F.col("file").alias("table_name"), "col_name", "role", "share", "n", "reason")


# --- duplicates and results -------------------------------------------------------------

def _document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a file. Digests are kept, so texts are read and hashed once."""
    docs = planted.table(spark, sf_dir, "documents")
    digests = durable(docs.select(
        F.col("source").alias("dataset_id"), F.col("doc_id").cast("string").alias("path"),
        duplicates.content_digest(F.col("text")).alias("digest"), (F.col("n_chars") > 200).alias("loaded"),
        "doc_id"))
    return duplicates.with_primary(digests)


@query
def exact_duplicates(spark, sf_dir):
    return _document_files(spark, sf_dir).select("path", "digest", "primary_path")


@query
def duplicate_groups(spark, sf_dir):
    docs = planted.table(spark, sf_dir, "documents")
    return duplicates.duplicate_groups(docs.select(
        F.col("doc_id").cast("string").alias("path"), duplicates.content_digest(F.col("text")).alias("digest")))


def _document_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = _document_files(spark, sf_dir)
    verdict = F.element_at(F.array(*[F.lit(v) for v in (
        "direct_pii", "possible_indirect", "internal_id", "not_pii", "error")]), (F.col("doc_id") % 5 + 1).cast("int"))
    primaries = files.filter("loaded and path = primary_path").select(
        "dataset_id", F.col("path").alias("file"), F.explode(F.array(F.lit("text"), F.lit("lang"))).alias("col_name"),
        verdict.alias("evaluation"), F.lit("").alias("duplicate_of"))
    return files, duplicates.copy_to_duplicates(primaries, files)


@query
def duplicate_results(spark, sf_dir):
    return _document_results(spark, sf_dir)[1]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tabwarden-{name}-{uuid.uuid4().hex}"


def _saved(spark: SparkSession, sf_dir: str, save_again: Callable) -> str:
    """A folder with the results of all datasets, after src1 was saved again by a run that found nothing."""
    _, results = _document_results(spark, sf_dir)
    full = results.select("*", *[F.lit("").alias(c) for c in RESULT_COLUMNS if c not in results.columns])
    run = planted.table(spark, sf_dir, "documents").select(F.col("source").alias("dataset_id")).distinct().withColumn("version", F.lit("1"))
    issues = local_relation(spark, [], "dataset_id string, level string, message string")
    folder = _folder(spark, "saved")
    overview = run.select("dataset_id", F.lit("version").alias("metric"), F.col("version").alias("value"))
    save_results(folder, full, issues, run, overview)
    save_again(folder, full.limit(0), issues, run.filter("dataset_id = 'src1'"), overview.filter("dataset_id = 'src1'"))
    return folder


def _counted(results: DataFrame, messages: DataFrame) -> DataFrame:
    kept = results.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    said = messages.select("dataset_id", F.lit(0).cast("bigint").alias("n"))
    return kept.unionByName(said).withColumn("dataset_id", F.col("dataset_id").cast("string"))


@query
def saved_results(spark, sf_dir):
    """What is in place after two saves."""
    folder = _saved(spark, sf_dir, save_results)
    return _counted(spark.read.parquet(f"{folder}/results"), spark.read.parquet(f"{folder}/messages"))


@query
def saved_results_interrupted(spark, sf_dir):
    """The same where the second save stopped as soon as it was committed, before anything moved."""
    folder = _saved(spark, sf_dir, commit_results)
    return _counted(read_results(spark, folder), read_results(spark, folder, "messages"))


@query
def result_counts(spark, sf_dir):
    return reports.result_counts(_document_results(spark, sf_dir)[1])


@query
def file_counts(spark, sf_dir):
    return reports.file_counts(_document_files(spark, sf_dir))


@query
def overview_rows(spark, sf_dir):
    files, results = _document_results(spark, sf_dir)
    summary = reports.dataset_summary(files.select("dataset_id").distinct(), reports.file_counts(files),
                                      reports.result_counts(results))
    run = summary.withColumns({"package_name": F.col("dataset_id"), "model": F.lit("rules"), "ended": F.lit("")})
    return reports.overview(run)


@query
def metadata_rows(spark, sf_dir):
    files, results = _document_results(spark, sf_dir)
    return reports.key_values(reports.dataset_summary(
        files.select("dataset_id").distinct(), reports.file_counts(files), reports.result_counts(results)))


# --- answers and verdicts ------------------------------------------------------------------

@query
def parse_answers(spark, sf_dir):
    raw = planted.derived(spark, sf_dir, planted.ANSWERS, ("conversations",))
    return (raw.withColumn("answer", answers.answer_json(F.col("raw")))
            .select("conv_id", "turn",
                    answers.answer_field(F.col("answer"), "evaluation").alias("evaluation"),
                    answers.answer_field(F.col("answer"), "reasoning").alias("reasoning"),
                    answers.first_word(answers.answer_field(F.col("answer"), "looks_like_coordinate")).alias("word"))
            .withColumn("valid", F.col("evaluation").isNotNull()))


@query
def first_valid_attempt(spark, sf_dir):
    attempts = planted.derived(spark, sf_dir, planted.ATTEMPTS, ("events",))
    return first_valid(attempts, "col_key").select("col_key", "attempt", "prompt_tokens")


@query
def merged_verdicts(spark, sf_dir):
    rows = planted.derived(spark, sf_dir, planted.VERDICT_INPUTS, ("events",))
    return merge_verdicts(rows).select("event_id", "evaluation", "reasoning")


@query
def survey_verdicts(spark, sf_dir):
    """Screen the survey, score its patterns, and merge with planted answers."""
    screened = screen_columns(spark, [survey_table(spark, sf_dir)], planted.land(spark)).filter("is_candidate")
    planted_answer = (
        F.when(F.col("col_idx") == 10, "Yes!").when(F.col("col_idx") == 11, "no, it's a score")
        .when(F.col("col_idx") % 4 == 0, F.lit(None)).when(F.col("col_idx") % 4 == 1, "direct_pii")
        .when(F.col("col_idx") % 4 == 2, "not_pii").otherwise("internal_id"))
    rows = screened.join(floors_of(screened).drop("pii_type"), "col_id").withColumns({
        "is_gps": F.col("reason_code") == "gps", "value": planted_answer, "answer_reasoning": F.col("col_name")})
    return merge_verdicts(rows).select("col_idx", "col_name", "evaluation")


@query
def usage_totals(spark, sf_dir):
    attempts = planted.derived(spark, sf_dir, planted.ATTEMPTS, ("events",))
    return reports.usage_totals(attempts, "dataset_id")


@query
def throughput_minute(spark, sf_dir):
    return reports.throughput(planted.table(spark, sf_dir, "events"))


@query
def throughput_stream(spark, sf_dir):
    """The same from a stream, without the total; each trigger's answer replaces the one before."""
    path = f"{sf_dir}/events.parque[t]"  # as a pattern, a file and a folder are both taken
    log = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    folder = _folder(spark, "stream")

    def replace(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/minutes")

    (stream_minutes(log).writeStream.outputMode("complete").foreachBatch(replace)
     .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{folder}/minutes").select(
        F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "columns_processed")


@query
def archive_manifest_rows(spark, sf_dir):
    """Documents as files of their source, two in three of them archives at the top."""
    doc = F.col("doc_id")
    ending = F.element_at(F.array(F.lit(".zip"), F.lit(".tar.gz"), F.lit("/in.csv"), F.lit("/deep.zip"), F.lit(".RAR")),
                          (doc % 5 + 1).cast("int"))
    files = planted.table(spark, sf_dir, "documents").select(
        F.col("source").alias("dataset_id"), F.concat(doc.cast("string"), ending).alias("path"),
        (F.col("n_chars") * 1000).alias("length"), F.sha2("text", 256).alias("digest"))
    return archive_manifest(files)


# --- ledger ------------------------------------------------------------------------------------

def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = planted.derived(spark, sf_dir, planted.LEDGER, ("customer",))
    found = planted.derived(spark, sf_dir, planted.DISCOVERED, ("orders",))
    return ledger.reconcile(known, found)


@query
def ledger_transition(spark, sf_dir):
    return _ledger(spark, sf_dir).select("package_path", "status", "notes", "n_files_total", "priority")


@query
def ledger_versions(spark, sf_dir):
    """The ledger as a third version of its store gives it back."""
    store = LedgerStore(spark, _folder(spark, "ledger"))
    found = _ledger(spark, sf_dir)
    store.write(found.limit(0))
    store.write(found)
    return store.write(store.read()).select("package_path", "status", "notes", "n_files_total", "priority")


@query
def ledger_status_counts(spark, sf_dir):
    return ledger.status_counts(_ledger(spark, sf_dir))


@query
def ledger_finish(spark, sf_dir):
    summaries = planted.derived(spark, sf_dir, planted.SUMMARIES, ("orders",))
    done = ledger.finish(_ledger(spark, sf_dir), summaries)
    return done.select("package_path", "status", "notes", "n_files_total", "archive_files", "priority")


@query
def ledger_two_writers(spark, sf_dir):
    """Two writers finish half of the packages each; the second commits while the first is at work."""
    folder = _folder(spark, "ledger")
    summaries = planted.derived(spark, sf_dir, planted.SUMMARIES, ("orders",))
    half = F.pmod(F.xxhash64("package_path"), F.lit(2)) == 0
    one, other = LedgerStore(spark, folder), LedgerStore(spark, folder)
    one.write(_ledger(spark, sf_dir))
    met: list[int] = []

    def step(known: DataFrame) -> DataFrame:
        if not met:
            met.append(1)
            other.update(lambda theirs: ledger.finish(theirs, summaries.filter(~half)))
        return ledger.finish(known, summaries.filter(half))

    done = one.update(step)
    return done.select("package_path", "status", "notes", "n_files_total", "archive_files", "priority")


# --- files and text tables -----------------------------------------------------------------------

@query
def dialect_detection(spark, sf_dir):
    lines = planted.derived(spark, sf_dir, planted.TEXT_LINES, ("customer", "documents"))
    return text_tables.detect_delimiters(lines)


@query
def encoding_check(spark, sf_dir):
    contents = planted.table(spark, sf_dir, "documents").select("doc_id", F.unhex(F.concat(
        F.hex(F.encode("text", "UTF-8")), F.when(F.col("doc_id") % 10 == 0, "E9").otherwise(""))).alias("content"))
    return text_tables.invalid_utf8(contents, "doc_id")


@query
def missing_tokens(spark, sf_dir):
    """Cells of a text table with missing-value markers planted among them."""
    cells = planted.derived(spark, sf_dir, planted.MARKED_CELLS, ("orders",))
    return text_tables.null_missing(cells).agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_v"),
                                               F.count("w").alias("n_w"))


@query
def text_files(spark, sf_dir):
    """Customers as a text file for each nation, loaded as a package: the type and the filled cells of each column.

    Files differ in how many columns they have and in the type that the codes fit.
    """
    nation = F.col("c_nationkey")
    rows = planted.table(spark, sf_dir, "customer").select(
        "c_nationkey", "c_custkey", "c_name",
        F.when(nation % 3 == 0, F.col("c_custkey").cast("string"))
        .when(nation % 3 == 1, F.concat(F.col("c_custkey").cast("string"), F.lit(".5")))
        .otherwise(F.concat(F.lit("x"), F.col("c_custkey"))).alias("code"),
        F.when(F.col("c_custkey") % 4 == 0, "NA").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.lit("true").alias("flag"))
    folder = _folder(spark, "texts")
    for wide in (0, 1):
        part = rows.filter(nation % 2 == wide).drop(*([] if wide else ["flag"]))
        part.repartition("c_nationkey").write.mode("append").partitionBy("c_nationkey").option("header", True).csv(folder)
    package = load_package(spark, folder, "texts")
    found = profiled_columns(spark, package.tables)
    return found.select(F.regexp_extract("file", "c_nationkey=([0-9]+)/", 1).cast("int").alias("nation"),
                        "col_name", "kind", "n_rows", "n_nonnull")


@query
def path_parts(spark, sf_dir):
    p = F.col("path")
    rows = planted.derived(spark, sf_dir, planted.FILE_PATHS, ("customer",))
    return rows.select("path", paths.base_name(p).alias("base"), paths.extension(p).alias("ext"),
                       paths.is_junk(p).alias("junk"), paths.archive_kind(p).alias("archive"),
                       paths.load_kind(p).alias("kind"))



# --- the whole run ----------------------------------------------------------------------------------

def rule_responder(prompts: list[str]) -> list[str]:
    """A stand-in classifier that answers by the column name in the prompt."""
    out = []
    for p in prompts:
        name = p.split("\nColumn: ", 1)[1].split("\n", 1)[0]
        if "looks_like_coordinate" in p:
            out.append('{"reasoning": "generic name", "looks_like_coordinate": "unclear"}')
        else:
            verdict = "direct_pii" if name in ("full_name", "email", "phone") else "not_pii"
            out.append('{"reasoning": "judged %s", "evaluation": "%s"}' % (name, verdict))
    return out


@query
def screen_survey(spark, sf_dir):
    result = screen_dataset(spark, [survey_table(spark, sf_dir)], planted.land(spark), rule_responder,
                            waits=(0, 0, 0))
    return result.results.select("file", "col_name", "n_rows", "filter_reason", "evaluation", "duplicate_of")


def silent_responder(prompts: list[str]) -> list[str]:
    return ["nothing is to be asked"] * len(prompts)


@query
def screen_survey_again(spark, sf_dir):
    """The survey screened a second time, by a classifier that has no answers: all are known from the first."""
    store = AnswerStore(spark, _folder(spark, "answers"), "rules")
    args = {"land": planted.land(spark), "waits": (0, 0, 0), "answers": store}
    screen_dataset(spark, [survey_table(spark, sf_dir)], responder=rule_responder, **args)
    result = screen_dataset(spark, [survey_table(spark, sf_dir)], responder=silent_responder, **args)
    return result.results.select("file", "col_name", "n_rows", "filter_reason", "evaluation", "duplicate_of")


@query
def screen_damaged_column(spark, sf_dir):
    """The survey with one more column, some cells of which cannot be read."""
    table = survey_table(spark, sf_dir)
    broken = F.when(F.col("respondent_id") % 97 == 5, F.raise_error(F.lit("damaged cell"))).otherwise(F.col("full_name"))
    result = screen_dataset(spark, [replace(table, df=table.df.withColumn("damaged", broken))], planted.land(spark),
                            rule_responder, waits=(0, 0, 0))
    return result.results.select("file", "col_name", "n_rows", "filter_reason", "evaluation", "duplicate_of")


@query
def dry_run_catalog(spark, sf_dir):
    result = screen_dataset(spark, driver_tables(spark, sf_dir), planted.land(spark))
    return result.results.select("file", "col_name", "n_rows", "evaluation")
