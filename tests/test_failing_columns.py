"""A column that fails costs only itself."""
from pyspark.sql import functions as F
import pytest

from tabwarden.plans.bisect import bisected, first_line
from tabwarden.plans.screen import readable_columns, screen_dataset
from tabwarden.sources.tables import Table


@pytest.mark.parametrize("bad", [set(), {3}, {0, 9}, {4, 5, 6}, set(range(10))])
def test_bisected_finds_the_parts_that_fail(bad):
    runs = []

    def run(parts):
        runs.append(list(parts))
        if bad.intersection(parts):
            raise ValueError(f"no {parts}")
        return sum(parts)

    done, failed = bisected(range(10), run)
    assert sorted(p for parts, _ in done for p in parts) == sorted(set(range(10)) - bad)
    assert all(total == sum(parts) for parts, total in done)
    assert [p for p, _ in failed] == sorted(bad) and len(runs) <= 1 + 8 * len(bad)
    assert bisected([], run) == ([], [])


def test_first_line():
    assert first_line(ValueError("")) == "ValueError"
    assert first_line(ValueError("a\nb")) == "a"
    assert first_line(ValueError("Job aborted\n [DIVIDE_BY_ZERO] x")) == "[DIVIDE_BY_ZERO] x"


def broken(cell, every=50):
    return F.when(F.col("id") % every == 7, F.raise_error(F.lit("damaged cell"))).otherwise(cell)


def people(spark):
    df = spark.range(300).select(
        "id", F.concat(F.lit("secret-"), "id").alias("token"), broken(F.lit("x")).alias("d1"),
        (F.col("id") / 7 + 4000).cast("long").alias("n"), broken(F.col("id") * 1.5).alias("d2"),
        F.concat(F.lit("person "), "id").alias("note"))
    return Table(df, "p.csv", dataset_id="d", labels={"d1": "Date\x0c one"})


def test_failing_columns_become_error_rows(spark):
    fine = Table(spark.range(10).selectExpr("id + 5000 as code"), "fine.csv", dataset_id="d")
    res = screen_dataset(spark, [people(spark), fine], responder=lambda ps: ['{"evaluation": "not_pii"}'] * len(ps), waits=())
    rows = {(r.file, r.col_name): r for r in res.results.collect()}
    assert set(rows) == {("p.csv", c) for c in ("token", "d1", "n", "d2", "note")} | {("fine.csv", "code")}
    bad = rows["p.csv", "d1"]
    assert (bad.evaluation, bad.filter_reason, bad.n_rows, bad.label, bad.tabulation) == ("error", "error", 300, "Date one", "")
    assert "damaged cell" in bad.reasoning and rows["p.csv", "d2"].evaluation == "error"
    assert rows["p.csv", "note"].evaluation == "not_pii"
    run = res.run.first()
    assert (run.n_columns_total, run.n_columns_candidate, run.n_columns_checked, run.n_errors) == (7, 4, 6, 2)


def test_every_column_failing_is_a_failing_table(spark):
    table = Table(people(spark).df.select("d1", "d2"), "bad.csv", dataset_id="d")
    good, columns, issues, bad = readable_columns(spark, [table])
    assert good == [] and columns.isEmpty() and bad == [] and len(issues) == 1 and "could not be read" in issues[0][2]


def test_a_candidate_that_cannot_be_sampled(spark, monkeypatch):
    import tabwarden.plans.screen as screen

    plain = screen.tabulate_candidates

    def some(spark, tables, screened, seed="0"):
        if not screened.filter("is_candidate AND col_name = 'note'").isEmpty():
            raise RuntimeError("no sample today")
        return plain(spark, tables, screened, seed)

    monkeypatch.setattr(screen, "tabulate_candidates", some)
    table = Table(people(spark).df.drop("d1", "d2"), "p.csv", dataset_id="d")
    res = screen_dataset(spark, [table])
    rows = {r.col_name: r for r in res.results.collect()}
    assert rows["note"].evaluation == "error" and "no sample today" in rows["note"].reasoning
    assert rows["note"].filter_reason.startswith("text") and rows["token"].evaluation == "test - not checked"
    assert rows["token"].tabulation and res.run.first().n_errors == 1


def test_coordinates_of_a_table_with_a_failing_column(spark):
    land = spark.createDataFrame([(130, 79, 81)], "lat_idx int, lon_start int, lon_end int")
    df = spark.range(300).select("id", broken(F.lit("x")).alias("d1"), (40.125 + F.col("id") / 1024).alias("v1"),
                                 (-99.5 + F.col("id") / 1024).alias("v2"))
    for key in ((), ("d1",)):      # rows are ordered by whole rows, or by a key that fails
        res = screen_dataset(spark, [Table(df, "t", dataset_id="d", row_key=key)], land)
        rows = {r.col_name: r for r in res.results.collect()}
        assert set(rows) == {"d1", "v1", "v2"} and "latitude" in rows["v1"].filter_reason
