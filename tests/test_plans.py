"""Plans have to stay those that hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from tabwarden.operators import coordinates, duplicates, profile, tabulate, values
from tabwarden.plans.local import local_relation
from tabwarden.sources import files
from tabwarden.sources.tables import Table, catalog


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "wide")
    spark.range(500).selectExpr("id as a", "concat('n', id) as b", "id / 8.0D as c", "repeat('x', 300) as d",
                                "timestamp_seconds(id) as e").write.parquet(path)
    return Table(spark.read.parquet(path), "wide")


def refs_of(table, *names):
    return [r for r in catalog([table]) if r.col_name in names]


def test_only_candidate_columns_are_read(wide):
    plan = plan_of(values.count_columns([wide], refs_of(wide, "a", "b")))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == {"a:bigint", "b:string"}


def test_profile_scans_once_and_shuffles_one_row_per_task(wide):
    plan = plan_of(profile.profile_tables([wide]))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "SinglePartition" in plan
    assert "partial_count" in plan and "Sort" not in plan


def test_repeats_fold_before_the_shuffle(wide):
    plan = plan_of(values.count_columns([wide], refs_of(wide, "b")))
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "partial_count(1)" in below


def test_long_texts_are_counted_by_digest_alone(wide):
    plan = plan_of(tabulate.digest_counts(values.melt_all([wide], refs_of(wide, "d"))))
    shuffled = re.search(r"Exchange hashpartitioning\(([^)]*)\)", plan).group(1)
    assert "digest" in shuffled and "value" not in shuffled


def test_the_counting_shuffle_runs_once(spark, wide):
    counts = tabulate.count_candidates([wide], refs_of(wide, "b"))
    out = tabulate.tabulate(counts, local_relation(spark, [(1, 500)], "col_id int, n_rows bigint"))
    out.collect()
    assert "ReusedExchange" in plan_of(out) or "ReusedExchange" in out._jdf.queryExecution().toString()


def test_land_test_is_an_equi_join(spark, wide):
    points = spark.range(50).selectExpr("1 as pair_id", "int(id) as point_id", "40.5D + id / 100 as a", "-100.5D as b")
    land = spark.range(1000).selectExpr("int(id % 180) as lat_idx", "int(id % 300) as lon_start", "int(id % 300 + 9) as lon_end")
    plan = plan_of(coordinates.land_shares(points, land))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "lat_idx" in plan


def test_listing_files_reads_no_content(spark, wide, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    plan = plan_of(files.inventory(spark, str(tmp_path), "d"))
    assert "content" not in re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)


def test_copies_of_a_file_fold_before_the_shuffle(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("path"), F.lit("d").alias("digest"))
    plan = plan_of(duplicates.duplicate_groups(df))
    assert "partial_min" in plan and "Window" not in plan


def test_a_damaged_table_costs_itself_only(spark, tmp_path):
    from tabwarden.plans import screen

    good = [Table(spark.range(50).selectExpr("id", f"concat('n', id) as v{i}"), f"t{i}", dataset_id="d") for i in range(5)]
    spark.range(20).write.parquet(str(tmp_path / "bad"))
    bad = Table(spark.read.schema("id string").parquet(str(tmp_path / "bad")), "bad", dataset_id="d")
    calls = []
    rows_of = screen.profile_rows

    def counted(tables):
        calls.append(len(tables))
        return rows_of(tables)

    screen.profile_rows = counted
    try:
        tables, columns, issues = screen.readable_tables(spark, [*good[:3], bad, *good[3:]])
    finally:
        screen.profile_rows = rows_of
    assert [t.file for t in tables] == [t.file for t in good] and columns.count() == 10
    assert len(issues) == 1 and issues[0][2].startswith("bad: could not be read") and calls == [6, 3, 3, 1, 2]
    assert [r.file for r in columns.orderBy("col_id").collect()] == [t.file for t in good for _ in range(2)]
