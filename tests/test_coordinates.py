"""Coordinate pairs: pre-check, completeness, land test, partners, sampling."""

import pytest
from pyspark.sql import functions as F

from tabwarden.operators import coordinates as geo
from tabwarden.operators.profile import profiled_columns
from tabwarden.plans.screen import screen_columns
from tabwarden.sources.tables import Table

LAND = "lat_idx int, lon_start int, lon_end int"


def land(spark, *runs):
    return spark.createDataFrame(list(runs), LAND)


def found(spark, df, land_df, **kw):
    table = Table(df, "t", **kw)
    columns = profiled_columns(spark, [table])
    return {r.col_id: r for r in geo.gps_candidates(spark, [table], columns, land_df).collect()}


def points(spark, n=100, lat="40 + id / 1024.0", lon="-100 + id / 1024.0", extra=()):
    return spark.range(n).selectExpr(f"double({lat}) as a", f"double({lon}) as b", *extra)


@pytest.mark.parametrize("values, ok", [
    ([1.25], False), ([1.125], True), ([180.0, 1.125], True), ([180.5, 1.125], False), ([-181.0, 1.125], False),
    ([999.0, 1.125], True), ([-99.0, 97.0], False), ([None], False), ([float("nan"), 2.5555], True)])
def test_precheck(spark, values, ok):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert profiled_columns(spark, [Table(df, "t")]).first().gps_precheck is ok


def test_integers_and_booleans_never_pass(spark):
    df = spark.sql("select 45 a, true b, cast(45.421 as decimal(8,3)) c, cast(45.421 as float) d")
    assert [r.gps_precheck for r in profiled_columns(spark, [Table(df, "t")]).orderBy("col_idx").collect()] == [
        False, False, True, True]


def test_pair_both_ways_round(spark):
    runs = land(spark, (130, 79, 81))
    got = found(spark, points(spark), runs)
    assert (got[0].role, got[1].role, got[0].share, got[0].n) == ("latitude", "longitude", 1.0, 100)
    assert got[0].reason == "read as latitude next to b, 100% of 100 sampled positions lie on land"
    swapped = found(spark, points(spark).select("b", "a"), runs)
    assert (swapped[0].role, swapped[1].role) == ("longitude", "latitude")


def test_tie_takes_the_left_column_as_latitude(spark):
    df = points(spark, 50, "10.125 + id / 2048.0", "10.25 + id / 2048.0")
    assert found(spark, df, land(spark, (100, 190, 190)))[0].role == "latitude"


@pytest.mark.parametrize("at_sea, ok", [(10, True), (11, False)])
def test_land_threshold(spark, at_sea, ok):
    df = points(spark, 100, lon=f"if(id < {at_sea}, 20.125, -99.5 + id / 1024.0)")
    assert bool(found(spark, df, land(spark, (130, 79, 81)))) is ok


@pytest.mark.parametrize("lone, ok", [(10, True), (11, False)])
def test_one_sided_limit(spark, lone, ok):
    df = points(spark, 100, lon=f"if(id < {lone}, null, -99.5 + id / 1024.0)")
    assert bool(found(spark, df, land(spark, (130, 79, 81)))) is ok


def test_null_island_and_sentinels_are_missing(spark):
    df = points(spark, 100, "case when id < 40 then 0 when id < 60 then -99 else 40.125 + id / 1024.0 end",
                "case when id < 40 then 0 when id < 60 then -99 else -99.5 + id / 1024.0 end")
    assert found(spark, df, land(spark, (130, 79, 81)))[0].n == 40


def test_buffer_and_antarctica(spark):
    # land row 40..41 north, 100..99 west; points just south of it are within the buffer
    near = points(spark, 50, "39.995 + id / 1000000.0", "-99.5")
    far = points(spark, 50, "39.985 + id / 1000000.0", "-99.5")
    runs = land(spark, (130, 80, 80))
    assert bool(found(spark, near.withColumn("b", F.col("b") + 0.001), runs))
    assert not found(spark, far.withColumn("b", F.col("b") + 0.001), runs)
    south = points(spark, 50, "-60.5 + id / 100000.0", "-99.5 + id / 1024.0")
    assert not found(spark, south, land(spark, (29, 0, 359), (30, 0, 359)))


def test_window_and_best_partner(spark):
    runs = land(spark, (130, 79, 81))
    apart = points(spark, extra=("'x' as p", "'y' as q")).select("a", "p", "q", "b")
    assert not found(spark, apart, runs)
    two = points(spark, 100, extra=("double(if(id < 5, 20.125, -99.5 + id / 1024.0)) as worse",)).select("worse", "a", "b")
    got = found(spark, two, runs)
    assert got[1].partner_id == 2 and got[0].partner_id == 1 and got[0].share == 0.95
    tie = points(spark, extra=("double(-100 + id / 1024.0) as b2",)).select("b", "a", "b2")
    assert found(spark, tie, runs)[1].partner_id == 0


def test_no_pair_falls_through_to_small_numbers(spark):
    row = screen_columns(spark, [Table(points(spark), "t")], land(spark, (0, 0, 0))).first()
    assert row.reason_code == "small_number"
    assert screen_columns(spark, [Table(points(spark), "t")]).first().reason_code == "small_number"


def test_sample_is_the_first_rows_by_digest(spark):
    """The digest cut must never change which rows are sampled, copies of rows included."""
    df = spark.range(60000).selectExpr(
        "if(id % 3 = 0, 7, id) as k", "double(40 + (if(id % 3 = 0, 7, id) % 977) / 1024.0) as a",
        "double(-100 + (if(id % 3 = 0, 7, id) % 883) / 1024.0) as b")
    table = Table(df, "t", row_key=("k",))
    pairs = geo.list_pairs(profiled_columns(spark, [table]))
    cut = geo.sample_points([table], pairs[-1:], {pairs[-1].pair_id: 60000}, wanted=300)
    full = geo.sample_points([table], pairs[-1:], {pairs[-1].pair_id: 300}, wanted=300)
    assert geo.digest_cutoff(60000, 300) and not geo.digest_cutoff(300, 300)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, full.collect()))


def test_short_cut_is_sampled_again(spark, monkeypatch):
    df = spark.range(30000).selectExpr("id as k", "40 + id / 1048576D as a", "-100 + id / 1048576D as b")
    table = Table(df, "t", row_key=("k",))
    pairs = geo.list_pairs(profiled_columns(spark, [table]))
    monkeypatch.setattr(geo, "digest_cutoff", lambda n, wanted: "0001")
    assert geo.sample_points([table], pairs, {pairs[0].pair_id: 30000}, wanted=300).count() == 300


def test_sample_order_without_a_key(spark, tmp_path):
    """Rows of Parquet files are told apart by their place, so copies of a row are separate draws."""
    df = spark.range(400).selectExpr("double(id % 2) as a", "1.125D as b")
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    read = spark.read.parquet(str(tmp_path / "p"))
    assert geo.with_sample_order(Table(read, "t"), [0]).select("k").distinct().count() == 400
    assert geo.with_sample_order(Table(df, "t"), [0]).select("k").distinct().count() == 2
    plan = geo.with_sample_order(Table(read, "t"), [0])._jdf.queryExecution().executedPlan().toString()
    assert "b:double" not in plan
