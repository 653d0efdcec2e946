"""Every cascade rule at and on both sides of its threshold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from tabwarden.operators.profile import merge_profiles, profile_tables
from tabwarden.plans.screen import screen_columns
from tabwarden.sources.tables import Table


def code(spark, values, dtype, name="v", label=None):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField(name, dtype)]))
    labels = {name: label} if label else {}
    row = screen_columns(spark, [Table(df, "t", labels=labels)]).first()
    return row.reason_code


def spread(n_values, each, width=5):
    return [f"{i:0{width}d}" for i in range(n_values) for _ in range(each)]


@pytest.mark.parametrize("values, dtype, expected", [
    ([None, None], T.StringType(), "empty"),
    ([float("nan")], T.DoubleType(), "empty"),
    ([999], T.LongType(), "small_number"),
    ([-999, 5], T.IntegerType(), "small_number"),
    ([1000], T.LongType(), "large_integer"),
    ([-1000], T.LongType(), "large_integer"),
    ([-(2 ** 63)], T.LongType(), "large_integer"),
    ([1000.0, None], T.DoubleType(), "large_integer"),
    ([1000.0, 1.5], T.DoubleType(), "large_fraction"),
    ([999.5], T.DoubleType(), "small_number"),
    ([float("inf")], T.DoubleType(), "large_fraction"),
    (["abc", "ab"], T.StringType(), "short_text"),
    (["abcd", "a"], T.StringType(), "text"),
    ([True, None], T.BooleanType(), "boolean"),
    ([dt.date(2020, 1, 1)], T.DateType(), "datetime"),
    ([dt.datetime(2020, 1, 1)], T.TimestampType(), "datetime"),
    ([[1.0]], T.ArrayType(T.DoubleType()), "unknown_type"),
    (spread(20, 11), T.StringType(), "categorical"),
    (spread(20, 10), T.StringType(), "text"),                    # ratio is 0.1, not below
    (spread(21, 11), T.StringType(), "text"),
    (spread(19, 20) + ["rare1"] * 9, T.StringType(), "text"),
    (spread(19, 20) + ["rare1"] * 10, T.StringType(), "categorical"),
])
def test_rules(spark, values, dtype, expected):
    assert code(spark, values, dtype) == expected


def test_names_come_before_types(spark):
    assert code(spark, [30, 40], T.IntegerType(), "age") == "forced_name"
    assert code(spark, [True], T.BooleanType(), "q1", "Has a disability") == "forced_name"
    assert code(spark, [1], T.IntegerType(), "WorkerId") == "platform_name"
    assert code(spark, [None], T.IntegerType(), "age") == "empty"
    assert code(spark, ["ab"], T.StringType(), "mturkcode") == "short_text"


def test_decimals_and_reasons(spark):
    df = spark.sql("select cast(12345678.0 as double) a, cast(1234.50 as decimal(10,2)) b, 5550001499 c, 'hello' d")
    got = {r.col_name: (r.reason_code, r.reason) for r in screen_columns(spark, [Table(df, "t")]).collect()}
    assert got["a"] == ("large_integer", "large whole numbers, maybe IDs or phones (largest 12345678.0)")
    assert got["b"][0] == "large_fraction" and "1234.50" in got["b"][1]
    assert "5550001499" in got["c"][1] and got["d"][1] == "text (longest 5)"


def test_odd_and_repeated_names(spark):
    df = spark.range(3).toDF("x").selectExpr("x as `a.b`", "x + 5000 as `a b`", "x as `q``s`").toDF("a.b", "a.b", "q`s")
    got = screen_columns(spark, [Table(df, "t")]).orderBy("col_idx").collect()
    assert [(r.col_name, r.reason_code) for r in got] == [
        ("a.b", "small_number"), ("a.b", "large_integer"), ("q`s", "small_number")]


def test_wide_tables_take_several_passes(spark):
    df = spark.range(50).select(*[(F.col("id") * i).alias(f"n{i}") for i in range(70)],
                                *[F.concat(F.lit(f"v{i}"), "id").alias(f"s{i}") for i in range(70)])
    rows = profile_tables([Table(df, "t")], columns_per_pass=30).collect()
    assert len(rows) == 140 and {r.n_rows for r in rows} == {50}
    assert {r.max_abs for r in rows if r.col_id < 70} == {49.0 * i for i in range(70)}


def test_profile_is_the_same_for_any_split(spark):
    df = spark.range(1000).selectExpr(
        "id", "if(id % 3 = 0, null, id / 7.0) as d", "concat('user', id % 40, '@x.org') as s", "id % 2 = 0 as b",
        "concat('8.8.', id % 300, '.', id % 2) as ip")
    whole = sorted(map(tuple, profile_tables([Table(df, "t")]).collect()))
    assert sorted(map(tuple, profile_tables([Table(df.repartition(13), "t")]).collect())) == whole
    halves = profile_tables([Table(df.filter("id < 300"), "t")]).unionByName(
        profile_tables([Table(df.filter("id >= 300"), "t")]))
    assert sorted(map(tuple, merge_profiles(halves).select(*profile_tables([Table(df, "t")]).columns).collect())) == whole
