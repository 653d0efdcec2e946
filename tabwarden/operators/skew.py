"""Joins on group keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_KEYS = 1000
SALTS = 64


def hot_keys(many: DataFrame, key: str | list[str], at_least: int = 100_000) -> DataFrame:
    """The most frequent keys, never more than HOT_KEYS of them.

    Any key left out holds less than one part in HOT_KEYS of the rows.
    """
    keys = [key] if isinstance(key, str) else key
    return (many.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)
            .orderBy(F.desc("n"), *keys).limit(HOT_KEYS).select(*keys))


def join_many_to_few(many: DataFrame, few: DataFrame, key: str | list[str], spread_by: str, how: str = "inner",
                     at_least: int = 100_000, salts: int = SALTS) -> DataFrame:
    """many joined with few on key, with hot keys of many spread over salted copies of few.

    The result is that of a plain join: rows with other keys take the ordinary
    path, rows with hot keys meet one of the salted copies of the same few rows.
    how is inner or left.
    """
    keys = [key] if isinstance(key, str) else key
    hot = hot_keys(many, keys, at_least)
    if hot.isEmpty():
        return many.join(few, keys, how)
    hot = F.broadcast(hot)  # at most HOT_KEYS rows, by its limit
    cold_rows = many.join(hot, keys, "left_anti").join(few, keys, how)
    salted = many.join(hot, keys, "left_semi").withColumn(
        "_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    copies = few.join(hot, keys, "left_semi").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    hot_rows = salted.join(copies, [*keys, "_salt"], how).drop("_salt")
    return cold_rows.unionByName(hot_rows)
