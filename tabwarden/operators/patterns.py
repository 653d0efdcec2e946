"""Identifier-pattern floors: participant IDs and public IP addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions import names, text


def pattern_stats(counts: DataFrame) -> DataFrame:
    """Row-weighted pattern matches per column, from value counts.

    The same numbers come with the one-scan profile; this form serves counts
    that are kept anyway, such as those of a stream.
    """
    v, cnt = F.col("value"), F.col("cnt")
    graded = counts.withColumn("grade", text.ip_class(v))
    g = F.col("grade")

    def total(hit: Column) -> Column:
        return F.sum(F.when(hit, cnt).otherwise(0))

    return graded.groupBy("col_id").agg(
        F.sum(cnt).alias("n_nonnull"),
        total(text.is_prolific(v)).alias("prolific_n"),
        total(text.is_mturk(v)).alias("mturk_n"),
        total(g >= 1).alias("ip_loose_n"),
        total(g >= 2).alias("ip_strict_n"),
        total(g >= 3).alias("ip_public_n"),
    )


def volume_met(matches: Column, n: Column) -> Column:
    """Enough matches to stand without a telling column name."""
    return F.when(n < rules.VOLUME_SMALL_N, matches > rules.VOLUME_SMALL_MATCHES).otherwise(
        F.try_divide(matches, n) > rules.VOLUME_FRACTION)


def pattern_floors(stats: DataFrame) -> DataFrame:
    """Add floor_met, pii_type and note to rows with col_name, label and pattern stats."""
    n = F.col("n_nonnull")
    pn, mn = F.coalesce("prolific_n", F.lit(0)), F.coalesce("mturk_n", F.lit(0))
    loose, strict, public = (
        F.coalesce(c, F.lit(0)) for c in ("ip_loose_n", "ip_strict_n", "ip_public_n"))
    named = names.is_platform_name(F.col("col_name"), F.col("label"))
    s = stats.withColumns({
        "named": named,
        "prolific_hit": (named & (pn >= 1)) | volume_met(pn, n),
        "mturk_hit": (named & (mn >= 1)) | volume_met(mn, n),
        "ip_hit": (loose >= 1)
        & F.coalesce(F.try_divide(strict, loose) >= rules.IP_STRICT_RATIO, F.lit(False))
        & (public >= 1),
    })
    platform = (
        F.when(F.col("prolific_hit") & (pn >= mn), "prolific")
        .when(F.col("prolific_hit") | F.col("mturk_hit"), "mturk")
    )
    s = s.withColumn("platform", platform)
    is_prolific = F.col("platform") == "prolific"
    hits = F.when(is_prolific, pn).otherwise(mn)
    brand = F.when(is_prolific, "Prolific").otherwise("MTurk")
    score = F.concat(text.percent(F.try_divide(hits, n)), F.lit(" ("), hits.cast("string"),
                     F.lit("/"), n.cast("string"), F.lit(")"))
    by_name = F.concat(F.lit("[Pattern: platform-ID name, "), score, F.lit(" of values have the "),
                       brand, F.lit(" ID form]"))
    by_volume = F.concat(F.lit("[Pattern: "), score, F.lit(" of values have the "), brand,
                         F.lit(" ID form, name says nothing]"))
    platform_note = F.when(F.col("platform").isNotNull(),
                           F.when(F.col("named") & (hits >= 1), by_name).otherwise(by_volume))
    ip_note = F.when(F.col("ip_hit"), F.concat(
        F.lit("[Pattern: "), text.percent(F.try_divide(strict, loose)), F.lit(" ("),
        strict.cast("string"), F.lit("/"), loose.cast("string"),
        F.lit(") valid IP addresses, "), public.cast("string"), F.lit(" public]")))
    return s.withColumns({
        "floor_met": F.col("platform").isNotNull() | F.col("ip_hit"),
        "pii_type": F.coalesce(F.col("platform"), F.when(F.col("ip_hit"), "ip")),
        "note": F.concat_ws(" ", platform_note, ip_note),
    }).drop("named", "prolific_hit", "mturk_hit", "ip_hit", "platform")
