"""The rule cascade that decides which columns could hold personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import rules
from ..functions import names, text

SENT_CODES = ("forced_name", "platform_name", "datetime", "large_integer", "text", "unknown_type",
              "gps")


def apply_cascade(profile: DataFrame, stats: DataFrame, gps: DataFrame | None = None) -> DataFrame:
    """Add reason_code, reason and is_candidate; the first rule that applies decides.

    profile: column catalog joined with column profiles. stats: n_unique and
    min_count of the text columns whose categorical rule is open; columns left
    out have too many distinct values for it. gps: optional (col_id, reason) of
    columns that pair as coordinates, which skip the rules.
    """
    p = profile.join(stats, "col_id", "left")
    ratio = F.try_divide("n_unique", "n_nonnull")
    categorical = (
        (F.col("n_unique") <= rules.CATEGORY_MAX_DISTINCT)
        & (F.col("min_count") >= rules.CATEGORY_MIN_COUNT)
        & (ratio < rules.CATEGORY_MAX_RATIO)
    )
    name, label = F.col("col_name"), F.col("label")
    numeric, string = F.col("kind") == "numeric", F.col("kind") == "string"
    code = (
        F.when(F.col("n_nonnull") == 0, "empty")
        .when(names.is_forced_name(name, label), "forced_name")
        .when(names.is_platform_name(name, label), "platform_name")
        .when(F.col("kind") == "bool", "boolean")
        .when(F.col("kind") == "datetime", "datetime")
        .when(numeric & (F.col("max_abs") < rules.SMALL_NUMBER_BELOW), "small_number")
        .when(numeric & F.col("has_frac"), "large_fraction")
        .when(numeric, "large_integer")
        .when(string & (F.col("max_len") < rules.SHORT_TEXT_BELOW), "short_text")
        .when(string & categorical, "categorical")
        .when(string, "text")
        .otherwise("unknown_type")
    )
    if gps is None:
        p = p.withColumn("gps_reason", F.lit(None).cast("string"))
    else:
        p = p.join(gps.select("col_id", F.col("reason").alias("gps_reason")), "col_id", "left")
    p = p.withColumn("reason_code", F.when(F.col("gps_reason").isNotNull(), "gps").otherwise(code))
    c = F.col("reason_code")
    largest = F.coalesce(F.col("max_text"), text.plain_double(F.col("max_abs")))
    reason = (
        F.when(c == "gps", F.col("gps_reason"))
        .when(c == "empty", "no values at all")
        .when(c == "forced_name", "name or label is on the always-check list")
        .when(c == "platform_name", "name or label announces a platform participant ID")
        .when(c == "boolean", "boolean column")
        .when(c == "datetime", "date or time column")
        .when(c == "small_number", F.concat(F.lit("small numbers (largest "), largest, F.lit(")")))
        .when(c == "large_fraction",
              F.concat(F.lit("large numbers with fractions (largest "), largest, F.lit(")")))
        .when(c == "large_integer",
              F.concat(F.lit("large whole numbers, maybe IDs or phones (largest "), largest, F.lit(")")))
        .when(c == "short_text",
              F.concat(F.lit("short text (longest "), F.col("max_len").cast("string"), F.lit(")")))
        .when(c == "categorical",
              F.concat(F.lit("categories ("), F.col("n_unique").cast("string"),
                       F.lit(" values, rarest seen "), F.col("min_count").cast("string"), F.lit(" times)")))
        .when(c == "text", F.concat(F.lit("text (longest "), F.col("max_len").cast("string"), F.lit(")")))
        .otherwise(F.concat(F.lit("unknown type ("), "spark_type", F.lit("), sent to be safe")))
    )
    return (p.withColumn("reason", reason)
            .withColumn("is_candidate", c.isin(*SENT_CODES))
            .drop("gps_reason"))
