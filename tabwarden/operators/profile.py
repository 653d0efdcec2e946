"""One-scan column profiles.

Every statistic is mergeable (counts, sums, maxima, or-ed bits), so each task
ships one row per table and nothing is shuffled but those rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import rules
from ..plans.local import local_relation
from ..sources.tables import ColumnRef, Table, catalog

PROFILE_SCHEMA = T.StructType([
    T.StructField("col_id", T.IntegerType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("n_nonnull", T.LongType()),
    T.StructField("max_abs", T.DoubleType()),
    T.StructField("max_text", T.StringType()),
    T.StructField("has_frac", T.BooleanType()),
    T.StructField("max_len", T.IntegerType()),
    T.StructField("sum_len", T.LongType()),
    T.StructField("seen_bits", T.LongType()),
    T.StructField("prolific_n", T.LongType()),
    T.StructField("mturk_n", T.LongType()),
    T.StructField("ip_loose_n", T.LongType()),
    T.StructField("ip_strict_n", T.LongType()),
    T.StructField("ip_public_n", T.LongType()),
    T.StructField("gps_max", T.DoubleType()),
    T.StructField("gps_precise", T.BooleanType()),
])
COLUMN_SCHEMA = T.StructType([
    T.StructField("col_id", T.IntegerType()),
    T.StructField("table_id", T.IntegerType()),
    T.StructField("dataset_id", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("sheet", T.StringType()),
    T.StructField("col_idx", T.IntegerType()),
    T.StructField("col_name", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("spark_type", T.StringType()),
])
MAX_DEALT_BYTES = 1 << 29     # larger tables have splits enough for a scan
INTEGRALS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def clean_number(x: Column, dtype: T.DataType) -> Column:
    """The number with NaN read as missing."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(x), x.cast("double"))
    return x


def drop_sentinels(x: Column) -> Column:
    """Missing-value codes in coordinate columns read as missing."""
    x = x.cast("double")
    return F.when(~x.isin(*[float(s) for s in rules.GPS_SENTINELS]), x)


def _numeric_sql(c: str, dtype: T.DataType) -> dict[str, str]:
    if isinstance(dtype, INTEGRALS):
        hi = f"greatest(abs(cast(max({c}) AS decimal(20,0))), abs(cast(min({c}) AS decimal(20,0))))"
        return {"n_nonnull": f"count({c})", "max_abs": hi, "max_text": hi,
                "has_frac": "false", "gps_precise": "false"}
    x = c if isinstance(dtype, T.DecimalType) else f"(CASE WHEN NOT isnan({c}) THEN double({c}) END)"
    d = f"double({x})"
    codes = ", ".join(f"{c}D" for c in sorted({abs(c) for c in rules.GPS_SENTINELS}))
    g = f"(CASE WHEN abs({d}) NOT IN ({codes}) THEN {d} END)"
    scale = float(10 ** rules.GPS_KEPT_DECIMALS)
    # infinity less itself is NaN, which differs from 0 and so counts as a fraction
    fraction = f"{x} % 1" if isinstance(dtype, T.DecimalType) else f"({d} - rint({d}))"
    return {
        "n_nonnull": f"count({x})",
        "max_abs": f"max(abs({x}))",
        "max_text": f"max(abs({x}))" if isinstance(dtype, T.DecimalType) else "null",
        "has_frac": f"coalesce(bool_or({fraction} <> 0), false)",
        "gps_max": f"max(abs({g}))",
        # below GPS_MAX_ABS this is exact: only the double nearest to a short decimal comes back unchanged
        "gps_precise": f"coalesce(bool_or(rint({g} * {scale}D) / {scale}D <> {g}), false)",
    }


def _string_sql(c: str) -> dict[str, str]:
    # a text shorter than a pattern's least match needs no regex
    shaped = f"octet_length({c}) >= 7 AND {c} RLIKE r'{rules.IP_SHAPE}'"
    valid = f"{shaped} AND {c} RLIKE r'{rules.IP_VALID}'"
    return {
        "n_nonnull": f"count({c})",
        "max_len": f"max(char_length({c}))",
        "sum_len": f"sum(char_length({c}))",
        "seen_bits": f"bit_or(CASE WHEN {c} IS NOT NULL"
                     f" THEN shiftleft(1L, cast(pmod(xxhash64({c}), 64) AS int)) END)",
        "prolific_n": f"count_if(octet_length({c}) >= 24 AND {c} RLIKE r'{rules.PROLIFIC_ID}')",
        "mturk_n": f"count_if(octet_length({c}) >= 10 AND {c} RLIKE r'{rules.MTURK_ID}')",
        "ip_loose_n": f"count_if({shaped})",
        "ip_strict_n": f"count_if({valid})",
        "ip_public_n": f"count_if({valid} AND NOT {c} RLIKE r'{rules.IP_PRIVATE}')",
    }


def _column_sql(ref: ColumnRef, dtype: T.DataType) -> str:
    """The profile row of one column, as a struct of aggregates."""
    c = f"c{ref.col_idx}"
    if ref.kind == "numeric":
        parts = _numeric_sql(c, dtype)
    elif ref.kind == "string":
        parts = _string_sql(c)
    else:
        parts = {"n_nonnull": f"count({c})"}
    parts |= {"col_id": str(ref.col_id), "n_rows": "count(1)"}
    fields = [f"'{f.name}', cast({parts.get(f.name, 'null')} AS {f.dataType.simpleString()})"
              for f in PROFILE_SCHEMA.fields]
    return f"named_struct({', '.join(fields)})"


def profile_table(table: Table, refs: list[ColumnRef], columns_per_pass: int = 30) -> DataFrame:
    """One row per column. Wide tables take several narrow scans, so that the
    generated aggregation code stays within the JVM's method limit. Text patterns are heavy
    work, so a small table is dealt out to all cores: its file may be one split."""
    fields = table.df.schema.fields
    passes = []
    for start in range(0, len(refs), columns_per_pass):
        part = refs[start:start + columns_per_pass]
        structs = ", ".join(_column_sql(r, fields[r.col_idx].dataType) for r in part)
        heavy = any(r.kind == "string" for r in part) and table.estimated_bytes <= MAX_DEALT_BYTES
        wide = table.cells((r.col_idx for r in part), heavy).agg(F.expr(f"array({structs})").alias("cols"))
        passes.append(wide.select(F.inline("cols")))
    return reduce(DataFrame.unionByName, passes)


def profile_tables(tables: list[Table], columns_per_pass: int = 30) -> DataFrame:
    """Profiles of all columns of all tables as one job, keyed by col_id."""
    refs = catalog(tables)
    parts = []
    for table_id, table in enumerate(tables):
        own = [r for r in refs if r.table_id == table_id]
        if own:
            parts.append(profile_table(table, own, columns_per_pass))
    return reduce(DataFrame.unionByName, parts)


def catalog_rows(tables: list[Table]) -> list[tuple]:
    rows = []
    for r in catalog(tables):
        t = tables[r.table_id]
        rows.append((r.col_id, r.table_id, t.dataset_id, t.file, t.sheet or rules.NO_SHEET,
                     r.col_idx, r.col_name, r.label, r.kind, r.spark_type))
    return rows


def column_catalog(spark: SparkSession, tables: list[Table]) -> DataFrame:
    """The column catalog as a relation: one row per column, schema-sized."""
    return local_relation(spark, catalog_rows(tables), COLUMN_SCHEMA)


def profile_rows(tables: list[Table]) -> list[list[tuple]]:
    """The profile of each table's columns, without their ids, from one job over all tables."""
    refs = catalog(tables)
    found = {r.col_id: tuple(r)[1:] for r in profile_tables(tables).collect()} if refs else {}
    out: list[list[tuple]] = [[] for _ in tables]
    for r in refs:
        out[r.table_id].append(found[r.col_id])
    return out


def profile_some(table: Table, idxs: list[int]) -> list[tuple]:
    """The profile of some columns of a table, without their ids; no other column is read."""
    refs = [r for r in catalog([table]) if r.col_idx in set(idxs)]
    found = {r.col_id: tuple(r)[1:] for r in profile_table(table, refs).collect()}
    return [found[i] for i in idxs]


def profiled_columns(spark: SparkSession, tables: list[Table], rows: list[list[tuple | None]] | None = None) -> DataFrame:
    """Run the profile once (or take its rows) and keep catalog and profile as a local relation.

    It has one row per column, like the schemas the driver already holds, and
    later steps choose from it which columns to read at all. Columns whose profile
    is None could not be read and are left out.
    """
    profiles = [p for own in (profile_rows(tables) if rows is None else rows) for p in own]
    schema = T.StructType(COLUMN_SCHEMA.fields + PROFILE_SCHEMA.fields[1:])
    known = [r + p for r, p in zip(catalog_rows(tables), profiles) if p is not None]
    return with_precheck(local_relation(spark, known, schema))


def with_precheck(profile: DataFrame) -> DataFrame:
    """Whether a column could be a coordinate: small enough and precise enough."""
    return profile.withColumn("gps_precheck", F.coalesce(
        (F.col("gps_max") <= rules.GPS_MAX_ABS) & F.col("gps_precise"), F.lit(False)))


def merge_profiles(parts: DataFrame) -> DataFrame:
    """Profiles of separate batches of the same columns as one profile per column."""
    total = ("n_rows", "n_nonnull", "sum_len", "prolific_n", "mturk_n", "ip_loose_n", "ip_strict_n", "ip_public_n")
    merged = {c: F.sum(c) for c in total}
    merged |= {c: F.max(c) for c in ("max_abs", "max_len", "gps_max")}
    merged |= {c: F.bool_or(c) for c in ("has_frac", "gps_precise")}
    merged |= {"max_text": F.max_by("max_text", "max_abs"), "seen_bits": F.bit_or("seen_bits")}
    return parts.groupBy("col_id").agg(*[
        merged[f.name].cast(f.dataType).alias(f.name) for f in PROFILE_SCHEMA.fields if f.name != "col_id"])
