"""Distinct counts by sketches: one small row per column and task, however many values there are.

Opt-in. The rules themselves use exact counts, which they need for few columns only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..sources.tables import ColumnRef, Table, catalog
from .values import column_text

LG_CELLS = 12           # 4096 cells, 4 KB or less a column
ERRORS = 4              # standard errors on either side of a bound
COLUMNS_PER_PASS = 50


def relative_error(lg_cells: int = LG_CELLS) -> float:
    """The standard error of an estimate, as a share of the count."""
    return 1.04 / (1 << lg_cells) ** 0.5


def _value(table: Table, ref: ColumnRef) -> Column:
    """Whole numbers and dates as they are, other values of fixed width as 64-bit hashes, all else as its text."""
    c, dtype = F.col(f"c{ref.col_idx}"), table.field(ref.col_idx).dataType
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("bigint")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dtype, T.DoubleType):  # 0.0 and -0.0 are one value, NaN is none
        return F.when(c == 0, F.xxhash64(F.lit(0.0))).when(~F.isnan(c), F.xxhash64(c))
    if isinstance(dtype, T.DecimalType):
        return F.when(c.isNotNull(), F.xxhash64(c))
    return column_text(table, ref)


def column_sketches(tables: list[Table], refs: list[ColumnRef] | None = None, lg_cells: int = LG_CELLS) -> DataFrame:
    """(col_id, sketch) of each column, in one scan per table; no value is shuffled."""
    refs = catalog(tables) if refs is None else refs
    parts = []
    for table_id, table in enumerate(tables):
        own = [r for r in refs if r.table_id == table_id]
        for at in range(0, len(own), COLUMNS_PER_PASS):
            some = own[at:at + COLUMNS_PER_PASS]
            rows = F.array(*[F.struct(F.lit(r.col_id).alias("col_id"), F.hll_sketch_agg(_value(table, r), lg_cells).alias("sketch"))
                             for r in some])
            parts.append(table.cells(r.col_idx for r in some).agg(rows.alias("rows")).select(F.inline("rows")))
    return reduce(DataFrame.unionByName, parts)


def merged_sketches(parts: DataFrame) -> DataFrame:
    """Sketches of separate batches of the same columns as one for each column."""
    return parts.groupBy("col_id").agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_estimates(sketches: DataFrame, lg_cells: int = LG_CELLS) -> DataFrame:
    """(col_id, n_unique, at_least, at_most): an estimate and its bounds, ERRORS standard errors away."""
    n, margin = F.col("n_unique"), ERRORS * relative_error(lg_cells)
    return sketches.select("col_id", F.hll_sketch_estimate("sketch").alias("n_unique")).select(
        "col_id", "n_unique", F.floor(n / (1 + margin)).cast("bigint").alias("at_least"),
        F.ceil(n / (1 - margin)).cast("bigint").alias("at_most"))
