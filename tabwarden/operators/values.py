"""Long form of table columns, value counts and distinct statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import rules
from ..functions import text
from ..sources.tables import ColumnRef, Table

COUNTS = "col_id int, value string, cnt bigint"


def column_text(table: Table, ref: ColumnRef) -> Column:
    return text.as_text(F.col(f"c{ref.col_idx}"), table.field(ref.col_idx).dataType)


def melt(table: Table, refs: list[ColumnRef]) -> DataFrame:
    """(col_id, value) for every cell of the given columns; missing cells stay null."""
    wide = table.cells((r.col_idx for r in refs), heavy=True).select(*[column_text(table, r).alias(str(r.col_id)) for r in refs])
    long = wide.unpivot([], wide.columns, "col_id", "value")
    return long.select(F.col("col_id").cast("int").alias("col_id"), "value")


def melt_all(tables: list[Table], refs: list[ColumnRef]) -> DataFrame:
    return _each_table(tables, refs, melt)


COLUMNS_PER_MELT = 100


def _each_table(tables, refs, one) -> DataFrame:
    """one(table, columns) for every table; wide tables in several narrow scans."""
    parts = []
    for table_id, table in enumerate(tables):
        own = [r for r in refs if r.table_id == table_id]
        parts += [one(table, own[i:i + COLUMNS_PER_MELT]) for i in range(0, len(own), COLUMNS_PER_MELT)]
    return reduce(DataFrame.unionByName, parts)


def count_type(dtype: T.DataType) -> T.DataType:
    """The type a column is counted in: numbers and times as they are, all else as text."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return T.LongType()
    if isinstance(dtype, (T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return dtype
    return T.StringType()


def melt_typed(tables: list[Table], refs: list[ColumnRef]) -> dict[T.DataType, DataFrame]:
    """(col_id, value) per counting type: fixed-width values are hashed, compared and
    shuffled far cheaper than their text."""
    by_type: dict[T.DataType, list[ColumnRef]] = {}
    for r in refs:
        by_type.setdefault(count_type(tables[r.table_id].field(r.col_idx).dataType), []).append(r)

    def melt_as(dtype: T.DataType):
        def one(table: Table, own: list[ColumnRef]) -> DataFrame:
            def cell(r: ColumnRef) -> Column:
                c = F.col(f"c{r.col_idx}")
                if isinstance(dtype, T.DoubleType):
                    c = F.when(~F.isnan(c), c)
                return c.cast(dtype).alias(str(r.col_id))

            wide = table.cells((r.col_idx for r in own), heavy=True).select(*[cell(r) for r in own])
            long = wide.unpivot([], wide.columns, "col_id", "value")
            return long.select(F.col("col_id").cast("int").alias("col_id"), "value")
        return one

    return {dtype: melt_all(tables, own) if isinstance(dtype, T.StringType)
            else _each_table(tables, own, melt_as(dtype)) for dtype, own in by_type.items()}


def count_columns(tables: list[Table], refs: list[ColumnRef]) -> DataFrame:
    """Value counts of the given columns, with values as text."""
    parts = [value_counts(long).select("col_id", text.as_text(F.col("value"), dtype).alias("value"), "cnt")
             for dtype, long in melt_typed(tables, refs).items()]
    return reduce(DataFrame.unionByName, parts)


def value_counts(long: DataFrame) -> DataFrame:
    """(col_id, value, cnt) without missing cells.

    Repeats of one value fold together before the shuffle, so a constant column
    or a value held by a third of all rows arrives as one row per task.
    """
    return (long.filter(F.col("value").isNotNull())
            .groupBy("col_id", "value").agg(F.count(F.lit(1)).alias("cnt")))


def distinct_stats(counts: DataFrame) -> DataFrame:
    """Distinct values and the smallest count, per column."""
    return counts.groupBy("col_id").agg(
        F.count(F.lit(1)).alias("n_unique"), F.min("cnt").alias("min_count"))


def needs_distinct_test(p: dict) -> bool:
    """Whether the categorical rule is still open for a profiled text column.

    seen_bits marks one of 64 slots per distinct value, so more set bits than the
    rule's limit prove that the column has too many distinct values to be
    categorical. Only the other columns, which hold few values, are counted.
    """
    bits = bin((p["seen_bits"] or 0) & (2**64 - 1)).count("1")
    return (p["max_len"] or 0) >= rules.SHORT_TEXT_BELOW and bits <= rules.CATEGORY_MAX_DISTINCT
