"""A loaded table and the catalog of its columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, types as T

from ..plans.spread import estimated_bytes, spread


@dataclass(frozen=True)
class Table:
    """One table of a dataset. Columns are addressed by position throughout."""

    df: DataFrame
    file: str
    sheet: str | None = None
    dataset_id: str = ""
    labels: Mapping[str, str] = field(default_factory=dict)
    row_key: tuple[str, ...] = ()
    unread: frozenset[int] = frozenset()    # positions of columns that cannot be read

    def positional(self) -> DataFrame:
        """The table with columns c0, c1, ...: names may repeat or hold any character."""
        return self.df.toDF(*[f"c{i}" for i in range(len(self.df.columns))])

    def cells(self, indexes: Iterable[int], heavy: bool = False) -> DataFrame:
        """Only the given columns, as c<index>; dealt out to all cores if the table is
        small and the work per row is heavy enough to pay for it."""
        chosen = self.positional().select(*[f"c{i}" for i in sorted(set(indexes))])
        return spread(chosen, self.estimated_bytes) if heavy else chosen

    @cached_property
    def estimated_bytes(self) -> int:
        return estimated_bytes(self.df)

    def field(self, idx: int) -> T.StructField:
        return self.df.schema.fields[idx]


@dataclass(frozen=True)
class ColumnRef:
    """Catalog entry of one column; col_id numbers the columns of one run."""

    col_id: int
    table_id: int
    col_idx: int
    col_name: str
    label: str
    kind: str
    spark_type: str


def column_kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return "other"


def column_label(table: Table, f: T.StructField) -> str:
    """Label from the label map, else from the schema metadata, else the column name."""
    return table.labels.get(f.name) or (f.metadata or {}).get("label") or f.name


def catalog(tables: Iterable[Table]) -> list[ColumnRef]:
    refs: list[ColumnRef] = []
    for table_id, table in enumerate(tables):
        for idx, f in enumerate(table.df.schema.fields):
            refs.append(ColumnRef(len(refs), table_id, idx, f.name, column_label(table, f),
                                  column_kind(f.dataType), f.dataType.simpleString()))
    return refs


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", max_rows: int | None = None,
               **table_args) -> Table:
    """A columnar or JSON file as a table; max_rows keeps only that many rows."""
    df = spark.read.format(fmt).load(path)
    if max_rows is not None:
        df = df.limit(max_rows)
    table_args.setdefault("file", path)
    return Table(df, **table_args)
