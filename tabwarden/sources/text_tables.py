"""Delimited text: dialect and encoding checks over many files, typed loading."""

from __future__ import annotations

import csv
import re
from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from .. import rules
from ..plans.bisect import bisected
from ..plans.durable import kept_folder, kept_table
from ..plans.local import local_relation
from .tables import Table


def bare_path(uri: Column) -> Column:
    """A file's path without scheme or escapes."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:/+", "/")


def file_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, in_head, line_no, line); path is bare, without scheme or escapes, and
    in_head marks the first block of a file, the only one whose line order is known."""
    return spark.read.text(files).select(
        bare_path(F.col("_metadata.file_path")).alias("path"),
        (F.col("_metadata.file_block_start") == 0).alias("in_head"),
        F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def line_checks(lines: DataFrame) -> DataFrame:
    """(path, multi_line, encoding) from all lines of each file, in one aggregation.

    A file is multi_line if some line leaves a quoted field open; only such files must be
    read whole by one task. UTF-16 is told by its byte-order mark, windows-1252 by some line
    that is no valid UTF-8.
    """
    mark = F.hex(F.substring(F.col("line").cast("binary"), 1, 2)).isin("FFFE", "FEFF")
    return lines.groupBy("path").agg(
        F.bool_or(_occurrences(F.col("line"), '"') % 2 == 1).alias("multi_line"),
        F.when(F.bool_or(mark & F.col("in_head") & (F.col("line_no") % (1 << 33) == 0)), "UTF-16")
        .when(F.bool_and(F.is_valid_utf8("line")), "UTF-8").otherwise("windows-1252").alias("encoding"))


def head_lines(lines: DataFrame) -> DataFrame:
    """The first non-blank lines per path, trimmed inside each task before the shuffle."""
    order = Window.partitionBy("path").orderBy("line_no")
    return (lines.filter(F.length(F.regexp_replace("line", rf"[{rules.WS}]+", "")) > 0)
            .withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= rules.SNIFF_LINES))


def _occurrences(line: Column, mark: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))


def detect_delimiters(lines: DataFrame) -> DataFrame:
    """(path, delimiter): null where the first lines do not look like a table.

    A delimiter qualifies if every head line holds it equally often and at all;
    the most frequent one wins, ties go by the order tab, comma, semicolon, bar.
    """
    heads = head_lines(lines)
    per_mark = []
    for i, mark in enumerate(rules.SNIFF_DELIMITERS):
        n = _occurrences(F.col("line"), mark)
        per_mark += [F.min(n).alias(f"lo{i}"), F.max(n).alias(f"hi{i}")]
    stats = heads.groupBy("path").agg(*per_mark)
    votes = F.array(*[
        F.when((F.col(f"lo{i}") == F.col(f"hi{i}")) & (F.col(f"lo{i}") > 0),
               F.struct(F.col(f"lo{i}").alias("n"), F.lit(-i).alias("first"), F.lit(mark).alias("mark")))
        for i, mark in enumerate(rules.SNIFF_DELIMITERS)])
    best = F.array_max(F.filter(votes, lambda v: v.isNotNull()))
    return stats.select("path", best["mark"].alias("delimiter"))


def detect_csv_delimiters(lines: DataFrame) -> DataFrame:
    """(path, delimiter): the most consistent mark outside quoted fields, null where none occurs.

    Of the marks, the one wins whose commonest count per head line (above 0) covers the
    most lines; then the larger count, then the order tab, comma, semicolon, bar.
    """
    bare = F.regexp_replace(F.col("line"), r'"(?:[^"]|"")*("|$)|\x00', "")
    marks = F.array(*[F.struct(F.lit(-i).alias("first"), F.lit(m).alias("mark"), _occurrences(bare, m).alias("n"))
                      for i, m in enumerate(rules.SNIFF_DELIMITERS)])
    counted = head_lines(lines).select("path", F.inline(marks)).filter("n > 0")
    agreed = counted.groupBy("path", "first", "mark", "n").agg(F.count(F.lit(1)).alias("n_lines"))
    best = agreed.groupBy("path").agg(F.max(F.struct("n_lines", "n", "first", "mark")).alias("best"))
    return best.select("path", F.col("best.mark").alias("delimiter"))


def invalid_utf8(contents: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, is_utf8): whether the bytes read as UTF-8 throughout."""
    return contents.select(key, F.is_valid_utf8(F.col(content).cast("string")).alias("is_utf8"))


# What bytes 0x80 to 0x9f mean in windows-1252, where they mean anything.
C1_BYTES = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
C1_LATIN = "".join(chr(b) for b in C1_BYTES)
C1_WINDOWS = bytes(C1_BYTES).decode("cp1252")


def from_latin(text: Column) -> Column:
    """Text that was decoded as ISO-8859-1, as windows-1252."""
    return F.translate(text, C1_LATIN, C1_WINDOWS)


def null_missing(df: DataFrame) -> DataFrame:
    """Missing-value markers of text files read as missing, before types are decided."""
    return df.select(*[
        F.when(~F.col(f"`{c}`").isin(*rules.MISSING_TOKENS), F.col(f"`{c}`")).alias(c) for c in df.columns])


def type_checks(n_columns: int) -> list[Column]:
    """What decides the types of text columns c0, c1, ...: a handful of counts per column."""
    checks = [F.count(F.lit(1)).alias("n")]
    for i in range(n_columns):
        c = F.col(f"c{i}")
        trimmed = F.trim(c)
        checks += [
            F.count(c).alias(f"n{i}"),
            F.count_if(c.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{i}"),
            F.count_if(trimmed.rlike(r"^[+-]?[0-9]+$") & trimmed.try_cast("bigint").isNotNull()).alias(f"i{i}"),
            F.count_if(trimmed.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity)$")
                       ).alias(f"d{i}"),
        ]
    return checks


def kinds_of(seen: Row, n_columns: int) -> list[str]:
    """The narrowest type that fits every value, by the counts of type_checks."""
    kinds = []
    for i in range(n_columns):
        n = seen[f"n{i}"]
        kinds.append("boolean" if n and seen[f"b{i}"] == n == seen["n"] else "bigint" if n and seen[f"i{i}"] == n
                     else "double" if seen[f"d{i}"] == n else "string")
    return kinds


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns cast to the narrowest of boolean, bigint, double that fits every value.

    One aggregation over the table; columns with no value at all become double,
    a boolean column must have no missing values. Nothing is read as a date.
    """
    n_columns = len(df.columns)
    seen = df.toDF(*[f"c{i}" for i in range(n_columns)]).agg(*type_checks(n_columns)).first()
    return typed(df, kinds_of(seen, n_columns))


def typed(df: DataFrame, kinds: list[str]) -> DataFrame:
    """Text columns read as the given types."""
    cells = df.toDF(*[f"c{i}" for i in range(len(kinds))])
    out = []
    for i, (name, kind) in enumerate(zip(df.columns, kinds)):
        c = F.col(f"c{i}")
        read = {"boolean": F.lower(c) == "true", "string": c}.get(kind)
        out.append((F.trim(c).try_cast(kind) if read is None else read).alias(name))
    return cells.select(*out)


def read_text_rows(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8",
                   multi_line: bool = False) -> DataFrame:
    """All rows of a delimited file as text, with too_long: whether a line has more fields than the header.

    Lines with fewer fields are padded.
    """
    latin = encoding.lower() == "windows-1252"
    reader = (spark.read.option("header", True).option("sep", delimiter)
              .option("quote", '"').option("escape", '"').option("multiLine", multi_line or encoding == "UTF-16")
              .option("mode", "PERMISSIVE").option("columnPruning", False).option("inferSchema", False)
              .option("encoding", "ISO-8859-1" if latin else encoding))
    names = reader.csv(path).columns
    whole = "whole_line"
    while whole in names:
        whole += "_"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, whole]])
    df = reader.option("columnNameOfCorruptRecord", whole).schema(schema).csv(path)
    bare = F.regexp_replace(F.col(whole), r'"(?:[^"]|"")*"', "")
    # Spark refuses to read the whole line alone, so a first cell is looked at with it.
    read = F.coalesce(F.length(F.col(f"`{names[0]}`")), F.lit(0)) >= 0
    too_long = F.col(whole).isNotNull() & (_occurrences(bare, delimiter) >= len(names)) & read
    cells = [F.col(f"`{c}`") for c in names]
    if latin:
        cells = [from_latin(c) for c in cells]
    return df.select(*[c.alias(n) for c, n in zip(cells, names)], too_long.alias("too_long"))


def load_delimited(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8",
                   multi_line: bool = False, **table_args) -> tuple[Table, int]:
    """A delimited file as a typed table, kept as Parquet in the shared folder, and how many lines were too long.

    The text is parsed twice, for the types and for the copy; lines with more fields
    than the header are left out and counted on the way.
    """
    rows = read_text_rows(spark, path, delimiter, encoding, multi_line)
    short = rows.filter(~F.col("too_long")).select(rows.columns[:-1])
    types = infer_types(null_missing(short)).dtypes
    counted = Observation()
    seen = rows.observe(counted, F.count_if(F.col("too_long")).alias("too_long"))
    fit = null_missing(seen.filter(~F.col("too_long")).select(rows.columns[:-1]))
    copy = kept_table(typed(fit, [t for _, t in types]))
    table_args.setdefault("file", path)
    return Table(copy, **table_args), int(counted.get["too_long"])


@dataclass(frozen=True)
class TextFile:
    """A delimited file and how it is to be read."""

    path: str
    delimiter: str
    encoding: str
    multi_line: bool
    names: tuple[str, ...]


def first_lines(lines: DataFrame) -> DataFrame:
    """(path, header, latin_header): the first line of each file that is not blank, read as UTF-8 and as windows-1252."""
    shown = lines.filter(F.col("in_head") & (F.length(F.trim("line")) > 0))
    first = shown.groupBy("path").agg(F.min_by("line", "line_no").alias("header"))
    return first.withColumn("latin_header", from_latin(F.decode(F.col("header").cast("binary"), "ISO-8859-1")))


def header_names(line: str, delimiter: str) -> tuple[str, ...] | None:
    """Column names as Spark's reader gives them; None for a header that goes on in the next line.

    A name that is empty becomes _c and its place; names that repeat, whatever their
    case, get their place behind them.
    """
    if line.count('"') % 2:
        return None
    cells = next(csv.reader([line], delimiter=delimiter))
    repeated = {n for n, k in Counter(c.lower() for c in cells).items() if k > 1}
    return tuple(f"_c{i}" if not c else f"{c}{i}" if c.lower() in repeated else c for i, c in enumerate(cells))


def load_many(spark: SparkSession, files: Sequence[TextFile]
              ) -> tuple[dict[str, tuple[DataFrame, int]], list[tuple[TextFile, Exception]]]:
    """Typed copies of many files, and how many lines of each were too long; files that failed, with their errors.

    Files that are read alike and have about as many columns (up to the same power of two) share
    their jobs: one aggregation that decides types per file and one copy, however many
    files there are. A file that fails is found by halving its group.
    """
    groups: dict[tuple, list[TextFile]] = defaultdict(list)
    for f in files:
        groups[f.delimiter, f.encoding, f.multi_line, (len(f.names) - 1).bit_length()].append(f)
    tables: dict[str, tuple[DataFrame, int]] = {}
    failed: list[tuple[TextFile, Exception]] = []
    for group in groups.values():
        done, bad = bisected(group, lambda part: _load_alike(spark, part))
        failed += bad
        for _, found in done:
            tables.update(found)
    return tables, failed


def _load_alike(spark: SparkSession, files: Sequence[TextFile]) -> dict[str, tuple[DataFrame, int]]:
    one, width = files[0], max(len(f.names) for f in files)
    latin = one.encoding.lower() == "windows-1252"
    columns = [f"c{i}" for i in range(width)]
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    read = (spark.read.option("header", True).option("sep", one.delimiter).option("quote", '"').option("escape", '"')
            .option("multiLine", one.multi_line).option("mode", "PERMISSIVE").option("columnPruning", False)
            .option("columnNameOfCorruptRecord", "whole_line").option("encoding", "ISO-8859-1" if latin else one.encoding)
            .schema(T.StructType([*text.fields, T.StructField("whole_line", T.StringType())])).csv([f.path for f in files]))
    listed = [(i, re.sub("^[a-z0-9]+:/+", "/", f.path), len(f.names)) for i, f in enumerate(files)]
    known = local_relation(spark, listed, "file_no int, path string, n_names int")    # a row per file
    rows = read.withColumns({"path": bare_path(F.col("_metadata.file_path")),
                             "line_no": F.monotonically_increasing_id()}).join(known, "path")
    bare = F.regexp_replace(F.col("whole_line"), r'"(?:[^"]|"")*"', "")
    # A line with as many fields as the widest header is not reported whole.
    too_long = F.when(F.col("whole_line").isNull(), F.col("n_names") < width).otherwise(
        _occurrences(bare, one.delimiter) >= F.col("n_names")) & (F.coalesce(F.length("c0"), F.lit(0)) >= 0)
    cells = [(from_latin(F.col(c)) if latin else F.col(c)).alias(c) for c in columns]
    rows = rows.select("file_no", "line_no", too_long.alias("too_long"), *cells)
    rows = rows.select("file_no", "line_no", "too_long", *[F.when(~F.col(c).isin(*rules.MISSING_TOKENS), F.col(c)).alias(c) for c in columns])

    path = kept_folder(spark)
    fit = rows.filter(~F.col("too_long")).drop("too_long")
    fit.sortWithinPartitions("file_no", "line_no").write.partitionBy("file_no").parquet(path)    # rows stay in order
    kept = spark.read.schema(f"file_no int, {', '.join(f'{c} string' for c in columns)}").parquet(path) if _has_rows(spark, path) else None
    seen = {} if kept is None else {r.file_no: r for r in kept.groupBy("file_no").agg(*type_checks(width)).collect()}
    lost = {r.file_no: r.n for r in rows.filter("too_long").groupBy("file_no").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = {}
    for i, f in enumerate(files):
        n = len(f.names)
        if i in seen:
            cells = spark.read.schema(text).parquet(f"{path}/file_no={i}").select(*columns[:n])
            kinds = kinds_of(seen[i], n)
        else:
            cells, kinds = local_relation(spark, [], T.StructType(text.fields[:n])), ["double"] * n
        out[f.path] = (typed(cells.toDF(*f.names), kinds), lost.get(i, 0))
    return out


def _has_rows(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return any(s.getPath().getName().startswith("file_no=") for s in found)


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8",
                   max_rows: int | None = None, multi_line: bool = False, **table_args) -> Table:
    """A delimited file as a typed table that reads the file itself. Lines with too many fields are left out."""
    rows = read_text_rows(spark, path, delimiter, encoding, multi_line)
    df = rows.filter(~F.col("too_long")).select(rows.columns[:-1])
    if max_rows is not None:
        df = df.limit(max_rows)
    table_args.setdefault("file", path)
    return Table(infer_types(null_missing(df)), **table_args)
