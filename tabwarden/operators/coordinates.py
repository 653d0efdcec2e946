"""Latitude/longitude pairs among neighbouring columns, tested against a land table.

The land table lists runs of land cells: (lat_idx, lon_start, lon_end), with a
given number of cells per degree; index 0 is 90 south and 180 west.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .. import rules
from ..functions import text
from ..plans.durable import durable
from ..plans.local import local_relation
from ..sources.tables import Table
from .profile import clean_number, drop_sentinels

BLOCK_DEGREES = 5     # longitude blocks of the land join
CANDIDATES = "col_id int, reason string, role string, partner_id int, share double, n bigint"


@dataclass(frozen=True)
class Pair:
    """Two pre-checked columns of one table, a before b."""

    pair_id: int
    table_id: int
    a_id: int
    a_idx: int
    b_id: int
    b_idx: int


def neighbour_pairs(columns: DataFrame) -> DataFrame:
    """Unordered pairs of pre-checked columns at most GPS_WINDOW positions apart.

    An equi-join on the table with one probe per distance: no pair of far-away
    columns is ever formed.
    """
    ok = columns.filter("gps_precheck").select("table_id", "col_id", "col_idx")
    steps = F.explode(F.sequence(F.lit(1), F.lit(rules.GPS_WINDOW)))
    a = ok.select("table_id", F.col("col_id").alias("a_id"), F.col("col_idx").alias("a_idx"),
                  steps.alias("step")).withColumn("b_idx", F.col("a_idx") + F.col("step")).drop("step")
    b = ok.select("table_id", F.col("col_id").alias("b_id"), F.col("col_idx").alias("b_idx"))
    return a.join(b, ["table_id", "b_idx"]).select("table_id", "a_id", "a_idx", "b_id", "b_idx")


def list_pairs(columns: DataFrame) -> list[Pair]:
    """The pairs as driver metadata: at most GPS_WINDOW per column."""
    rows = neighbour_pairs(columns).orderBy("a_id", "b_id").collect()
    return [Pair(i, r.table_id, r.a_id, r.a_idx, r.b_id, r.b_idx) for i, r in enumerate(rows)]


def _pair_values(table: Table, pair: Pair) -> tuple[Column, Column]:
    """Both values with sentinels and (0, 0) rows read as missing."""
    a, b = (drop_sentinels(clean_number(F.col(f"c{i}"), table.field(i).dataType))
            for i in (pair.a_idx, pair.b_idx))
    null_island = F.coalesce((a == 0) & (b == 0), F.lit(False))
    return F.when(~null_island, a), F.when(~null_island, b)


def pair_completeness(tables: list[Table], pairs: list[Pair]) -> DataFrame:
    """(pair_id, n_either, n_both): one scan per table, one row per task shuffled."""
    parts = []
    for table_id, table in enumerate(tables):
        own = [p for p in pairs if p.table_id == table_id]
        if not own:
            continue
        structs = []
        for p in own:
            a, b = _pair_values(table, p)
            structs.append(F.struct(
                F.lit(p.pair_id).alias("pair_id"),
                F.count_if(a.isNotNull() | b.isNotNull()).alias("n_either"),
                F.count_if(a.isNotNull() & b.isNotNull()).alias("n_both")))
        used = [i for p in own for i in (p.a_idx, p.b_idx)]
        parts.append(table.cells(used).agg(F.array(*structs).alias("pairs")).select(F.inline("pairs")))
    return reduce(DataFrame.unionByName, parts)


def is_complete(n_either: Column, n_both: Column) -> Column:
    return (n_both > 0) & (F.try_divide(n_either - n_both, n_either) <= rules.GPS_MAX_ONE_SIDED)


def with_sample_order(table: Table, indexes: list[int]) -> DataFrame:
    """The given columns plus k, a reproducible random order of the rows.

    k is the digest of the row key; without one, of the row's place in its Parquet
    file; for other sources, of the whole row, in which case equal rows stay together.
    """
    rows = table.positional()
    chosen = [f"c{i}" for i in sorted(set(indexes))]
    names = table.df.columns

    def keyed(*parts: Column) -> DataFrame:
        texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
        return rows.select(*chosen, F.md5(F.concat_ws("|", *texts)).alias("k"))

    key = [names.index(k) for k in table.row_key]
    if key and not table.unread.intersection(key):
        return keyed(*[F.col(f"c{i}") for i in key])
    try:
        return keyed(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    except AnalysisException:
        return keyed(F.xxhash64(*[F.col(f"c{i}") for i in range(len(names)) if i not in table.unread]))


def digest_cutoff(n: int, wanted: int) -> str | None:
    """A digest below which about wanted rows of n lie, with a wide margin; None for all rows."""
    expected = wanted + 12 * int(wanted ** 0.5) + 100
    if n <= 8 * expected:
        return None
    return f"{int(expected / n * 2**48):012x}"


def sample_points(tables: list[Table], pairs: list[Pair], n_both: dict[int, int],
                  wanted: int = rules.GPS_SAMPLE_ROWS) -> DataFrame:
    """(pair_id, point_id, a, b, k): the first rows of each pair in sample order k.

    Big tables are cut by digest before anything is sorted. Should the cut have
    left too few rows of a pair, that pair is sampled again from all its rows.
    """
    def sampled(chosen: list[Pair], cut: bool) -> DataFrame:
        parts = []
        for table_id in sorted({p.table_id for p in chosen}):
            table = tables[table_id]
            own = [p for p in chosen if p.table_id == table_id]
            rows = with_sample_order(table, [i for p in own for i in (p.a_idx, p.b_idx)])
            cutoffs = [digest_cutoff(n_both[p.pair_id], wanted) if cut else None for p in own]
            if None not in cutoffs:
                rows = rows.filter(F.col("k") < max(cutoffs))    # before the pairs multiply the rows
            pair_rows = []
            for p in own:
                a, b = _pair_values(table, p)
                pair_rows.append(F.struct(F.lit(p.pair_id).alias("pair_id"), a.alias("a"), b.alias("b")))
            parts.append(rows.select("k", F.inline(F.array(*pair_rows)))
                         .filter("a is not null and b is not null"))
        first = Window.partitionBy("pair_id").orderBy("k", "a", "b")
        return (reduce(DataFrame.unionByName, parts)
                .withColumn("point_id", F.row_number().over(first))
                .filter(F.col("point_id") <= wanted))

    points = sampled(pairs, cut=True)
    if all(digest_cutoff(n_both[p.pair_id], wanted) is None for p in pairs):
        return points
    points = durable(points)
    got = {r.pair_id: r.n for r in points.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    short = [p for p in pairs if got.get(p.pair_id, 0) < min(wanted, n_both[p.pair_id])]
    if not short:
        return points
    kept = points.filter(~F.col("pair_id").isin([p.pair_id for p in short]))
    return kept.unionByName(durable(sampled(short, cut=False)))


def orient(points: DataFrame) -> DataFrame:
    """Each point both ways round: (pair_id, a_is_lat, point_id, lat, lon)."""
    ways = F.array(
        F.struct(F.lit(True).alias("a_is_lat"), F.col("a").alias("lat"), F.col("b").alias("lon")),
        F.struct(F.lit(False).alias("a_is_lat"), F.col("b").alias("lat"), F.col("a").alias("lon")))
    return points.select("pair_id", "point_id", F.inline(ways)).select(
        "pair_id", "a_is_lat", "point_id", "lat", "lon")


def land_shares(points: DataFrame, land: DataFrame, cells_per_degree: int = 1) -> DataFrame:
    """(pair_id, a_is_lat, share, n); orientations with a latitude beyond 90 are dropped.

    A point counts if it or one of eight points around it is on land: an equi-join
    on latitude row and longitude block with a range test inside the block, so that
    no latitude becomes a hot key. Spark broadcasts whichever side it measures as small.
    """
    oriented = orient(points)

    def cell(x: Column, limit: int) -> Column:
        clipped = F.greatest(F.least(x, F.lit(float(limit))), F.lit(float(-limit)))
        idx = F.floor((clipped + limit) * cells_per_degree).cast("int")
        return F.least(idx, F.lit(2 * limit * cells_per_degree - 1))

    def cells_around(x: Column, limit: int) -> Column:
        near = [cell(x + F.lit(d), limit) for d in (-rules.GPS_BUFFER, 0.0, rules.GPS_BUFFER)]
        return F.explode(F.array_distinct(F.array(*near)))    # mostly one and the same cell

    block = BLOCK_DEGREES * cells_per_degree
    around = (oriented.withColumn("y", cells_around(F.col("lat"), 90))
              .withColumn("x", cells_around(F.col("lon"), 180))
              .withColumn("block", F.floor(F.col("x") / block).cast("int")))
    runs = land.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("lon_start") / block).cast("int"), F.floor(F.col("lon_end") / block).cast("int"))))
    on_land = ((around.y == runs.lat_idx) & (around.block == runs.block)
               & around.x.between(runs.lon_start, runs.lon_end))
    judged = (around.join(runs, on_land, "left").groupBy("pair_id", "a_is_lat", "point_id", "lat")
              .agg(F.max(F.col("lat_idx").isNotNull()).alias("hit")))
    counted = F.col("hit") & (F.col("lat") >= rules.GPS_SOUTH_LIMIT)
    ways = judged.groupBy("pair_id", "a_is_lat").agg(
        F.count_if(counted).alias("hits"), F.count(F.lit(1)).alias("n"), F.max(F.abs("lat")).alias("max_lat"))
    return ways.filter("max_lat <= 90").select(
        "pair_id", "a_is_lat", (F.col("hits") / F.col("n")).alias("share"), "n")


def best_orientations(shares: DataFrame) -> DataFrame:
    """The better way round per pair (a as latitude on a tie), if enough points are on land."""
    best = shares.groupBy("pair_id").agg(
        F.max_by(F.struct("share", "n", "a_is_lat"), F.struct("share", "a_is_lat")).alias("best"))
    return best.select("pair_id", "best.*").filter(F.col("share") >= rules.GPS_LAND_SHARE)


def best_partners(pair_rows: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per column of a good pair: its best partner, role and reason.

    pair_rows: (a_id, b_id, share, n, a_is_lat). Ties go to the leftmost partner.
    """
    sides = F.array(
        F.struct(F.col("a_id").alias("col_id"), F.col("b_id").alias("partner_id"),
                 F.col("a_is_lat").alias("is_lat")),
        F.struct(F.col("b_id").alias("col_id"), F.col("a_id").alias("partner_id"),
                 (~F.col("a_is_lat")).alias("is_lat")))
    order = Window.partitionBy("col_id").orderBy(F.desc("share"), "partner_id")
    best = (pair_rows.select("share", "n", F.inline(sides))
            .withColumn("rn", F.row_number().over(order)).filter("rn = 1"))
    partner = columns.select(F.col("col_id").alias("partner_id"), F.col("col_name").alias("partner"))
    role = F.when(F.col("is_lat"), "latitude").otherwise("longitude")
    reason = F.concat(F.lit("read as "), role, F.lit(" next to "), F.col("partner"), F.lit(", "),
                      text.percent(F.col("share")), F.lit(" of "), F.col("n").cast("string"),
                      F.lit(" sampled positions lie on land"))
    return best.join(partner, "partner_id").select(
        "col_id", reason.alias("reason"), role.alias("role"), "partner_id", "share", "n")


def gps_candidates(spark: SparkSession, tables: list[Table], columns: DataFrame, land: DataFrame | None,
                   cells_per_degree: int = 1) -> DataFrame:
    """Columns that pair as coordinates. columns: catalog joined with profiles."""
    nothing = local_relation(spark, [], CANDIDATES)
    if land is None:
        return nothing
    pairs = list_pairs(columns)
    if not pairs:
        return nothing
    both = {r.pair_id: r.n_both for r in pair_completeness(tables, pairs)
            .filter(is_complete(F.col("n_either"), F.col("n_both"))).collect()}
    pairs = [p for p in pairs if p.pair_id in both]
    if not pairs:
        return nothing
    return candidates_from_points(spark, columns, pairs, sample_points(tables, pairs, both), land, cells_per_degree)


def candidates_from_points(spark: SparkSession, columns: DataFrame, pairs: list[Pair], points: DataFrame,
                           land: DataFrame, cells_per_degree: int = 1) -> DataFrame:
    """The columns of pairs whose sampled points lie on land."""
    shares = land_shares(points, land, cells_per_degree)
    shares = local_relation(spark, [tuple(r) for r in shares.collect()], shares.schema)   # two rows per pair
    good = best_orientations(shares)
    ids = local_relation(spark, [(p.pair_id, p.a_id, p.b_id) for p in pairs],
                         "pair_id int, a_id int, b_id int")
    return best_partners(good.join(ids, "pair_id"), columns)
