"""Screening of a table that keeps arriving.

Each micro-batch leaves only what screening needs of it, in folders named by the
batch. A replayed batch overwrites its folders, so every row counts once. What is
kept of all batches merges exactly; old batches are folded into one base from time
to time.

* profile: one row per column.
* counts: value counts of the text columns, for categories and pattern floors.
* samples: counts by digest with length and pattern flags, of every column that may still
  become a candidate; values of up to LONG characters are kept with them. Longer ones of text
  columns are in the counts already, so those are read for both; texts: longer values of
  nested and binary columns, each once. Which values are shown is decided from the counts alone, so samples are
  those of the whole table; the texts of the few chosen ones are then looked up.
* pairs, points: completeness of neighbouring columns that may still be coordinates, and
  the first rows of each such pair in sample order. The first rows of all are among
  the first of each batch, so a bounded list per batch is enough.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import rules
from ..functions import names
from ..functions.text import strip_controls
from ..operators import coordinates, tabulate
from ..operators.cascade import apply_cascade
from ..operators.patterns import pattern_floors, pattern_stats
from ..operators.profile import column_catalog, merge_profiles, profile_tables, with_precheck
from ..operators.sketches import column_sketches, distinct_estimates, merged_sketches
from ..operators.values import distinct_stats, melt_all, value_counts
from ..plans.local import local_relation
from ..sources.tables import Table, catalog

LONG = tabulate.LONG_TEXT_MEAN      # characters
SAMPLE_KEY = ["col_id", "digest", "len", *rules.PATTERN_KINDS]
PAIR = ["a_id", "b_id"]


class ArrivingTable:
    """Kept state of one arriving table below a folder that all executors share.

    samples, points and sketches are kept only if asked for. row_key names the columns by whose
    digest the rows of a coordinate sample are ordered; without one it is the row's place
    in its file, or else the whole row.
    """

    def __init__(self, spark: SparkSession, folder: str, schema, file: str, labels: dict | None = None,
                 row_key: tuple[str, ...] = (), samples: bool = False, points: bool = False,
                 sketches: bool = False):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.schema = schema
        self.file = file
        self.labels = labels or {}
        self.row_key = row_key
        self.kinds = ["profile", "counts"] + ["samples", "texts"] * samples + ["pairs", "points"] * points + ["sketches"] * sketches

    def _table(self, df: DataFrame) -> Table:
        return Table(df, self.file, labels=self.labels, row_key=self.row_key)

    def _empty(self) -> Table:
        return self._table(self.spark.createDataFrame([], self.schema))

    def _write(self, df: DataFrame, kind: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={batch_id}")

    def add_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Keep what screening needs of one micro-batch; idempotent per batch_id."""
        table = self._table(batch)
        texts = [r for r in catalog([table]) if r.kind == "string"]
        batch.persist()
        try:
            self._write(profile_tables([table]), "profile", batch_id)
            if texts:
                self._write(value_counts(melt_all([table], texts)), "counts", batch_id)
            if "sketches" in self.kinds:
                self._write(column_sketches([table]), "sketches", batch_id)
            if "samples" in self.kinds or "points" in self.kinds:
                own = self._known(self.spark.read.parquet(f"{self.folder}/profile/batch={batch_id}"))
            if "samples" in self.kinds:
                self._keep_samples(table, own, batch_id)
            if "points" in self.kinds:
                self._keep_points(table, own, batch_id)
        finally:
            batch.unpersist()

    def _known(self, profile: DataFrame) -> DataFrame:
        """Catalog and profile as a local relation: a row per column."""
        known = column_catalog(self.spark, [self._empty()]).join(with_precheck(profile), "col_id")
        return local_relation(self.spark, [tuple(r) for r in known.collect()], known.schema)

    def _keep_samples(self, table: Table, profile: DataFrame, batch_id: int) -> None:
        """A column that this batch rules out for good is not counted: booleans, and numbers
        with fractions that are beyond any coordinate, unless their name demands a check."""
        named = names.is_forced_name(F.col("col_name"), F.col("label")) | names.is_platform_name(F.col("col_name"), F.col("label"))
        beyond = F.coalesce(F.col("has_frac"), F.lit(False)) & F.coalesce(F.col("gps_max") > rules.GPS_MAX_ABS, F.lit(False))
        out = {r.col_id for r in profile.filter(~named & ((F.col("kind") == "bool") | beyond)).select("col_id").collect()}
        refs = [r for r in catalog([table]) if r.col_id not in out]
        if not refs:
            return
        parts = []
        if any(r.kind == "string" for r in refs):
            counted = self.spark.read.parquet(f"{self.folder}/counts/batch={batch_id}")
            parts.append(tabulate.counts_by_digest(counted, LONG).select(*SAMPLE_KEY, "cnt", "value"))
        rest = [r for r in refs if r.kind != "string"]
        if rest:
            counts = tabulate.count_candidates([table], rest)
            parts.append(counts.select(*SAMPLE_KEY, "cnt", F.when(F.col("len") <= LONG, F.col("value")).alias("value")))
        self._write(reduce(DataFrame.unionByName, parts), "samples", batch_id)
        nested = [r for r in refs if r.kind == "other"]
        if nested:
            texts = tabulate.clean_counts(melt_all([table], nested)).filter(F.col("len") > LONG)
            self._write(texts.select("col_id", "digest", F.col("value").alias("text")), "texts", batch_id)

    def _keep_points(self, table: Table, profile: DataFrame, batch_id: int) -> None:
        """Pairs are those of this batch's columns that are not too large for a coordinate; whether
        they are precise enough shows in the merged profile."""
        possible = profile.withColumn("gps_precheck", (F.col("kind") == "numeric")
                                      & (F.coalesce(F.col("gps_max"), F.lit(0.0)) <= rules.GPS_MAX_ABS)
                                      & F.col("spark_type").rlike("^(double|float|decimal)"))
        pairs = coordinates.list_pairs(possible)
        if not pairs:
            return
        ids = local_relation(self.spark, [(p.pair_id, p.a_id, p.b_id) for p in pairs], "pair_id int, a_id int, b_id int")
        filled = coordinates.pair_completeness([table], pairs).join(ids, "pair_id").select(*PAIR, "n_either", "n_both")
        self._write(filled, "pairs", batch_id)
        both = {(r.a_id, r.b_id): r.n_both for r in
                self.spark.read.parquet(f"{self.folder}/pairs/batch={batch_id}").filter("n_both > 0").collect()}
        held = [p for p in pairs if (p.a_id, p.b_id) in both]
        if held:
            points = coordinates.sample_points([table], held, {p.pair_id: both[p.a_id, p.b_id] for p in held})
            self._write(points.join(ids, "pair_id").select(*PAIR, "k", "a", "b"), "points", batch_id)
        else:
            self._write(local_relation(self.spark, [], "a_id int, b_id int, k string, a double, b double"), "points", batch_id)

    def _fs(self):
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        return Path, Path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _parts(self, kind: str) -> list[tuple[int, int, str]]:
        """(first, last, folder) of the complete parts in force: the widest base and later batches."""
        Path, fs = self._fs()
        root = f"{self.folder}/{kind}"
        if not fs.exists(Path(root)):
            return []
        bases, batches = [], []
        for s in fs.listStatus(Path(root)):
            name = s.getPath().getName()
            part = f"{root}/{name}"
            if not fs.exists(Path(f"{part}/_SUCCESS")):
                continue
            if name.startswith("base="):
                bases.append((-1, int(name[5:]), part))
            elif name.startswith("batch="):
                batches.append((int(name[6:]), int(name[6:]), part))
        base = max(bases, key=lambda b: b[1], default=None)
        upto = base[1] if base else -1
        return ([base] if base else []) + sorted(b for b in batches if b[0] > upto)

    def _read(self, kind: str) -> DataFrame | None:
        parts = self._parts(kind)
        if not parts:
            return None
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(p) for _, _, p in parts])

    def _merged(self, kind: str) -> DataFrame | None:
        """What all batches together have kept."""
        kept = self._read(kind)
        if kept is None:
            return None
        if kind == "profile":
            return merge_profiles(kept)
        if kind == "counts":
            return kept.groupBy("col_id", "value").agg(F.sum("cnt").alias("cnt"))
        if kind == "sketches":
            return merged_sketches(kept)
        if kind == "samples":
            return kept.groupBy(*SAMPLE_KEY).agg(F.sum("cnt").alias("cnt"), F.max("value").alias("value"))
        if kind == "texts":
            return kept.groupBy("col_id", "digest").agg(F.first("text").alias("text"))
        if kind == "pairs":
            return kept.groupBy(*PAIR).agg(F.sum("n_either").alias("n_either"), F.sum("n_both").alias("n_both"))
        first = Window.partitionBy(*PAIR).orderBy("k", "a", "b")
        return (kept.withColumn("point_id", F.row_number().over(first))
                .filter(F.col("point_id") <= rules.GPS_SAMPLE_ROWS).drop("point_id"))

    def profile(self) -> DataFrame:
        return self._merged("profile")

    def counts(self) -> DataFrame | None:
        return self._merged("counts")

    def columns(self, land: DataFrame | None = None, cells_per_degree: int = 1) -> DataFrame:
        """Cascade over everything that has arrived: the same as over the whole table."""
        known = self._known(self.profile())
        counts = self._read("counts")
        if counts is None:
            stats = self.spark.createDataFrame([], "col_id int, n_unique bigint, min_count bigint")
        else:    # long texts are told apart by digest and stay where they are
            long = F.char_length("value") > LONG
            keyed = counts.select("col_id", "cnt", F.when(~long, F.col("value")).alias("value"),
                                  F.when(long, F.md5("value")).alias("digest"))
            stats = distinct_stats(keyed.groupBy("col_id", "value", "digest").agg(F.sum("cnt").alias("cnt")))
        return apply_cascade(known, stats, None if land is None else self.coordinates(land, cells_per_degree, known))

    def distinct_estimates(self) -> DataFrame:
        """(col_id, n_unique, at_least, at_most) of all columns, from sketches."""
        if "sketches" not in self.kinds:
            raise ValueError("this table keeps no sketches")
        return distinct_estimates(self._merged("sketches"))

    def floors(self) -> DataFrame:
        """Pattern floors of the text columns over everything that has arrived."""
        named = column_catalog(self.spark, [self._empty()]).select("col_id", "col_name", "label")
        return pattern_floors(named.join(pattern_stats(self.counts()), "col_id"))

    def tabulation(self, screened: DataFrame | None = None, seed: str = "0") -> DataFrame:
        """Value samples of the candidate columns, as tabulate_candidates gives them of the whole table.

        screened: columns with is_candidate; those of columns() if left out.
        """
        if "samples" not in self.kinds:
            raise ValueError("this table keeps no samples")
        screened = self.columns() if screened is None else screened
        rows = [(r.col_id, r.n_rows) for r in screened.filter("is_candidate").select("col_id", "n_rows").collect()]
        n_rows = local_relation(self.spark, rows, "col_id int, n_rows bigint")    # a row per column
        kept = self._read("samples")
        if kept is None or not rows:
            return local_relation(self.spark, [], "col_id int, grp string, rank int, digest string, value string, "
                                                  "cnt bigint, pct double, n_unique bigint")
        counts = self._merged("samples").filter(F.col("col_id").isin([i for i, _ in rows]))
        shown = tabulate.tabulate(counts, n_rows, seed)
        texts, counted = self._read("texts"), self._read("counts")
        found = [] if texts is None else [texts.select("col_id", "text", "digest")]
        if counted is not None:
            cleaned = counted.select("col_id", strip_controls(F.col("value")).alias("text"))
            found.append(cleaned.filter(F.char_length("text") > LONG).withColumn("digest", F.md5("text")))
        return tabulate.fill_texts(shown, reduce(DataFrame.unionByName, found)) if found else shown

    def _complete_pairs(self, known: DataFrame) -> tuple[list[coordinates.Pair], dict[int, tuple[int, int]], DataFrame | None]:
        """Pairs whose values mostly come together, (n_either, n_both) by pair_id, and their first points."""
        if "points" not in self.kinds:
            raise ValueError("this table keeps no points")
        pairs = coordinates.list_pairs(known)
        filled = self._merged("pairs")
        if not pairs or filled is None:
            return [], {}, None
        rows = {(r.a_id, r.b_id): (r.n_either, r.n_both) for r in
                filled.filter(coordinates.is_complete(F.col("n_either"), F.col("n_both"))).collect()}
        pairs = [p for p in pairs if (p.a_id, p.b_id) in rows]
        ids = local_relation(self.spark, [(p.pair_id, p.a_id, p.b_id) for p in pairs], "pair_id int, a_id int, b_id int")
        first = Window.partitionBy("pair_id").orderBy("k", "a", "b")
        points = (self._merged("points").join(ids, PAIR).withColumn("point_id", F.row_number().over(first))
                  .select("pair_id", "point_id", "a", "b"))
        return pairs, {p.pair_id: rows[p.a_id, p.b_id] for p in pairs}, points

    def coordinates(self, land: DataFrame, cells_per_degree: int = 1, known: DataFrame | None = None) -> DataFrame:
        """Columns that pair as coordinates, as gps_candidates finds them in the whole table."""
        known = self._known(self.profile()) if known is None else known
        pairs, _, points = self._complete_pairs(known)
        if not pairs:
            return local_relation(self.spark, [], coordinates.CANDIDATES)
        return coordinates.candidates_from_points(self.spark, known, pairs, points, land, cells_per_degree)

    def pair_shares(self, land: DataFrame, cells_per_degree: int = 1) -> DataFrame:
        """(a_idx, b_idx, n_either, n_both, a_is_lat, share, n) of the complete pairs."""
        pairs, filled, points = self._complete_pairs(self._known(self.profile()))
        info = local_relation(self.spark, [(p.pair_id, p.a_idx, p.b_idx, *filled[p.pair_id]) for p in pairs],
                              "pair_id int, a_idx int, b_idx int, n_either bigint, n_both bigint")
        if not pairs:
            return info.select("a_idx", "b_idx", "n_either", "n_both", F.lit(True).alias("a_is_lat"),
                               F.lit(0.0).alias("share"), F.lit(0).cast("bigint").alias("n"))
        return coordinates.land_shares(points, land, cells_per_degree).join(info, "pair_id").drop("pair_id")

    def compact(self) -> None:
        """Fold all complete batches into a new base, then remove what went into it.

        Not while another process reads this state: call it between queries.
        """
        Path, fs = self._fs()
        for kind in self.kinds:
            parts = self._parts(kind)
            if len(parts) < 2:
                continue
            last = parts[-1][1]
            self._merged(kind).write.mode("overwrite").parquet(f"{self.folder}/{kind}/base={last}")
            for _, _, part in parts:
                fs.delete(Path(part), True)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Feed a stream into the state; the checkpoint makes each batch count once."""
        return (stream.writeStream.foreachBatch(self.add_batch)
                .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
