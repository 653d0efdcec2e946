"""Hard negatives by a multiway hyperplane tree with range tables.

Scores are inner products of whole numbers. With M the largest squared norm and a further
component sqrt(M - |x|^2) for each row (0 for an anchor), |a - x|^2 = |a|^2 + M - 2 score: a
range of scores is an annulus around the anchor, and more than that is not assumed.

The tree. The root has SPLITS split points, taken far apart from a sample of SAMPLE rows; a row
belongs to its nearest one, which cuts the space by hyperplanes. For each split point and
each subtree the root holds the range of distances from that point to the subtree's rows. A
subtree too large for one task is cut into blocks by distance from its own split point, so
copies and hot regions spread. Each block is a tree again, built where it is searched, down to
leaves of LEAF rows, which are compared one by one. From d, an anchor's distance to a split
point, a row of the annulus (near, far) is at least max(d - far, near - d) and at most d + far
away from that point; subtrees whose range misses this are left out, at the root before rows
are shuffled. An anchor looks in its own block first: what it finds there narrows its annuli
for all others. All rows are indexed and results are exact, so recall is 1.

Defined results: rows without an id, label or vector, or with a component that is null or not
finite, take no part. Rows equal in id, label and vector count once; rows that share only their
id are rows of their own but no one's partner under that id. Ties go to the smaller id. Shorter
vectors end in zeros. An anchor without positives, or whose positives have no negatives, gives no
rows; an empty table gives none; further columns are ignored. Scores are exact below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .batches import ship
from .stored import dropped, stored

ship(__name__)

SPLITS = 64         # split points of the root
SAMPLE = 2048       # rows from which they are taken
NODE_SPLITS = 16    # split points of a node within a block
LEAF = 192
BLOCK = 4096        # rows of a block, about
ANCHORS = 1024      # anchors that a task compares with a block, about
MAX_SPLIT_BYTES = 8 << 20
ROW = "id long, label long, vector array<double>, key long, region int, away double"


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of doubles, zeros at the end of short ones."""
    size = vectors.value_lengths().to_numpy().astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim))
    out[np.arange(dim) < size[:, None]] = flat
    return out


class Metric(NamedTuple):
    """dim and M; rows have a further component, anchors have 0 there."""

    dim: int
    most: float

    def height(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))

    def between(self, x: np.ndarray, y: np.ndarray, hx: np.ndarray | float, hy: np.ndarray) -> np.ndarray:
        """Distances of all x from all y; hx is 0 for anchors."""
        hx = np.broadcast_to(hx, len(x))
        squared = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T) + (hx[:, None] - hy) ** 2
        return np.sqrt(np.maximum(squared, 0))

    def radius(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far from anchors x rows of a score are."""
        with np.errstate(invalid="ignore", over="ignore"):
            return np.sqrt(np.maximum((x * x).sum(axis=1) + self.most - 2 * score, 0))

    @property
    def slack(self) -> float:
        """More than rounding can move a distance."""
        return 1e-6 * np.sqrt(self.most) + 1e-9


def far_apart(x: np.ndarray, h: np.ndarray, metric: Metric, most: int) -> np.ndarray:
    """Rows of x, each the farthest from those before it."""
    picked = [0]
    nearest = metric.between(x, x[:1], h, h[:1])[:, 0]
    while len(picked) < most:
        nxt = int(nearest.argmax())
        if nearest[nxt] <= metric.slack:
            break
        picked.append(nxt)
        nearest = np.minimum(nearest, metric.between(x, x[nxt : nxt + 1], h, h[nxt : nxt + 1])[:, 0])
    return np.array(picked)


class Node:
    """A subtree over some rows of a block: a leaf, or split points with range tables."""

    def __init__(self, rows: np.ndarray, x: np.ndarray, h: np.ndarray, metric: Metric):
        self.rows, self.children = rows, []
        if len(rows) <= LEAF:
            return
        pick = rows[far_apart(x[rows[: 4 * NODE_SPLITS]], h[rows[: 4 * NODE_SPLITS]], metric, NODE_SPLITS)]
        away = metric.between(x[rows], x[pick], h[rows], h[pick])
        nearest = away.argmin(axis=1)
        groups = [np.flatnonzero(nearest == j) for j in range(len(pick))]
        groups = [g for g in groups if len(g)]
        if len(groups) < 2:
            return
        self.points, self.heights = x[pick], h[pick]
        self.least = np.array([away[g].min(axis=0) for g in groups])    # [subtree, split point]
        self.most = np.array([away[g].max(axis=0) for g in groups])
        self.children = [Node(rows[g], x, h, metric) for g in groups]


def kept(d: np.ndarray, near: np.ndarray, far: np.ndarray, least: np.ndarray, most: np.ndarray, slack: float) -> np.ndarray:
    """Which annuli meet the rows of a subtree, by its ranges [split point]; d: [anchor, split point]."""
    miss = ((d - far[:, None] > most + slack) | (d + far[:, None] < least - slack) | (near[:, None] - d > most + slack))
    return ~miss.any(axis=1)


class Search:
    """The best k rows in each window of each of some anchors, among the rows of one block."""

    def __init__(self, metric: Metric, k: int, same: bool, x: np.ndarray, ids: np.ndarray, labels: np.ndarray,
                 q: np.ndarray, q_ids: np.ndarray, q_labels: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.metric, self.k, self.same = metric, k, same
        self.x, self.ids, self.labels = x, ids, labels
        self.q, self.q_ids, self.q_labels = q, q_ids, q_labels
        self.lo, self.hi = lo.copy(), hi        # [anchor, window]; lo rises as rows are found
        self.near = metric.radius(q, hi.max(axis=1))
        none = np.zeros(0, np.int64)
        self.found = (none, none, np.zeros(0), none)    # anchor, window, score, row

    def run(self) -> None:
        h = self.metric.height(self.x)
        self.visit(Node(np.arange(len(self.x)), self.x, h, self.metric), np.arange(len(self.q)))

    def visit(self, node: Node, anchors: np.ndarray) -> None:
        if not len(anchors):
            return
        if not node.children:
            for at in range(0, len(node.rows), LEAF):
                self.compare(node.rows[at : at + LEAF], anchors)
            return
        d = self.metric.between(self.q[anchors], node.points, 0.0, node.heights)
        for child, least, most in zip(node.children, node.least, node.most):
            far = self.metric.radius(self.q[anchors], self.lo[anchors].min(axis=1))
            self.visit(child, anchors[kept(d, self.near[anchors], far, least, most, self.metric.slack)])

    def compare(self, rows: np.ndarray, anchors: np.ndarray) -> None:
        score = self.q[anchors] @ self.x[rows].T
        partner = (self.labels[rows] == self.q_labels[anchors][:, None]) == self.same
        partner &= self.ids[rows] != self.q_ids[anchors][:, None]
        new = []
        for w in range(self.lo.shape[1]):
            lo, hi = self.lo[anchors, w][:, None], self.hi[anchors, w][:, None]
            a, r = np.nonzero(partner & (score >= lo) & (score <= hi))
            new.append((anchors[a], np.full(len(a), w), score[a, r], rows[r]))
        found = [np.concatenate(c) for c in zip(self.found, *new)]
        if len(found[0]) == len(self.found[0]):
            return
        a, w, s, r = found
        order = np.lexsort((self.ids[r], -s, w, a))
        a, w, s, r = a[order], w[order], s[order], r[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
        begin = np.flatnonzero(first)
        place = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a))))
        stay = place < self.k
        full = place == self.k - 1
        self.lo[a[full], w[full]] = np.maximum(self.lo[a[full], w[full]], s[full])
        self.found = (a[stay], w[stay], s[stay], r[stay])


def _searched(metric: Metric, k: int, same: bool):
    def run(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return FOUND.empty_table()
        lows, highs = asked.column("lo").combine_chunks(), asked.column("hi").combine_chunks()
        width = int(lows.value_lengths().to_numpy().max())
        size = lows.value_lengths().to_numpy()
        lo, hi = np.full((asked.num_rows, width), np.inf), np.full((asked.num_rows, width), -np.inf)
        inside = np.arange(width) < size[:, None]
        lo[inside], hi[inside] = lows.flatten().to_numpy(), highs.flatten().to_numpy()
        search = Search(metric, k, same, matrix(held.column("vector").combine_chunks(), metric.dim),
                        held.column("id").to_numpy(), held.column("label").to_numpy(),
                        matrix(asked.column("vector").combine_chunks(), metric.dim),
                        asked.column("id").to_numpy(), asked.column("label").to_numpy(), lo, hi)
        search.run()
        a, w, s, r = search.found
        whole = np.clip(s, -9.2e18, 9.2e18).astype(np.int64)
        return pa.Table.from_arrays([pa.array(asked.column("key").to_numpy()[a]), pa.array(w.astype(np.int32)),
                                     pa.array(whole), pa.array(held.column("id").to_numpy()[r])], schema=FOUND)
    return run


FOUND = pa.schema([("key", pa.int64()), ("w", pa.int32()), ("score", pa.int64()), ("found", pa.int64())])


def _placed(metric: Metric, points: np.ndarray, heights: np.ndarray):
    """Each row's subtree and its distance from that split point."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("vector"), metric.dim)
            away = metric.between(x, points, metric.height(x), heights)
            region = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(region.astype(np.int32)), pa.array(away[np.arange(len(x)), region])],
                [*batch.schema.names, "region", "away"])
    return run


def _ranges(metric: Metric, points: np.ndarray, heights: np.ndarray):
    """Least and largest distance from each split point to the rows of each subtree, by batch."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, region = matrix(batch.column("vector"), metric.dim), batch.column("region").to_numpy()
            away = metric.between(x, points, metric.height(x), heights)
            own = np.unique(region)
            least = np.concatenate([away[region == r].min(axis=0) for r in own])
            most = np.concatenate([away[region == r].max(axis=0) for r in own])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(own, len(points)).astype(np.int32)),
                 pa.array(np.tile(np.arange(len(points)), len(own)).astype(np.int32)), pa.array(least), pa.array(most)],
                ["region", "point", "least", "most"])
    return run


def _open_regions(metric: Metric, points: np.ndarray, heights: np.ndarray, least: np.ndarray, most: np.ndarray):
    """The subtrees that an anchor's annuli meet, with its distance from their split points."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = matrix(batch.column("vector"), metric.dim)
            d = metric.between(q, points, 0.0, heights)
            near = metric.radius(q, batch.column("top").to_numpy())
            far = metric.radius(q, batch.column("low").to_numpy())
            open_ = np.stack([kept(d, near, far, least[r], most[r], metric.slack) for r in range(len(points))], axis=1)
            a, r = np.nonzero(open_)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(a)), pa.array(r.astype(np.int32)), pa.array(d[a, r]),
                 pa.array(near[a]), pa.array(far[a])], ["key", "region", "d", "near", "far"])
    return run


class Tree:
    """All rows of a table, indexed: key, id, label, vector, region, away, block."""

    def __init__(self, rows: DataFrame, block: int = BLOCK, splits: int = SPLITS):
        self.spark = rows.sparkSession
        base = stored(rows.dropDuplicates(["id", "label", "vector"]).withColumn("key", F.monotonically_increasing_id()), "vectors")
        norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
        facts = base.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"), F.max(norm).alias("most")).first()
        self.empty = not facts.n
        if self.empty:
            dropped(base)
            return
        self.metric = Metric(max(facts.dim, 1), facts.most)
        taken = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()
        sample = matrix(taken.column("vector").combine_chunks(), self.metric.dim)
        heights = self.metric.height(sample)
        splits = max(2, min(splits, MAX_SPLIT_BYTES // (8 * self.metric.dim)))
        pick = far_apart(sample, heights, self.metric, splits)
        self.points, self.heights = sample[pick], heights[pick]
        placed = base.mapInArrow(_placed(self.metric, self.points, self.heights), ROW)
        parts = -(-facts.n // block)
        cut = placed.repartitionByRange(parts, "region", "away", "key")
        self.rows = stored(cut.withColumn("block", F.spark_partition_id().cast("long") * len(pick) + F.col("region")), "blocks")
        self.blocks = stored(self.rows.groupBy("region", "block").agg(F.min("away").alias("least"), F.max("away").alias("most")), "shells")
        ranges = (self.rows.mapInArrow(_ranges(self.metric, self.points, self.heights), "region int, point int, least double, most double")
                  .groupBy("region", "point").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect())
        self.least = np.full((len(pick), len(pick)), np.inf)        # a subtree without rows is never met
        self.most = np.full((len(pick), len(pick)), -np.inf)
        for r in ranges:                                            # at most SPLITS * SPLITS of them
            self.least[r.region, r.point], self.most[r.region, r.point] = r.least, r.most
        dropped(base)

    def _in_blocks(self, asked: DataFrame, pairs: DataFrame, k: int, same: bool) -> DataFrame:
        """key, w, score, found: the best k rows of each block for the anchors paired with it."""
        counts = pairs.groupBy("block").agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("parts"))
        dealt = pairs.join(counts, "block").select("key", "block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
        copies = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        left = asked.select("key", "id", "label", "vector", "lo", "hi").join(dealt, "key")
        right = self.rows.select("id", "label", "vector", "block").join(copies, "block")
        by = ["block", "part"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(
            _searched(self.metric, k, same), "key long, w int, score long, found long")

    def best(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """key, w, rank, score, found: the best k rows in each window of each anchor.

        asked: key, id, label, vector, block, and lo, hi (arrays of doubles, a window at each place).
        """
        home = stored(self._in_blocks(asked, asked.select("key", "block"), k, same), "home")
        reached = (home.groupBy("key", "w").agg(F.count("*").alias("m"), F.min("score").alias("s")).filter(F.col("m") >= k)
                   .groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w", F.col("s").cast("double").alias("s")))).alias("known")))
        lo = F.transform("lo", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("known", w), x)))
        tight = stored(asked.withColumnRenamed("block", "own").join(reached, "key", "left").withColumn("lo", lo).drop("known"), "asked")
        opened = (tight.select("key", "vector", F.array_max("hi").alias("top"), F.array_min("lo").alias("low"))
                  .mapInArrow(_open_regions(self.metric, self.points, self.heights, self.least, self.most),
                              "key long, region int, d double, near double, far double"))
        slack = F.lit(float(self.metric.slack))
        met = ((F.col("d") - F.col("far") <= F.col("most") + slack) & (F.col("d") + F.col("far") >= F.col("least") - slack)
               & (F.col("near") - F.col("d") <= F.col("most") + slack))
        pairs = opened.join(self.blocks, "region").filter(met).select("key", "block")
        pairs = stored(pairs.join(tight.select("key", F.col("own").alias("block")), ["key", "block"], "left_anti"), "pairs")
        rest = self._in_blocks(tight, pairs, k, same)
        order = Window.partitionBy("key", "w").orderBy(F.desc("score"), "found")
        out = stored(home.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
        dropped(home, tight, pairs)
        return out

    def close(self) -> None:
        dropped(self.rows, self.blocks)


NEGATIVES = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def finite(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   block: int = BLOCK, splits: int = SPLITS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: id long, label, vector (array of whole doubles); anchor: which of them are anchors. An
    anchor's positives are its best rows of the same label; negatives are the best rows of
    other labels whose score is from `low` to `high` percent of the positive's.
    """
    whole = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
                        F.col("vector").cast("array<double>").alias("vector")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector")))
    tree = Tree(whole, block, splits)
    if tree.empty:
        return rows.sparkSession.createDataFrame([], NEGATIVES)
    anchors = stored(tree.rows.filter(anchor).select("key", "id", "label", "vector", "block"), "anchors")
    everything = {"lo": F.array(F.lit(float("-inf"))), "hi": F.array(F.lit(float("inf")))}
    best = tree.best(anchors.withColumns(everything), positives, True)

    # Whole-number ends of each window; a positive below 0 has none. Equal scores share a window.
    ends = best.filter("score >= 0").select("key", "score").distinct().selectExpr(
        "key", "score", f"CAST((CAST(score AS DECIMAL(20, 0)) * {low} + 99) div 100 AS DOUBLE) AS lo",
        f"CAST(CAST(score AS DECIMAL(20, 0)) * {high} div 100 AS DOUBLE) AS hi").filter("lo <= hi")
    windows = ends.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("score", "lo", "hi"))).alias("ends"))
    asked = stored(anchors.join(windows, "key").withColumns({"lo": F.col("ends.lo"), "hi": F.col("ends.hi")}), "asked")
    found = tree.best(asked.drop("ends"), negatives, False)
    of_window = asked.select("key", F.posexplode("ends.score").alias("w", "positive_score"))
    return (best.select("key", F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
            .join(of_window, ["key", "positive_score"])
            .join(found.select("key", "w", "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score")), ["key", "w"])
            .join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
