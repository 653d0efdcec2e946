"""Exact Jaccard self-join of documents over word shingles, in metric space, with recursive Voronoi regions.

A document's set is its distinct shingles of `width` words (ASCII lower case); with fewer
words, the whole sequence is its one shingle; without words the set is empty and linked
with nothing. The Jaccard distance 1 - |x and y| / |x or y| is a metric, and two documents
link when their similarity is at least `percent` / 100.

1. Equal sets become one node.
2. Top regions. Nearly all documents are at distance 1 from any pivot, where no pivot tells
   them apart, so the first cut uses what a link implies. Of each set's shingles, in one
   order for all (rare ones first, by counts in a table of CELLS cells), linked sets share
   one among their first n - ceil(t n) + 1. And the universe is cut into SLICES slices by
   hash, with the empty set as the pivot of each: by the triangle inequality the sizes of
   two sets' parts differ by no more than the parts' symmetric difference, so in sum by no
   more than (1 - t) / (1 + t) (|x| + |y|). Regions are the components of the pairs that
   pass both; of each bucket of nodes with one shingle a spanning forest is kept.
3. In a region, PIVOTS pivots are chosen and all distances to them computed. A node links
   to each pivot within reach. A node goes to the Voronoi region of its nearest pivot, and
   by the triangle inequality to each other region whose pivot is less than twice the
   radius further away: if y is within the radius of x, x is in the region of y's pivot.
   Regions are joined recursively; one whose nodes are all connected is done, and one that
   does not get smaller is joined pivot by pivot, each against the rest in its size ring
   (the same inequality, with the empty set as pivot and the symmetric difference as metric).
4. Regions above REGION_BYTES are cut in the same way by Spark, level by level, after a first
   pass that only counts: one whose children would have more than GROWTH times its rows is
   not cut. There the links to pivots mostly connect nearly all nodes; the nodes outside the
   largest connected part are joined with all others, block by block. So no task holds more
   than two blocks.

Links between nodes that are connected already are not looked for: the result is the
component of each document. Shingles are 64-bit hashes.

Defined results: null and empty texts have 0 shingles and are alone; a component's id is
the least document id in it (null if all are null); repeated rows have a row each, equal
texts are linked; an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from . import batches as B
from .bitmaps import Bitmap, has
from .components import components
from .lines import Forest, _runs, whole_buckets
from .stored import dropped, stored

B.ship(__name__)

CELLS = 1 << 20
CELL_BLOCK = 1 << 12
SLICES = 256
PIVOTS = 8
LEAF = 48
REGION_BYTES = 32 << 20
LEVELS = 6
GROWTH = 1.5


def shingle_sets(texts: B.Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, and where each text's begin (n + 1 places)."""
    n = len(texts.offsets) - 1
    low = B.Texts(B.lowered(texts.data), texts.offsets)
    words = B.words_of(low)
    word = B.span_hashes(low.data, words.start, words.end)
    full = B.window_hashes(word, width)
    inside = words.text[: len(full)] == words.text[width - 1 :] if len(full) else np.zeros(0, bool)
    shingle, text = full[inside], words.text[: len(full)][inside]
    count = np.bincount(words.text, minlength=n)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = (np.cumsum(count) - count)[short]
        total = np.full(len(short), 77, np.uint64)
        for k in range(width - 1):
            has_word = count[short] > k
            total[has_word] = B.mixed(total[has_word] + word[first[has_word] + k] * np.uint64(2 * k + 3))
        shingle, text = np.concatenate([shingle, total]), np.concatenate([text, short])
    order = np.lexsort((shingle, text))
    shingle, text = shingle[order], text[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])
    shingle, text = shingle[new], text[new]
    return shingle, np.searchsorted(text, np.arange(n + 1))


def node_ids(shingle: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for an empty one."""
    running = np.zeros(len(shingle) + 1, np.uint64)
    np.cumsum(B.mixed(shingle + np.uint64(0x51ED270B)), out=running[1:], dtype=np.uint64)
    size = np.diff(at).astype(np.uint64)
    node = B.mixed((running[at[1:]] - running[at[:-1]]) + size)
    return np.where(size > 0, node, np.uint64(0))


SIZES = ["doc", "row_id", "node", "n", "slices", "block", "counts"]


def slice_sizes(shingle: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sets x SLICES: how many shingles of a set are in each slice, 255 for more."""
    n = len(at) - 1
    text = np.repeat(np.arange(n), np.diff(at))
    place = (shingle >> np.uint64(56)).astype(np.int64) * SLICES // 256
    return np.minimum(np.bincount(text * SLICES + place, minlength=n * SLICES), 255).astype(np.uint8).reshape(n, SLICES)


def _sizes(width: int):
    """A row for each document (doc, node, n, slices), and this task's counts of shingles by cell."""
    def run(batches):
        cells = np.zeros(CELLS, np.int64)
        for rows, texts in B.slices(batches, "text"):
            m = rows.num_rows
            shingle, at = shingle_sets(texts, width)
            cells += np.bincount((shingle % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
            parts = B.binary_rows(slice_sizes(shingle, at).ravel(), np.arange(m + 1) * SLICES)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc"), rows.column("row_id"), pa.array(node_ids(shingle, at).view(np.int64)), pa.array(np.diff(at)),
                 parts, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], SIZES)
        if cells.any():
            parts = [x.astype("<u4").tobytes() for x in cells.reshape(-1, CELL_BLOCK)]
            m = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, rows.column("doc").type), *[pa.nulls(m, pa.int64()) for _ in range(3)], pa.nulls(m, pa.binary()),
                 pa.array(np.arange(m, dtype=np.int32)), pa.array(parts, pa.binary())], SIZES)

    return run


def _summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of cell counts over all tasks, a row at a time."""
    total = np.zeros(CELL_BLOCK, np.int64)
    for batch in batches:
        for part in batch.column("counts"):
            total += np.frombuffer(part.as_buffer(), "<u4")
    yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()),
                                      "counts": pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())})


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of its first shingles a set must share one of with each set it links to."""
    return n + (-percent * n) // 100 + 1


def _postings(width: int, percent: int, counts: np.ndarray):
    """A row for each of the first shingles of each set; equal sets of a slice count once."""
    def run(batches):
        for _, texts in B.slices(batches, "text"):
            shingle, at = shingle_sets(texts, width)
            node = node_ids(shingle, at).view(np.int64)
            _, first = np.unique(node, return_index=True)
            first = first[node[first] != 0]
            size = np.diff(at)[first]
            own = B.gathered(shingle, at[first], size)
            which = np.repeat(np.arange(len(first)), size)
            rank = counts[(own % np.uint64(CELLS)).astype(np.int64)]
            order = np.lexsort((own, rank, which))
            inside = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
            head = order[inside < np.repeat(prefix_size(size, percent), size)]
            yield pa.RecordBatch.from_pydict({"key": own[head].view(np.int64), "node": node[first][which[head]]})

    return run


def _met(batches):
    """The nodes of each shingle that several nodes have, under a hash of all of them; rows come sorted.

    Buckets of the same nodes get the same hash, and are one from then on.
    """
    for table in whole_buckets(batches):
        key, node = table.column("key").to_numpy(), table.column("node").to_numpy()
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        head, size = _runs(key)
        running = np.zeros(len(node) + 1, np.uint64)
        np.cumsum(B.mixed(node.view(np.uint64) + np.uint64(9)), out=running[1:], dtype=np.uint64)
        name = B.mixed(running[head + size] - running[head] + size.astype(np.uint64))
        some = size > 1
        _, first = np.unique(name[some], return_index=True)
        head, size, name = head[some][first], size[some][first], name[some][first]
        yield pa.RecordBatch.from_pydict({"key": np.repeat(name, size).view(np.int64), "node": B.gathered(node, head, size)})


def _coarse(percent: int):
    """A spanning forest of the pairs of each bucket whose slices' sizes allow a link."""
    def run(batches):
        for table in whole_buckets(batches):
            node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
            values = B.texts_of(table.column("slices"))
            slices = values.data.reshape(-1, SLICES)
            head, size = _runs(table.column("key").to_numpy())

            def near(i, j):
                apart = np.abs(slices[j].astype(np.int16) - slices[i].astype(np.int16)).sum(-1, dtype=np.int64)
                return (100 + percent) * apart <= (100 - percent) * (n[i] + n[j])

            pairs = head[size == 2]
            pairs = pairs[near(pairs, pairs + 1)] if len(pairs) else pairs
            out = [np.stack([node[pairs], node[pairs + 1]], 1)]
            for s, m in zip(head[size > 2].tolist(), size[size > 2].tolist()):
                forest, found = Forest(m), []
                for i in range(m - 1):
                    for j in (np.flatnonzero(near(s + i, slice(s + i + 1, s + m))) + i + 1).tolist():
                        if forest.join(i, j):
                            found.append((node[s + i], node[s + j]))
                    if len(found) == m - 1:
                        break
                out.append(np.array(found, np.int64).reshape(-1, 2))
            edges = np.concatenate(out)
            yield pa.RecordBatch.from_pydict({"a": edges[:, 0], "b": edges[:, 1]})

    return run


def _sets(width: int, wanted: Bitmap):
    """The sets of the nodes that are in a region with others, one of equal ones a slice."""
    def run(batches):
        opened = wanted.opened()
        for _, texts in B.slices(batches, "text"):
            shingle, at = shingle_sets(texts, width)
            node, first = np.unique(node_ids(shingle, at), return_index=True)
            hit = has(opened, node)
            node, first = node[hit], first[hit]
            size = np.diff(at)[first]
            own = B.gathered(shingle, at[first], size)
            ends = np.concatenate([[0], np.cumsum(size)]) * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(node.view(np.int64)), B.binary_rows(np.ascontiguousarray(own).view(np.uint8), ends)],
                ["node", "shingles"])

    return run


class Region:
    """Sets in a row, over the numbers 0, 1, ... of the shingles they have."""

    def __init__(self, names: np.ndarray, values: B.Texts, percent: int):
        shingle = np.frombuffer(values.data.tobytes(), np.uint64)
        universe, number = np.unique(shingle, return_inverse=True)
        at = values.offsets // 8
        size = np.diff(at)
        order = np.argsort(size, kind="stable")  # by size: a ring around the empty set is a slice
        self.names, self.size = names[order], size[order]
        self.shingle = B.gathered(number.astype(np.int64), at[:-1][order], self.size)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.mark = np.zeros(len(universe), bool)
        self.percent = percent
        self.forest = Forest(len(names))
        self.links: list[tuple[int, int]] = []

    def common(self, pivot: int, members: np.ndarray) -> np.ndarray:
        """Shared shingles of a pivot and each of the members (ascending)."""
        own = self.shingle[self.at[pivot] : self.at[pivot + 1]]
        self.mark[own] = True
        if len(members) and members[-1] - members[0] + 1 == len(members):
            low, high = self.at[members[0]], self.at[members[-1] + 1]
            hits, starts = self.mark[self.shingle[low:high]], self.at[members] - low
        else:
            size = self.size[members]
            hits, starts = self.mark[B.gathered(self.shingle, self.at[members], size)], np.cumsum(size) - size
        self.mark[own] = False
        return np.add.reduceat(hits, starts, dtype=np.int64) if len(members) else np.zeros(0, np.int64)

    def compare(self, pivot: int, members: np.ndarray) -> np.ndarray:
        """Distances to a pivot; links within reach are noted."""
        common = self.common(pivot, members)
        union = self.size[pivot] + self.size[members] - common
        for j in members[100 * common >= self.percent * union].tolist():
            if self.forest.join(pivot, j):
                self.links.append((pivot, j))
        return 1.0 - common / union

    def roots(self, members: np.ndarray) -> int:
        return len({self.forest.root(i) for i in members.tolist()})

    def one_by_one(self, members: np.ndarray) -> None:
        """Each node against those after it that its size lets it link with."""
        for k, pivot in enumerate(members.tolist()):
            rest = members[k + 1 :]
            ring = np.searchsorted(self.size[rest], self.size[pivot] * 100 // self.percent, "right")
            if ring:
                self.compare(pivot, rest[:ring])
            if k % 256 == 255 and self.roots(members[k + 1 :]) <= 1 and self.roots(members) <= 1:
                return

    def join(self, members: np.ndarray) -> None:
        """All links among the members, but for those between connected ones."""
        if len(members) <= 1 or self.roots(members) <= 1:
            return
        if len(members) <= LEAF:
            self.one_by_one(members)
            return
        pivots = members[np.argsort(B.mixed(self.names[members].view(np.uint64)), kind="stable")[:PIVOTS]]
        distance = np.stack([self.compare(p, members) for p in np.sort(pivots).tolist()], 1)
        reach = 2 * (1 - self.percent / 100) + 1e-9
        rest = ~np.isin(members, pivots)
        members, distance = members[rest], distance[rest]
        if self.roots(members) <= 1:
            return
        home = distance.min(1)
        for j in range(distance.shape[1]):
            inside = members[distance[:, j] <= home + reach]
            if len(inside) > 0.8 * len(members):
                self.one_by_one(members)  # the windows cover the region: pivots do not cut it
                return
        for j in range(distance.shape[1]):
            self.join(members[distance[:, j] <= home + reach])

    def found(self) -> pa.RecordBatch:
        a, b = (np.array([self.names[x[k]] for x in self.links], np.int64) for k in (0, 1))
        return pa.RecordBatch.from_pydict({"a": a, "b": b})


def _values(table: pa.Table) -> B.Texts:
    return B.texts_of(table.column("shingles").combine_chunks() if isinstance(table, pa.Table) else table.column("shingles"))


def _join_region(percent: int):
    def run(table: pa.Table) -> pa.Table:
        region = Region(table.column("node").to_numpy(), _values(table), percent)
        region.join(np.arange(table.num_rows))
        return pa.Table.from_batches([region.found()])

    return run


def _to_pivots(nodes: pa.Table, pivots: pa.Table, percent: int) -> tuple[Region, np.ndarray, np.ndarray]:
    """The region of a chunk with the links to the pivots of the whole one; rows and pivots whose regions they are in."""
    both = pa.concat_tables([pivots.select(["node", "shingles"]), nodes.select(["node", "shingles"])])
    region = Region(both.column("node").to_numpy(), _values(both), percent)
    by_name = {int(x): i for i, x in enumerate(region.names)}
    members = np.array([by_name[int(x)] for x in nodes.column("node").to_numpy()])
    order = np.argsort(members)
    distance = np.empty((nodes.num_rows, pivots.num_rows))
    for j, pivot in enumerate(pivots.column("node").to_numpy().tolist()):
        distance[order, j] = region.compare(by_name[pivot], members[order])
    home = distance.min(1, keepdims=True)
    return region, *np.nonzero(distance <= home + 2 * (1 - percent / 100) + 1e-9)


def _weigh_region(percent: int):
    """Links to pivots, and how many rows a chunk has and would have in the regions of the pivots."""
    def run(nodes: pa.Table, pivots: pa.Table) -> pa.Table:
        region, row, _ = _to_pivots(nodes, pivots, percent)
        links = region.found()
        m = links.num_rows
        return pa.table({
            "region": pa.concat_arrays([nodes.column("region").combine_chunks()[:1], pa.nulls(m, pa.int64())]),
            "rows": pa.concat_arrays([pa.array([nodes.num_rows]), pa.nulls(m, pa.int64())]),
            "copies": pa.concat_arrays([pa.array([len(row)]), pa.nulls(m, pa.int64())]),
            "a": pa.concat_arrays([pa.nulls(1, pa.int64()), links.column("a")]),
            "b": pa.concat_arrays([pa.nulls(1, pa.int64()), links.column("b")])})

    return run


def _cut_region(percent: int):
    """Regions of the nodes of a chunk, by their distances to the pivots of the whole region."""
    def run(nodes: pa.Table, pivots: pa.Table) -> pa.Table:
        _, row, column = _to_pivots(nodes, pivots, percent)
        parent = int(nodes.column("region")[0].as_py())
        names = pivots.column("node").to_numpy().view(np.uint64)
        child = B.mixed(names + np.uint64(parent & (2**64 - 1))).view(np.int64)
        own = nodes.take(pa.array(row))
        return pa.table({"region": child[column], "node": own.column("node"), "shingles": own.column("shingles").cast(pa.binary())})

    return run


def _join_rest(percent: int):
    """Links of the nodes marked `apart` with all nodes of a table."""
    def run(table: pa.Table) -> pa.Table:
        region = Region(table.column("node").to_numpy(), _values(table), percent)
        apart = set(table.filter(table.column("apart")).column("node").to_pylist())
        for pivot in [i for i, x in enumerate(region.names.tolist()) if x in apart]:
            own = int(region.size[pivot])
            ring = np.searchsorted(region.size, [-(-own * percent // 100), own * 100 // percent + 1], "left")
            region.compare(pivot, np.arange(*ring))
        return pa.Table.from_batches([region.found()])

    return run


REGION = "region long, node long, shingles binary"
LINKS = "a long, b long"
WEIGHTS = "region long, rows long, copies long, " + LINKS


MET = "key long, node long"


def _sorted(rows: DataFrame, key: str, then: str) -> DataFrame:
    """Rows of a key in one partition, in order; tasks stream over them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key, then)


def _bytes() -> Column:
    return F.length("shingles").cast("long") + 16


def _large(regions: DataFrame) -> DataFrame:
    sizes = regions.groupBy("region").agg(F.sum(_bytes()).alias("bytes"))
    return sizes.filter(F.col("bytes") > REGION_BYTES)


def region_links(regions: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect all that is linked within the regions."""
    found: list[DataFrame] = []
    large = stored(_large(regions), "large-regions")
    for _ in range(LEVELS):
        small = regions.join(large, "region", "left_anti")
        found.append(stored(small.groupBy("region").applyInArrow(_join_region(percent), LINKS), "links"))
        if large.isEmpty():
            return _all(found)
        rest = regions.join(large, "region")
        chunk = F.abs(F.xxhash64("node")) % F.ceil(F.col("bytes") / REGION_BYTES)
        rest = rest.withColumn("chunk", chunk)
        hashed = F.xxhash64(F.lit(5), "node")
        picked = stored(_pivots(rest, hashed), "pivots")
        dealt = picked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("bytes") / REGION_BYTES) - 1)))
        weighed = stored(_with_pivots(rest, dealt).applyInArrow(_weigh_region(percent), WEIGHTS), "weights")
        found.append(weighed.filter("a is not null").select("a", "b"))
        grown = weighed.filter("rows is not null").groupBy("region").agg(F.sum("rows").alias("rows"), F.sum("copies").alias("copies"))
        stuck = stored(grown.filter(F.col("copies") > GROWTH * F.col("rows")).select("region"), "stuck-regions")
        if not stuck.isEmpty():
            found.append(stored(_rest_links(rest.join(stuck, "region", "left_semi"), _all(found), percent), "links"))
        going = rest.join(stuck, "region", "left_anti")
        regions = stored(_with_pivots(going, dealt).applyInArrow(_cut_region(percent), REGION), "regions")
        large = stored(_large(regions), "large-regions")
    found.append(stored(regions.join(large, "region", "left_anti").groupBy("region")
                        .applyInArrow(_join_region(percent), LINKS), "links"))
    if not large.isEmpty():
        found.append(stored(_rest_links(regions.join(large, "region"), _all(found), percent), "links"))
    return _all(found)


def _with_pivots(rest: DataFrame, dealt: DataFrame):
    """Each chunk of a region with the pivots dealt to it."""
    dealt = dealt.join(rest.select("region").distinct(), "region", "left_semi")
    return (rest.select("region", "chunk", "node", "shingles").groupBy("region", "chunk")
            .cogroup(dealt.select("region", "chunk", "node", "shingles").groupBy("region", "chunk")))


def _pivots(rest: DataFrame, hashed) -> DataFrame:
    """PIVOTS nodes of each region, the least by a hash; tasks trim their own before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("region").orderBy(hashed, "node"))
    least = rest.select("region", "node", "bytes").withColumn("rank", rank).filter(F.col("rank") <= PIVOTS)
    sets = rest.select("region", "node", "shingles")
    return least.join(sets, ["region", "node"]).select("region", "node", "shingles", "bytes")


def _rest_links(rest: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links of the nodes outside the largest part of a region that `links` connect, a pair of blocks a task."""
    groups = components(links).withColumnRenamed("component", "part")
    named = rest.select("region", "node", "shingles", "bytes").join(groups, "node", "left").withColumn("part", F.coalesce("part", "node"))
    parts = named.groupBy("region", "part").agg(F.sum(_bytes()).alias("own"), F.max("bytes").alias("bytes"))
    least = (parts.groupBy("region").agg(F.max(F.struct("own", "part")).alias("main"), F.max("bytes").alias("bytes"))
             .withColumn("apart_bytes", F.col("bytes") - F.col("main.own")).filter("apart_bytes > 0"))
    half = REGION_BYTES // 2
    ready = (named.drop("bytes").join(least, "region").withColumn("apart", F.col("part") != F.col("main.part"))
             .withColumn("n", F.ceil(F.col("bytes") / half)).withColumn("m", F.ceil(F.col("apart_bytes") / half))
             .withColumn("j", F.abs(F.xxhash64("node")) % F.col("n")).withColumn("i", F.abs(F.xxhash64(F.lit(7), "node")) % F.col("m")))
    columns = ["region", "i", "j", "node", "shingles", "apart"]
    against = ready.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))).withColumn("apart", F.lit(False))
    apart = ready.filter("apart").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    both = against.select(columns).unionByName(apart.select(columns))
    return both.groupBy("region", "i", "j").applyInArrow(_join_rest(percent), LINKS)


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """doc, row_id (a hash of id and text), n and group of each row; group is null for empty sets."""
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_id"),
                       F.col(text_col).cast("string").alias("text"))
    size_schema = T.StructType([T.StructField("doc", id_type), *[T.StructField(c, T.LongType()) for c in ("row_id", "node", "n")],
                                T.StructField("slices", T.BinaryType()), T.StructField("block", T.IntegerType()), T.StructField("counts", T.BinaryType())])
    sizes = stored(rows.mapInArrow(_sizes(width), size_schema), "set-sizes")
    # CELLS counts come to the driver and go to the tasks, whatever the corpus.
    blocks = sizes.filter("block is not null").select("block", "counts").groupBy("block").applyInArrow(
        _summed, "block int, counts binary").toArrow()
    counts = np.zeros(CELLS, np.uint32)
    for block, part in zip(blocks.column("block").to_pylist(), blocks.column("counts").to_pylist()):
        counts[block * CELL_BLOCK : (block + 1) * CELL_BLOCK] = np.frombuffer(part, "<u4")
    text = rows.select("text")
    posted = text.mapInArrow(_postings(width, percent, counts), MET)
    met = stored(_sorted(posted, "key", "node").mapInArrow(_met, MET).distinct(), "met")
    nodes = (sizes.filter("n > 0").join(met.select("node").distinct(), "node", "left_semi")
             .groupBy("node").agg(F.first("n").alias("n"), F.first("slices").alias("slices")))
    pairs = _sorted(met.join(nodes, "node").select("key", "node", "n", "slices"), "key", "node")
    top = components(pairs.mapInArrow(_coarse(percent), LINKS))
    dropped(met)
    sets = (text.mapInArrow(_sets(width, Bitmap.of(top, "node")), "node long, shingles binary")
            .groupBy("node").agg(F.first("shingles").alias("shingles")))
    regions = stored(sets.join(top, "node").select(F.col("component").alias("region"), "node", "shingles"), "regions")
    groups = components(region_links(regions, percent))
    dropped(regions)
    named = sizes.filter("block is null").select("doc", "row_id", "node", "n")
    named = named.join(groups.withColumnRenamed("node", "g"), named["node"] == F.col("g"), "left")
    group = F.when(F.col("n") > 0, F.coalesce("component", "node"))
    return named.select("doc", "row_id", "n", group.alias("group"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                       percent: int = 85) -> DataFrame:
    """One row per document: its id, n_shingles, component_id and n_rows of its component."""
    named = _grouped(docs, id_col, text_col, width, percent)
    linked = named.filter("group is not null")
    least = linked.groupBy("group").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n_rows"))
    out = linked.join(least, "group").select("doc", "n", "least", "n_rows")
    alone = named.filter("group is null").select("doc", "n", F.col("doc").alias("least"), F.lit(1).cast("long").alias("n_rows"))
    return out.unionByName(alone).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"),
                                         F.col("least").alias("component_id"), "n_rows")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """The documents with the least id of their component; rows that repeat id and text stay once."""
    named = _grouped(docs, id_col, text_col, width, percent)
    best = named.filter("group is not null").groupBy("group").agg(F.min(F.struct("doc", "row_id")).alias("best"))
    stay = best.select("best.row_id").union(named.filter("group is null").select("row_id")).select(F.col("row_id").alias("__row"))
    keyed = docs.withColumn("__row", F.xxhash64(F.col(id_col), F.col(text_col)))
    return keyed.join(stay, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
