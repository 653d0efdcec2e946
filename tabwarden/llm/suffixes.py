"""Repeated passages by a logarithmic family of suffix arrays.

A byte goes when a string of WIDTH bytes that covers it also starts anywhere else, in the
same text or another. Strings never cross texts, and all are judged on the input.

Which suffixes are kept. Every start of a WIDTH-byte string points at the suffix with the least
hash of 8 bytes among the next WINDOW places. That depends on the string alone, so equal strings
point at the same place in them, and one place in some sixty bytes is pointed at. An entry of a
suffix array stands for such a place p: `head` is a hash of the bytes that every start pointing at
p shares, p up to p + WIDTH - WINDOW + 1, and `around` one of all that any such start may cover,
p - WINDOW + 1 up to p + WIDTH (less at the ends of a text). Arrays are ordered by head, then
around: an order that spreads over executors however texts begin.

The family. Texts come in batches. A batch's array is merge-scanned against all levels: equal
`around` proves that all starts at the place are repeated; equal `head` alone, that some may be.
Two levels of one size merge into the next before a batch is added, so n batches keep log n levels.

Where only the head is shared, the bytes around one place for each `around` are fetched. In groups
of one head they are put in the order of the suffixes themselves, with the common prefix of each
two neighbours: a start d bytes before p is repeated where two suffixes agree for WIDTH - d bytes
and the d bytes before them agree too. Groups of more than GROUP places, which one task should
not hold, compare hashes of their strings by a grouped count instead.

Defined results: null texts are empty; texts under WIDTH bytes stay; repeated rows are
repeats of each other and so lose all; an empty table gives no rows; further columns are
ignored. Long texts are read in pieces. Hashes take 8 bytes at a time through a scramble that is
not linear, and two of 64 bits must agree; texts are known by MD5.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .batches import Texts, binary_rows, gathered, mixed, ship, slices, texts_of
from .stored import dropped, remove_path, shared_path, stored

ship(__name__)

WIDTH = 200         # bytes of a repeated string
WINDOW = 144        # places among which a start picks its suffix
BATCHES = 4
PIECE = 2 << 20     # starts of a long text at a time
GROUP = 16384       # places of one head that a task holds
CHUNK = 8192        # places whose bytes are sorted at a time
SALTS = 16
PLACE = np.uint64((1 << 24) - 1)
ODD = np.uint64(0x9E3779B97F4A7C15)
ENTRY = "t binary, place long, start long, count int, head long, around long"


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on that has as many."""
    n = len(data) - 7
    out = np.empty(n, np.uint64)
    for k in range(8):
        own = data[k : k + (len(data) - k) // 8 * 8].view(np.uint64)
        out[k::8] = own[: len(out[k::8])]
    return out


def hashed(words: np.ndarray, start: np.ndarray, end: np.ndarray, most: int, seed: int) -> np.ndarray:
    """Hashes of spans of 8 to `most` bytes; the final 8 bytes of a shorter span are taken again."""
    state = mixed((end - start).astype(np.uint64) + np.uint64(seed))
    for k in range(0, most - 7, 8):
        state = mixed((state ^ words[np.minimum(start + k, end - 8)]) + ODD)
    return mixed((state ^ words[end - 8]) + ODD)


def least_in_windows(words: np.ndarray, window: int) -> np.ndarray:
    """Where the least hash of each window of places is, the first place of the window counting up."""
    low = (mixed(words) & ~PLACE) | np.arange(len(words), dtype=np.uint64)
    size = 1
    while 2 * size <= window:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if size < window:
        low = np.minimum(low[: len(low) - (window - size)], low[window - size :])
    return (low & PLACE).astype(np.int64)


def _places(data: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray, lo: int, hi: int,
            width: int, window: int) -> tuple[np.ndarray, ...]:
    """owner, place, first start, number of starts, head, around, for starts from lo up to hi.

    data: bytes of some texts, where text i has begin[i] to end[i]; owner: the text of each byte.
    """
    words = words_at(np.concatenate([data, np.zeros(6 + window, np.uint8)]))
    pick = least_in_windows(words, window)[lo:hi]
    start = np.arange(lo, lo + len(pick))
    fits = start + width <= end[owner[lo : lo + len(pick)]]
    start, pick = start[fits], pick[fits]
    new = np.ones(len(start), bool)
    new[1:] = pick[1:] != pick[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    place, start = pick[first], start[first]
    whose = owner[place] if len(place) else np.zeros(0, np.int64)
    head = hashed(words, place, place + (width - window + 1), width - window + 1, 1)
    around = hashed(words, np.maximum(place - window + 1, begin[whose]), np.minimum(place + width, end[whose]),
                    width + window, 2)
    return whose, place, start, count, head, around


def places_of(texts: Texts, width: int = WIDTH, window: int = WINDOW, piece: int = PIECE) -> Iterator[tuple[np.ndarray, ...]]:
    """owner, place, first start, number of starts, head, around: places count from their text's begin."""
    n = len(texts.data)
    if len(texts.offsets) > 2 or n <= 2 * piece:
        begin, end = texts.offsets[:-1], texts.offsets[1:]
        owner = np.repeat(np.arange(len(begin)), end - begin)
        whose, place, start, count, head, around = _places(texts.data, begin, end, owner, 0, n, width, window)
        yield whose, place - begin[whose], start - begin[whose], count, head, around
        return
    at = 0
    while at + width <= n:
        cut = max(0, at - window)
        upto = min(n, at + piece + window + width + 8)
        data = texts.data[cut:upto]
        found = _places(data, np.array([-cut]), np.array([n - cut]), np.zeros(len(data), np.int64),
                        at - cut, at - cut + piece, width, window)
        last = at + piece + width > n or len(found[1]) < 2
        whose, place, start, count, head, around = found if last else [x[:-1] for x in found]   # the last may go on
        yield whose, place + cut, start + cut, count, head, around
        if last:
            return
        at = int(found[2][-1]) + cut


def _entries(width: int, window: int, piece: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, "text"):
            key = rows.column("t")
            for whose, place, start, count, head, around in places_of(texts, width, window, piece):
                if len(place):
                    yield pa.RecordBatch.from_arrays(
                        [key.take(pa.array(whose)), pa.array(place), pa.array(start), pa.array(count.astype(np.int32)),
                         pa.array(head.view(np.int64)), pa.array(around.view(np.int64))],
                        ["t", "place", "start", "count", "head", "around"])
    return run


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps: it does so once the driver's JVM forgets them."""
    gc.collect()
    spark._jvm.System.gc()


class SuffixLevels:
    """The family: each level an array of (head, around, n) in order, n the number of such places.

    `add` returns what the batch has in common with itself and all before it: head, around,
    whole (all starts there are repeated), shared (another place has that head but not all around).
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[tuple[int, DataFrame]] = []      # (size in batches, array), largest first

    def _array(self, entries: DataFrame) -> DataFrame:
        summed = entries.groupBy("head", "around").agg(F.sum("n").alias("n"))
        return stored(summed.sortWithinPartitions("head", "around"), "suffixes")

    def add(self, entries: DataFrame) -> DataFrame:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, self._array(a.unionByName(b))))
            dropped(a, b)
        array = self._array(entries.select("head", "around", F.lit(1).cast("long").alias("n")))
        self.levels.append((1, array))
        met = reduce(DataFrame.unionByName, [level for _, level in self.levels])
        if len(self.levels) > 1:
            met = met.groupBy("head", "around").agg(F.sum("n").alias("n"))
        heads = (met.groupBy("head").agg(F.count("*").alias("kinds"), F.max("n").alias("most"))
                 .filter("kinds > 1 OR most > 1").select("head", "kinds"))
        marks = (met.join(heads, "head").filter("n > 1 OR kinds > 1")
                 .select("head", "around", (F.col("n") > 1).alias("whole"), (F.col("kinds") > 1).alias("shared")))
        return stored(marks, "marks")

    def close(self) -> None:
        dropped(*[level for _, level in self.levels])
        self.levels = []


def _cut_out(width: int, window: int):
    """Bytes around the places that a row lists, and how many of them stand before the place."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, "text"):
            lists = rows.column("places")
            upto = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            flat = lists.flatten()
            whose = np.repeat(np.arange(rows.num_rows), np.diff(upto))
            place = flat.field("place").to_numpy()
            lo = np.maximum(place - window + 1, 0)
            hi = np.minimum(place + width, np.diff(texts.offsets)[whose])
            for at in range(0, len(place), CHUNK):
                s = slice(at, at + CHUNK)
                data = gathered(texts.data, (texts.offsets[:-1][whose] + lo)[s], (hi - lo)[s])
                ends = np.concatenate([[0], np.cumsum((hi - lo)[s])])
                yield pa.RecordBatch.from_arrays(
                    [flat.field("head").slice(at, CHUNK), flat.field("around").slice(at, CHUNK),
                     pa.array((place - lo)[s].astype(np.int32)), binary_rows(data, ends)],
                    ["head", "around", "before", "bytes"])
    return run


def aligned(before: np.ndarray, texts: Texts, width: int, window: int) -> np.ndarray:
    """The bytes of each row in a matrix whose column window - 1 is the place."""
    length = np.diff(texts.offsets)
    table = np.zeros((len(before), window - 1 + width), np.uint8)
    column = np.arange(table.shape[1])
    shift = (window - 1 - before)[:, None]
    table[(column >= shift) & (column < shift + length[:, None])] = texts.data
    return table


def repeated_starts(head: np.ndarray, before: np.ndarray, texts: Texts, width: int = WIDTH, window: int = WINDOW
                    ) -> np.ndarray:
    """[row, d]: whether the string from d bytes before a row's place is that of another row of its head.

    The rows' suffixes are sorted, and neighbours compared once: those that agree for
    width - d bytes stand together, for every d.
    """
    table = aligned(before, texts, width, window)
    after = np.diff(texts.offsets) - before
    suffix = table[:, window - 1 :]
    big = np.zeros((len(before), -(-width // 8) * 8), np.uint8)
    big[:, :width] = suffix
    columns = big.view(">u8").astype(np.uint64)
    order = np.lexsort([*columns.T[::-1], head])
    suffix, head = suffix[order], head[order]
    equal = suffix[1:] == suffix[:-1]
    common = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
    common[head[1:] != head[:-1]] = -1
    common = np.concatenate([[-1], common])
    table, after, before = table[order], after[order], before[order]
    out = np.zeros((len(order), window), bool)
    left = np.zeros(len(order), np.uint64)
    for d in range(window):
        if d:
            left = mixed((left ^ table[:, window - 1 - d]) + ODD)
        own = np.flatnonzero((before >= d) & (after >= width - d))
        key = mixed(left[own] + np.cumsum(common < width - d)[own].astype(np.uint64) * ODD)
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        twice = np.zeros(len(own), bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        out[order[own[twice]], d] = True
    return out


def _starts_as_rows(head: np.ndarray, around: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    has = np.flatnonzero(found.any(axis=1))
    row, d = np.nonzero(found[has])
    upto = np.concatenate([[0], np.cumsum(found[has].sum(axis=1))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(upto), pa.array(d.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(head[has]), pa.array(around[has]), lists], ["head", "around", "back"])


def _sorted_groups(width: int, window: int):
    """Whole groups of one head at a time, of rows that come in the order of their heads."""
    def judged(rows: pa.Table) -> pa.RecordBatch:
        head, around = rows.column("head").to_numpy(), rows.column("around").to_numpy()
        order = np.lexsort((around, head))                 # one row each, should a text have come twice
        new = np.ones(len(order), bool)
        new[1:] = (head[order][1:] != head[order][:-1]) | (around[order][1:] != around[order][:-1])
        pick = np.sort(order[new])
        rows = rows.take(pa.array(pick)).combine_chunks()
        texts = binary_texts(rows.column("bytes"))
        return _starts_as_rows(head[pick], around[pick],
                               repeated_starts(head[pick], rows.column("before").to_numpy().astype(np.int64), texts, width, window))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own])
            if held.num_rows < CHUNK:
                continue
            head = held.column("head").to_numpy()
            border = int(np.searchsorted(head, head[-1], "left"))
            if border:
                yield judged(held.slice(0, border))
                held = held.slice(border)
        if held is not None and held.num_rows:
            yield judged(held)
    return run


def binary_texts(column: pa.ChunkedArray) -> Texts:
    return texts_of(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)


def _strings(width: int, window: int):
    """A hash of each string that a place of a very large group is in, with how far back it starts."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                before = rows.column("before").to_numpy().astype(np.int64)
                texts = binary_texts(rows.column("bytes"))
                table, after = aligned(before, texts, width, window), np.diff(texts.offsets) - before
                row, back, found = [], [], []
                right = np.zeros((width + 1, len(before)), np.uint64)
                for k in range(width):
                    right[k + 1] = mixed((right[k] ^ table[:, window - 1 + k]) + ODD)
                left = np.zeros(len(before), np.uint64)
                for d in range(window):
                    if d:
                        left = mixed((left ^ table[:, window - 1 - d]) + ODD)
                    own = np.flatnonzero((before >= d) & (after >= width - d))
                    row.append(own)
                    back.append(np.full(len(own), d, np.int32))
                    found.append(mixed(left[own] * ODD + right[width - d][own]))
                row = np.concatenate(row)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("head").take(pa.array(row)), rows.column("around").take(pa.array(row)),
                     pa.array(np.concatenate(back)), pa.array(np.concatenate(found).view(np.int64))],
                    ["head", "around", "d", "string"])
    return run


def _spans(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Union of the strings that begin in the listed runs of starts."""
    for rows in batches:
        keys, spans = [], []
        for key, runs in zip(rows.column("t").to_pylist(), rows.column("runs")):
            flat = runs.values
            place, start = flat.field("place").to_numpy(), flat.field("start").to_numpy()
            count = flat.field("count").to_numpy().astype(np.int64)
            whole = flat.field("whole").to_numpy(zero_copy_only=False)
            back = flat.field("back").combine_chunks() if isinstance(flat.field("back"), pa.ChunkedArray) else flat.field("back")
            size = back.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            d = back.flatten().to_numpy().astype(np.int64)
            at = np.repeat(place, size) - d
            own = (at >= np.repeat(start, size)) & (at < np.repeat(start + count, size))
            lo = np.concatenate([start[whole], at[own]])
            hi = np.concatenate([(start + count)[whole] - 1, at[own]]) + width
            if not len(lo):
                continue
            order = np.argsort(lo, kind="stable")
            lo, reach = lo[order], np.maximum.accumulate(hi[order])
            new = np.ones(len(lo), bool)
            new[1:] = lo[1:] > reach[:-1]
            first = np.flatnonzero(new)
            keys.append(key)
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(lo[first], reach[np.append(first[1:], len(lo)) - 1])])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["t", "spans"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES,
                   width: int = WIDTH, window: int = WINDOW, piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """t (MD5 of a text), spans (start, end in bytes, maximal, in order): texts with repeats."""
    if not 8 <= width - window + 1 or window < 2:
        raise ValueError("the window must leave 8 bytes of the width")
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"),
                        F.unhex(F.md5(F.col(text_col))).alias("t")).filter(F.octet_length("text") >= width)
    path = shared_path(spark, "places")
    places = keyed.select("t", "text").mapInArrow(
        _entries(width, window, piece), ENTRY)
    batch = F.pmod(F.xxhash64("t"), F.lit(batches)).cast("int")
    places.withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    places = spark.read.schema(f"{ENTRY}, batch int").parquet(path)

    family, marks = SuffixLevels(spark), []
    for b in range(batches):
        marks.append(family.add(places.filter(F.col("batch") == b).select("head", "around")))
        free_shuffles(spark)
    family.close()
    known = stored(reduce(DataFrame.unionByName, marks).groupBy("head", "around").agg(
        F.max("whole").alias("whole"), F.max("shared").alias("shared")), "known")    # written: Spark splits hot keys of joins with written tables only
    dropped(*marks)
    free_shuffles(spark)
    # Equal texts leave their places once. Keys other than the join's let Spark split hot keys of the join.
    same = [F.first(c).alias(c) for c in ("start", "count", "head", "around", "whole", "shared")]
    live = stored(places.join(known, ["head", "around"]).groupBy("t", "place").agg(*same), "live")
    dropped(known)
    remove_path(path)
    free_shuffles(spark)

    back = _back(spark, keyed, live, width, window, group)
    # An entry that is not whole stands at one place only, so this join has no hot key.
    listed = live.filter("whole").select("t", "place", "start", "count", "whole", F.lit(None).cast("array<int>").alias("back"))
    listed = listed.unionByName(live.filter(~F.col("whole")).join(back, ["head", "around"])
                                .select("t", "place", "start", "count", "whole", "back"))
    runs = listed.groupBy("t").agg(F.collect_list(F.struct("place", "start", "count", "whole", "back")).alias("runs"))
    spans = stored(runs.mapInArrow(lambda rows: _spans(rows, width),
                                   "t binary, spans array<struct<start: long, end: long>>"), "spans")
    dropped(live, back)
    free_shuffles(spark)
    return spans


def _back(spark: SparkSession, keyed: DataFrame, live: DataFrame, width: int, window: int, group: int) -> DataFrame:
    """head, around, back (how far before the place repeated strings start), where the head alone is shared."""
    one = live.filter("shared").groupBy("head", "around").agg(F.min(F.struct("t", "place")).alias("at"))
    one = stored(one.select("head", "around", "at.t", "at.place"), "edges")
    large = one.groupBy("head").agg(F.count("*").alias("m")).filter(F.col("m") > group).select("head")
    texts = keyed.groupBy("t").agg(F.min("id").alias("id"))        # one text of equal ones is read
    wanted = (one.groupBy("t").agg(F.collect_list(F.struct("head", "around", "place")).alias("places")).join(texts, "t"))
    around = stored(keyed.join(wanted, ["t", "id"]).select("text", "places")
                    .mapInArrow(_cut_out(width, window), "head long, around long, before int, bytes binary"), "around")
    free_shuffles(spark)
    kind = "head long, around long, back array<int>"
    small = around.join(large, "head", "left_anti")
    found = small.repartition("head").sortWithinPartitions("head").mapInArrow(_sorted_groups(width, window), kind)
    if not large.isEmpty():
        rows = (around.join(large, "head", "left_semi").dropDuplicates(["head", "around"])
                .mapInArrow(_strings(width, window), "head long, around long, d int, string long"))
        twice = rows.groupBy("head", "d", "string").agg(F.count("*").alias("m")).filter("m > 1").drop("m")
        found = found.unionByName(rows.join(twice, ["head", "d", "string"]).groupBy("head", "around")
                                  .agg(F.collect_list("d").alias("back")))
    out = stored(found, "back")
    dropped(one, around)
    return out


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the bytes of their spans."""
    for rows, texts in slices(batches, "text"):
        spans = rows.column("spans")
        size = spans.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        flat = spans.flatten()
        base = np.repeat(texts.offsets[:-1], size)
        step = np.zeros(len(texts.data) + 1, np.int8)
        step[base + flat.field("start").to_numpy()] += 1
        np.subtract.at(step, base + flat.field("end").to_numpy(), 1)
        stay = np.cumsum(step[:-1], dtype=np.int8) == 0
        upto = np.concatenate([[0], np.cumsum(stay)])[texts.offsets]
        columns = [rows.column(c) for c in rows.schema.names if c not in ("text", "spans")]
        names = [c for c in rows.schema.names if c not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays([*columns, spans, binary_rows(texts.data[stay], upto)], [*names, "spans", "kept"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES,
                    width: int = WIDTH, window: int = WINDOW, piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """id_col, n_bytes, spans (start, end in bytes), kept (the other bytes): a row for each of docs.

    The texts meet their spans under SALTS keys for each text, so that no task holds all
    copies of one; spans are few and are sent once for each key.
    """
    spans = repeated_spans(docs, id_col, text_col, batches, width, window, piece, group)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"t": F.unhex(F.md5("text")), "n_bytes": F.octet_length("text").cast("long"),
                             "salt": F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")})
    copies = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.join(copies, ["t", "salt"], "left").select(id_col, "n_bytes", "text", "spans")
    span = "array<struct<start: long, end: long>>"
    kind = f"{docs.schema[id_col].dataType.simpleString()}"
    out = joined.mapInArrow(_kept, f"`{id_col}` {kind}, n_bytes long, spans {span}, kept binary")
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(span)))
