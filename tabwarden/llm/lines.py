"""Near-equal lines across documents: one occurrence of each connected group stays.

Lines are normalised as the quality rules do (ASCII lower case, runs of digits as one 0,
blanks as one) and read as words. All lines with a letter or digit take part. Two lines
are linked when they are equal, or when their edit similarity, 1 - (edits of words) /
(words of the longer line), is at least `similarity`. No hash decides a link, and none is
left out. Of each connected group the first occurrence stays, in the order of document id,
row and line.

1. Equal lines are one by a hash of their words. A line of fewer than LEAST words can't be
   near another one at 0.8.
2. Pigeonhole blocks: an edit undoes at most two of a line's pairs of neighbouring words, so
   of lines with n and m >= n words, e <= (1 - similarity) m edits apart, at least m - 1 - 2 e
   pairs are kept. In one order for all, rare pairs first, the least kept pair is among the
   first `prefix_size` of both lines. Those are the line's blocks; a repeated pair is one.
   How rare a pair is, is read from counts in CELLS cells; any order would do.
3. Blocks travel as packed numbers, a row for each part of the blocks and POSTS of them. Of
   each bucket, lines stay that may be linked by a mark: the number of words, and the block's
   place in the line. The words before and after a kept pair differ in number by e in all.
4. Fingerprint, of the lines that are left: BITS_OF_LINE bits, each whether the words that
   hash there are odd in number. An edit turns two bits at most, so no link is lost. (A
   SimHash's majority bits have no such bound: one edit may turn all of them.)
5. Of each line the next one of its bucket that may be linked is compared by its words, each
   two lines once. Only buckets that these links leave in pieces are compared pair by pair,
   until they are connected. A bucket of more than MOST lines or MOST_WORDS words is cut into
   chunks, and each two chunks are a bucket.

Defined results: null and empty texts have no lines; a null document id comes first in
order; rows that repeat id and text are one document and keep a row each; an empty table
gives an empty one. `removed_col`, `lines_col` replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import batches as B
from .bitmaps import Bitmap, has
from .components import components
from .quality import line_spans, normalised
from .stored import dropped, stored

B.ship(__name__)

BITS, PLACE_BITS, COUNT_AT, MOST_COUNT = 0, 8, 8, (1 << 24) - 1     # a mark: the block's place, then the number of words
BITS_OF_LINE = 256
LEAST = 4
PAIR_BITS = 40          # of a pair's hash that make its block, above them how frequent it is
LINES_AT_ONCE = 1 << 15
SLICE = 1 << 19         # bytes of text; with more the arrays leave the cache
POSTS = 1 << 19
PARTS = 4               # of the blocks, for each partition of a shuffle
HELD = 4 << 20
CELLS = 1 << 20
CELL_BLOCK = 1 << 12
MOST = 20_000
MOST_WORDS = 2 << 20
SKETCH = 64
PAIRED = 1000           # lines of a bucket that is left in pieces, whose pairs are listed
SIMILARITY = 0.8
EDGES = "a long, b long"
MET = "key long, line long, mark long, chunk long"
BIT_WORDS = [f"bits{k}" for k in range(BITS_OF_LINE // 64)]
NEAR = f"key long, line long, mark long, side long, {' long, '.join(BIT_WORDS)} long, other long"


def solid(texts: B.Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which lines have a letter or digit; all bytes from 128 on count as letters."""
    letter = np.zeros(256, bool)
    letter[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    out = np.zeros(len(start), bool)
    full = np.flatnonzero(end > start)
    if len(full):
        ends = np.stack([start[full], end[full]], 1).ravel()
        out[full] = np.logical_or.reduceat(np.append(letter[texts.data], False), ends)[::2]
    return out


class Lines:
    """The lines of a slice with a letter or digit: text, place in the text, words, and a hash."""

    def __init__(self, texts: B.Texts):
        words = B.words_of(texts)
        start, end, text = line_spans(texts)
        first = np.searchsorted(words.start, start, "left")
        count = np.searchsorted(words.start, end, "left") - first
        head = np.searchsorted(text, np.arange(len(texts.offsets)))
        number = np.arange(len(text)) - head[text] if len(text) else text
        data, before = normalised(texts)
        self.word = B.span_hashes(data, before[words.start], before[words.end])
        keep = solid(texts, start, end)
        place = np.arange(len(self.word)) - np.repeat(first, count) if len(first) else np.zeros(0, np.int64)
        running = np.zeros(len(self.word) + 1, np.uint64)
        np.cumsum(B.mixed(self.word + B.mixed(place.astype(np.uint64) + np.uint64(1))), out=running[1:], dtype=np.uint64)
        self.first, self.count, self.text, self.number = first[keep], count[keep], text[keep], number[keep]
        self.line = running[self.first + self.count] - running[self.first]

    def marks(self, which: np.ndarray) -> np.ndarray:
        """Of some of the lines, the number of words, up to MOST_COUNT, where a mark has it."""
        return np.minimum(self.count[which], MOST_COUNT).astype(np.uint64) << np.uint64(COUNT_AT)

    def fingerprints(self, which: np.ndarray) -> np.ndarray:
        """Lines x BITS_OF_LINE / 64 numbers of 64 bits: whether the words of each cell are odd in number."""
        out = np.zeros((len(which), BITS_OF_LINE // 8), np.uint8)
        for low in range(0, len(which), 4096):
            own = which[low : low + 4096]
            n = self.count[own]
            words = B.gathered(self.word, self.first[own], n)
            cell = np.repeat(np.arange(len(n)) * BITS_OF_LINE, n) + (words >> np.uint64(56)).astype(np.int64) * BITS_OF_LINE // 256
            odd = (np.bincount(cell, minlength=len(n) * BITS_OF_LINE) & 1).astype(bool).reshape(-1, BITS_OF_LINE)
            out[low : low + 4096] = np.packbits(odd, axis=1)
        return out.view(np.uint64)

    def blocks(self, which: np.ndarray, similarity: float = SIMILARITY, ranks: np.ndarray | None = None
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The blocks of some of the lines, the line's place in `which`, and the block's in the line from 1.

        `ranks` says how frequent the pairs of each cell are. A place is 0 if the pair is repeated or far on.
        """
        pairs = B.window_hashes(self.word, 2)
        key = pairs >> np.uint64(64 - PAIR_BITS)
        if ranks is not None:
            key |= ranks[(pairs & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(PAIR_BITS)
        parts = []
        for low in range(0, max(len(which), 1), LINES_AT_ONCE):
            some = which[low : low + LINES_AT_ONCE]
            found = self._least(key, some, similarity)
            parts.append((found[0], found[1] + low, found[2]))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _least(self, key: np.ndarray, which: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each line, the pairs up to the one at `prefix_size` in order: no more than numbers are sorted."""
        n = self.count[which]
        size = np.maximum(n - 1, 0)
        own = np.repeat(np.arange(len(n)), size)
        value = B.gathered(key, self.first[which], size) | own.astype(np.uint64) << np.uint64(48)
        start = np.cumsum(size) - size
        order = np.sort(value)
        full = np.flatnonzero(size)
        last = np.zeros(len(n), np.uint64)
        last[full] = order[start[full] + np.minimum(prefix_size(n, similarity), size)[full] - 1]
        repeated = np.unique(order[1:][order[1:] == order[:-1]])
        at = np.flatnonzero(value <= last[own])
        value, own = value[at], own[at]
        place = at - start[own] + 1
        place[place >= 1 << PLACE_BITS] = 0
        if len(repeated):
            again = np.flatnonzero(repeated[np.minimum(np.searchsorted(repeated, value), len(repeated) - 1)] == value)
            place[again] = 0
            once = np.ones(len(value), bool)
            once[again] = False
            once[again[np.unique(value[again], return_index=True)[1]]] = True
            value, own, place = value[once], own[once], place[once]
        return value & np.uint64((1 << 48) - 1), own, place.astype(np.uint64)


def prefix_size(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many of its first pairs a line of n words must share one of with each line it links to.

    Of n - 1 pairs m - 1 - 2 e are kept, m the longer line's words; longer by one is the worst case.
    """
    edits, more = (np.floor((1 - similarity) * m + 1e-9).astype(np.int64) for m in (n, n + 1))
    return np.maximum(2 * edits + 1, 2 * more)


OCCURRENCES = ["doc", "row_id", "number", "line", *BIT_WORDS, "cells", "counts"]


def _occurrences(batches):
    """A row for each line, with its fingerprint once a slice, and this task's counts of pairs of words by cell, up to 65535."""
    cells, kind, held, pending = np.zeros(CELLS, np.int64), None, [], 0
    for rows, texts in B.slices(batches, "text", SLICE):
        lines = Lines(texts)
        own = pa.array(lines.text)
        kind, m = rows.column("doc").type, len(own)
        pairs = B.gathered(B.window_hashes(lines.word, 2), lines.first, np.maximum(lines.count - 1, 0))
        held.append((pairs & np.uint64(CELLS - 1)).astype(np.int32))
        pending += len(pairs)
        if pending > CELLS:
            cells += np.bincount(np.concatenate(held), minlength=CELLS)
            held, pending = [], 0
        first = np.unique(lines.line, return_index=True)[1]
        first = np.sort(first[lines.count[first] >= LEAST])
        at = np.full(m, -1)
        at[first] = np.arange(len(first))
        bits = np.append(lines.fingerprints(first), np.zeros((1, len(BIT_WORDS)), np.uint64), axis=0)[at].view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc").take(own), rows.column("row_id").take(own), pa.array(lines.number),
             pa.array(lines.line.view(np.int64)), *[pa.array(b, mask=at < 0) for b in bits.T], pa.nulls(m, pa.int64()),
             pa.nulls(m, pa.binary())], OCCURRENCES)
    if held:
        cells += np.bincount(np.concatenate(held), minlength=CELLS)
    blocks = np.minimum(cells, 65535).astype("<u2").reshape(-1, CELL_BLOCK)
    some = np.flatnonzero(blocks.any(axis=1))
    if len(some):
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(some), kind), *[pa.nulls(len(some), pa.int64()) for _ in OCCURRENCES[1:-2]], pa.array(some),
             pa.array([blocks[i].tobytes() for i in some], pa.binary())], OCCURRENCES)


def _summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How frequent the pairs of CELL_BLOCK cells are over all tasks, in quarters of a power of two."""
    total = np.zeros(CELL_BLOCK, np.int64)
    for batch in batches:
        for part in batch.column("counts"):
            total += np.frombuffer(part.as_buffer(), "<u2")
    yield pa.RecordBatch.from_pydict({"cells": pa.array([key[0].as_py()], pa.int64()),
                                      "ranks": pa.array([(4 * np.log2(total + 1)).astype(np.uint8).tobytes()], pa.binary())})


def pair_ranks(counted: DataFrame) -> np.ndarray:
    """A number for each of CELLS cells; it is as large whatever the corpus."""
    found = (counted.filter("cells is not null").select("cells", "counts").groupBy("cells")
             .applyInArrow(_summed, "cells long, ranks binary").toArrow())
    ranks = np.zeros(CELLS, np.uint8)
    for at, part in zip(found.column("cells").to_pylist(), found.column("ranks").to_pylist()):
        ranks[at * CELL_BLOCK : (at + 1) * CELL_BLOCK] = np.frombuffer(part, np.uint8)
    return ranks


class Forest:
    """Sets of numbered things, joined by edges."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def roots(self) -> np.ndarray:
        """The root of each."""
        while (onward := self.up[self.up] != self.up).any():
            self.up[onward] = self.up[self.up[onward]]
        return self.up

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def whole_buckets(batches):
    """Tables of buckets; rows come sorted by key, and a bucket may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1], "left"))
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        elif held and held[0].column("key")[0].as_py() != int(key[-1]):
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return head, np.diff(np.append(head, len(key)))


def marks_allow(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether lines of these marks may be linked: by their lengths and the block's places."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    n, m = a >> COUNT_AT, b >> COUNT_AT
    longer = np.maximum(n, m)
    edits = np.floor((1 - similarity) * longer + 1e-9)
    p, q = a & (1 << PLACE_BITS) - 1, b & (1 << PLACE_BITS) - 1
    placed = (p == 0) | (q == 0) | (np.abs(p - q) + np.abs((n - p) - (m - q)) <= edits)
    return (np.abs(n - m) <= edits) & (placed | (longer == MOST_COUNT))


def fingerprints_allow(bits: np.ndarray, mark: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether rows i and j may be linked, by the bits that differ. `bits` has 64-bit words of each row."""
    apart = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
    longer = np.maximum(mark[i], mark[j]).astype(np.int64) >> COUNT_AT
    return (apart <= 2 * np.floor((1 - similarity) * longer + 1e-9)) | (longer == MOST_COUNT)


def partners(ends: np.ndarray, live: np.ndarray, allow) -> np.ndarray:
    """For each row that any other of its bucket may be linked with, the next such one, else one before; -1 for none.

    `ends` says where a row's bucket ends, `live` which rows are looked at, `allow(i, j)` whether two may be linked.
    """
    after, before = np.full(len(ends), -1), np.full(len(ends), -1)
    k = 1
    while len(live := live[live + k < ends[live]]):
        i = live[(after[live] < 0) | (before[live + k] < 0)]
        i = i[allow(i, i + k)]
        after[i] = np.where(after[i] < 0, i + k, after[i])
        before[i + k] = np.where(before[i + k] < 0, i, before[i + k])
        k += 1
    return np.where(after < 0, before, after)


def _packed(posts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int) -> pa.RecordBatch:
    """A row for each part of the blocks, with the blocks, lines and marks of all its rows."""
    key, line, mark = (np.concatenate(x) for x in zip(*posts))
    part = ((B.mixed(key) >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16 if parts <= 65536 else np.uint32)
    order = np.argsort(part, kind="stable")
    size = np.bincount(part, minlength=parts)
    some = np.flatnonzero(size)
    ends = np.concatenate([[0], np.cumsum(size[some])])
    return pa.RecordBatch.from_arrays(
        [pa.array(some.astype(np.int32)), B.binary_rows(key[order].astype("<u4").view(np.uint8), ends * 4),
         B.binary_rows(line[order].view(np.uint8), ends * 8), B.binary_rows(mark[order].astype("<u4").view(np.uint8), ends * 4)],
        ["part", "keys", "lines", "marks"])


def _posted(similarity: float, ranks: np.ndarray, parts: int):
    """The blocks of each line; equal lines of a slice count once."""
    def run(batches):
        held, rows = [], 0
        for _, texts in B.slices(batches, "text", SLICE):
            lines = Lines(texts)
            line, first = np.unique(lines.line, return_index=True)
            enough = lines.count[first] >= LEAST
            line, first = line[enough], first[enough]
            key, own, place = lines.blocks(first, similarity, ranks)
            held.append((key, line[own], (lines.marks(first)[own] | place).astype(np.uint32)))
            rows += len(key)
            if rows >= POSTS:
                yield _packed(held, parts)
                held, rows = [], 0
        if rows:
            yield _packed(held, parts)

    return run


def _met(similarity: float):
    """The lines of each block that several have, if their marks allow a link.

    A bucket gets a hash of all its lines for a key, so buckets of the same lines are one
    from then on; places in the line go, as they are those of one block. A large one keeps its
    key and goes out in numbered chunks as it comes in.
    """
    def shared(key, line, mark):
        """The rows in order, each line of a block once, and of blocks that several lines have only."""
        order = np.sort(key.astype(np.uint64) << np.uint64(32) | np.arange(len(key), dtype=np.uint64))
        at, key = (order & np.uint64(0xFFFFFFFF)).astype(np.int64), (order >> np.uint64(32)).astype(np.uint32)
        head, size = _runs(key)
        more = np.repeat(size, size) > 1
        key, line, mark = key[more], line[at[more]], mark[at[more]]
        order = np.lexsort((line, key))
        key, line, mark = key[order], line[order], mark[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        return key[new], line[new], mark[new]

    def cut(key, mark, sent):
        """Which chunk of its bucket each row is of, and which rows are of cut ones; `sent`: lines and words of those begun."""
        head, size = _runs(key)
        words = np.cumsum(mark.astype(np.int64) >> COUNT_AT)
        began = np.zeros((len(head), 2), np.int64)
        began[:, 1] = words[head] - (mark[head].astype(np.int64) >> COUNT_AT)
        ongoing = np.isin(key[head], list(sent))
        for b in np.flatnonzero(ongoing).tolist():
            began[b] -= np.array(sent[int(key[head[b]])]) * [-1, 1]
        place = np.arange(len(key)) - np.repeat(head - began[:, 0], size)
        chunk = place // MOST + (words - np.repeat(began[:, 1], size)) // MOST_WORDS
        large = ongoing | (chunk[head + size - 1] > 0)
        for b in np.flatnonzero(large).tolist():
            end = head[b] + size[b] - 1
            sent[int(key[end])] = (int(place[end]) + 1, int(words[end] - began[b, 1]))
        return chunk, np.repeat(large, size)

    def batch_of(key, line, mark, chunk):
        return pa.RecordBatch.from_pydict({"key": key.view(np.int64), "line": line.view(np.int64),
                                           "mark": mark.astype(np.int64), "chunk": chunk})

    def run(part: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.uint64(part[0].as_py()) << np.uint64(32)
        posts, rows, left, sent = [], 0, 0, {}
        for batch in batches:
            values = [np.frombuffer(B.texts_of(batch.column(c)).data.tobytes(), kind)
                      for c, kind in (("keys", "<u4"), ("lines", np.uint64), ("marks", "<u4"))]
            posts.append(values)
            rows += len(values[0])
            if rows > HELD and rows > 2 * left:  # a block of very many lines is not waited for
                key, line, mark = (np.concatenate(x) for x in zip(*posts))
                order = np.lexsort((line, key))
                key, line, mark = key[order], line[order], mark[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
                key, line, mark = key[new], line[new], mark[new]
                chunk, large = cut(key, mark, sent)
                if large.any():
                    yield batch_of(B.mixed(key[large] | own), line[large], mark[large], chunk[large])
                posts = [[key[~large], line[~large], mark[~large]]]
                rows = left = len(posts[0][0])
        if not rows:
            return
        key, line, mark = (np.concatenate(x) for x in zip(*posts))
        ongoing = np.isin(key, list(sent))
        if ongoing.any():  # of blocks that went out in part already
            order = np.flatnonzero(ongoing)
            order = order[np.argsort(key[order], kind="stable")]
            yield batch_of(B.mixed(key[order] | own), line[order], mark[order], cut(key[order], mark[order], sent)[0])
            key, line, mark = key[~ongoing], line[~ongoing], mark[~ongoing]
        if not len(key):
            return
        key, line, mark = shared(key, line, mark)
        if not len(key):
            return
        chunk, large = cut(key, mark, {})
        if large.any():
            yield batch_of(B.mixed(key[large] | own), line[large], mark[large], chunk[large])
            key, line, mark = key[~large], line[~large], mark[~large]
            if not len(key):
                return
        head, size = _runs(key)
        other = partners(np.repeat(head + size, size), np.arange(len(key)), lambda i, j: marks_allow(mark[i], mark[j], similarity))
        may = other >= 0
        if not may.any():
            return
        key, line, mark = key[may], line[may], mark[may] & ~np.uint32((1 << PLACE_BITS) - 1)
        head, size = _runs(key)
        running = np.zeros(len(line) + 1, np.uint64)
        np.cumsum(B.mixed(line + np.uint64(9)), out=running[1:], dtype=np.uint64)
        name = B.mixed(running[head + size] - running[head] + size.astype(np.uint64))
        some = np.unique(name, return_index=True)[1]
        yield batch_of(np.repeat(name[some], size[some]), B.gathered(line, head[some], size[some]),
                       B.gathered(mark, head[some], size[some]), np.zeros(int(size[some].sum()), np.int64))

    return run


def _allowed(table: pa.Table, similarity: float):
    """A test of rows of buckets with marks, sides and fingerprints."""
    line, side, mark = (table.column(c).to_numpy() for c in ("line", "side", "mark"))
    bits = np.stack([table.column(c).to_numpy().view(np.uint64) for c in BIT_WORDS], 1)

    def allow(i, j):
        may = marks_allow(mark[i], mark[j], similarity) & ((side[i] == 0) | (side[i] != side[j])) & (line[i] != line[j])
        may[may] = fingerprints_allow(bits, mark, i[may], j[may], similarity)
        return may

    return allow


def _near(similarity: float):
    """The lines of each bucket that may be linked by their fingerprints, each with one that it may be linked to."""
    def run(batches):
        for table in whole_buckets(batches):
            head, size = _runs(table.column("key").to_numpy())
            other = partners(np.repeat(head + size, size), np.arange(table.num_rows), _allowed(table, similarity))
            at = np.flatnonzero(other >= 0)
            line = table.column("line").to_numpy()
            few = table.select(["key", "line", "mark", "side", *BIT_WORDS]).take(pa.array(at))
            yield from few.append_column("other", pa.array(line[other[at]])).combine_chunks().to_batches()

    return run


def _apart(similarity: float):
    """All pairs of each bucket that may be linked and are not connected already."""
    def run(batches):
        for table in whole_buckets(batches):
            head, size = _runs(table.column("key").to_numpy())
            ends, allow = np.repeat(head + size, size), _allowed(table, similarity)
            line, known = table.column("line").to_numpy(), table.column("known").to_numpy()
            live, k, found = np.arange(len(line)), 1, [np.zeros((0, 2), np.int64)]
            while len(live := live[live + k < ends[live]]):
                i = live[known[live] != known[live + k]]
                i = i[allow(i, i + k)]
                found.append(np.stack([np.minimum(line[i], line[i + k]), np.maximum(line[i], line[i + k])], 1))
                k += 1
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _linked(similarity: float):
    """The pairs of lines that are linked."""
    def run(batches):
        for batch in batches:
            sides = [B.texts_of(batch.column(c)) for c in ("words_a", "words_b")]
            words = [np.frombuffer(x.data.tobytes(), np.uint64) for x in sides]
            (p, q), (r, s) = ((x.offsets[:-1] // 8, x.offsets[1:] // 8) for x in sides)
            hit = [alike(words[0][i:j], words[1][k:m], similarity)
                   for i, j, k, m in zip(p.tolist(), q.tolist(), r.tolist(), s.tolist())]
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return run


def sketches(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Lines x SKETCH: how many words of a line are in each cell, 255 for more."""
    cell = np.repeat(np.arange(len(n)) * SKETCH, n) + (words >> np.uint64(58)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=len(n) * SKETCH), 255).astype(np.uint8).reshape(-1, SKETCH)


def _settle(similarity: float):
    """Confirmed links that connect each bucket; the lines' words come along.

    `side` is 0 in buckets of one chunk, else which of two chunks a line is of; `known` is equal
    for lines that are connected already.
    """
    def run(batches):
        for table in whole_buckets(batches):
            line, side = table.column("line").to_numpy(), table.column("side").to_numpy()
            mark = table.column("mark").to_numpy()
            values = B.texts_of(table.column("words"))
            all_words, at = np.frombuffer(values.data.tobytes(), np.uint64), values.offsets // 8
            n = np.diff(at)
            sketch = sketches(all_words, n)
            head, size = _runs(table.column("key").to_numpy())
            ends = np.repeat(head + size, size)
            names, name = np.unique(table.column("known").to_numpy(), return_inverse=True)
            forest, out = Forest(len(names)), []
            live, k, joined = np.arange(len(line)), 1, 0
            group = name
            while len(live := live[live + k < ends[live]]):
                for low in range(0, len(live), MOST):
                    i = live[low : low + MOST]
                    j = i + k
                    open_ = group[i] != group[j]
                    i, j = i[open_], j[open_]
                    may = marks_allow(mark[i], mark[j], similarity) & ((side[i] == 0) | (side[i] != side[j]))
                    i, j = i[may], j[may]
                    # An edit changes two counts by one at most.
                    edits = np.floor((1 - similarity) * np.maximum(n[i], n[j]) + 1e-9)
                    may = np.abs(sketch[i].astype(np.int16) - sketch[j]).sum(1, dtype=np.int64) <= 2 * edits
                    for a, b in zip(i[may].tolist(), j[may].tolist()):
                        if forest.root(name[a]) != forest.root(name[b]) and alike(
                                all_words[at[a] : at[a + 1]], all_words[at[b] : at[b + 1]], similarity):
                            forest.join(name[a], name[b])
                            out.append((a, b))
                    if len(out) > joined:
                        joined, group = len(out), forest.roots()[name]
                k += 1
                if k & (k - 1) == 0:  # buckets that are connected are done
                    done = np.minimum.reduceat(group, head) == np.maximum.reduceat(group, head)
                    live = live[~np.repeat(done, size)[live]]
            pairs = np.array(out, np.int64).reshape(-1, 2)
            a, b = line[pairs[:, 0]], line[pairs[:, 1]]
            yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def edit_distance(a: list[int], b: list[int]) -> int:
    """Edits of words, by bit vectors of a whole row of the table at a time."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict[int, int] = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    full, top, score = (1 << len(b)) - 1, 1 << (len(b) - 1), len(b)
    up, down = full, 0
    for x in a:
        same = places.get(x, 0)
        level = same | down
        diagonal = (((same & up) + up) ^ up) | same
        rise = down | ~(diagonal | up) & full
        fall = up & diagonal
        score += bool(rise & top) - bool(fall & top)
        rise = (rise << 1 | 1) & full
        fall = fall << 1 & full
        up = fall | ~(level | rise) & full
        down = rise & level
    return score


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two arrays of words have that edit similarity; what they begin or end with alike is left out first."""
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    edits = longer - (similarity * longer - 1e-9)
    if longer - shorter > edits:
        return False
    other = np.flatnonzero(a[:shorter] != b[:shorter])
    before = int(other[0]) if len(other) else shorter
    room = shorter - before
    other = np.flatnonzero(a[len(a) - room :][::-1] != b[len(b) - room :][::-1])
    after = int(other[0]) if len(other) else room
    a, b = a[before : len(a) - after], b[before : len(b) - after]
    if max(len(a), len(b)) <= edits:
        return True
    if len(a) < len(b):
        a, b = b, a
    # Words put in at one place and others changed: so many edits are enough, if not the fewest.
    more = len(a) - len(b)
    changed = np.zeros(len(b) + 1, np.int64)
    np.cumsum(a[: len(b)] != b, out=changed[1:])
    moved = np.zeros(len(b) + 1, np.int64)
    np.cumsum(a[more:] != b, out=moved[1:])
    if more + int((changed + (moved[-1] - moved)).min()) <= edits:
        return True
    return edit_distance(a.tolist(), b.tolist()) <= edits


def _among(wanted: Bitmap, column: str, inside: bool):
    """The rows whose number is in the filter, or those that are not."""
    def run(batches):
        opened = wanted.opened()
        for batch in batches:
            hit = has(opened, batch.column(column).to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.filter(pa.array(hit == inside))

    return run


def _words_of_lines(wanted: Bitmap, readers: Bitmap):
    """The words of the wanted lines, from the rows that are to give them."""
    def run(batches):
        opened = wanted.opened()
        for _, texts in B.slices(_among(readers, "row_id", True)(batches), "text", SLICE):
            lines = Lines(texts)
            line, first = np.unique(lines.line, return_index=True)
            hit = has(opened, line)
            line, own = line[hit], first[hit]
            words = B.gathered(lines.word, lines.first[own], lines.count[own])
            ends = np.concatenate([[0], np.cumsum(lines.count[own])]) * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(line.view(np.int64)), B.binary_rows(np.ascontiguousarray(words).view(np.uint8), ends)],
                ["line", "words"])

    return run


def _counted(wanted: Bitmap, inside: bool):
    """`_among` by `__row`, with the number of lines that take part in `__in`."""
    def run(batches):
        for rows, texts in B.slices(_among(wanted, "__row", inside)(batches), "__text", SLICE):
            start, end, text = line_spans(texts)
            count = np.bincount(text[solid(texts, start, end)], minlength=rows.num_rows).astype(np.int64)
            yield rows.set_column(rows.schema.names.index("__in"), "__in", pa.array(count))

    return run


def _without(batches):
    """The texts without the lines whose numbers are in `__gone`."""
    for batch in batches:
        at = batch.schema.names.index("__text")
        left = []
        for text, gone in zip(batch.column("__text").to_pylist(), batch.column("__gone").to_pylist()):
            if gone:
                out = set(gone)
                text = "\n".join(part for k, part in enumerate(text.split("\n")) if k not in out)
            left.append(text)
        yield batch.set_column(at, batch.schema.field(at), pa.array(left, batch.schema.field(at).type))


def _buckets(keyed: DataFrame) -> DataFrame:
    spark = keyed.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "key").sortWithinPartitions("key", "line")


def line_groups(rows: DataFrame, distinct: DataFrame, bits: DataFrame, similarity: float, ranks: np.ndarray) -> DataFrame:
    """node, component: hashes of normalised lines that are in a group with another one.

    `rows` has row_id and text; `distinct` the distinct lines, each with a row (`place.row_id`) that has it;
    `bits` fingerprints of the lines; `ranks` how frequent pairs of words are.
    """
    parts = PARTS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = rows.select("text").mapInArrow(_posted(similarity, ranks, parts), "part int, keys binary, lines binary, marks binary")
    met = stored(posted.groupBy("part").applyInArrow(_met(similarity), MET).distinct(), "met-lines")
    tops = met.filter("chunk > 0").groupBy("key").agg(F.max("chunk").alias("top"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("top", F.lit(0).cast("long")))).alias("other")
    dealt = (met.join(tops, "key", "left").select("key", "line", "mark", "chunk", other)
             .select(F.when((F.col("chunk") == 0) & (F.col("other") == 0), F.col("key"))
                     .otherwise(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other"))).alias("key"),
                     "line", "mark", F.signum(F.col("chunk") - F.col("other")).cast("long").alias("side")))
    bits = bits.groupBy("line").agg(*[F.first(c).alias(c) for c in BIT_WORDS])
    near = stored(_buckets(dealt.join(bits, "line")).mapInArrow(_near(similarity), NEAR), "near-lines")
    dropped(met)
    ends = stored(near.select("line").distinct(), "line-ends")
    readers = Bitmap.of(distinct.join(ends, "line").select("place.row_id"), "row_id")
    words = (rows.mapInArrow(_words_of_lines(Bitmap.of(ends, "line"), readers), "line long, words binary")
             .groupBy("line").agg(F.first("words").alias("words")))
    words = stored(words.join(ends, "line", "left_semi"), "line-words")
    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct()
        for c in ("a", "b"):
            both = both.join(words.select(F.col("line").alias(c), F.col("words").alias(f"words_{c}")), c)
        return stored(both.mapInArrow(_linked(similarity), EDGES), "line-links")

    first = linked(near.select(F.least("line", "other").alias("a"), F.greatest("line", "other").alias("b")))
    groups = components(first)
    named = near.join(groups.withColumnRenamed("node", "line"), "line", "left").withColumn("known", F.coalesce("component", "line"))
    open_ = (named.groupBy("key").agg(F.min("known").alias("least"), F.max("known").alias("most"), F.count(F.lit(1)).alias("n"))
             .filter("least <> most").select("key", "n"))
    rest = stored(named.join(open_, "key").select("key", "line", "mark", "side", *BIT_WORDS, "known", "n"), "open-lines")
    dropped(near, ends)
    links = linked(_buckets(rest.filter(F.col("n") <= PAIRED)).mapInArrow(_apart(similarity), EDGES))
    large = rest.filter(F.col("n") > PAIRED).drop(*BIT_WORDS, "n").join(words, "line")
    more = stored(_buckets(large).mapInArrow(_settle(similarity), EDGES), "line-links")
    dropped(words, rest)
    after = links.union(more)
    return groups if after.isEmpty() else components(first.union(after))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                removed_col: str = "lines_removed", lines_col: str = "lines_in") -> DataFrame:
    """The documents without the lines that are in a group with an earlier one, and how many lines went.

    `lines_col` counts the lines that took part. A text that had all its lines removed is
    empty; null texts stay null. Only texts that lose lines are shuffled.
    """
    if not SIMILARITY <= similarity <= 1:
        raise ValueError(f"blocks are made for similarities from {SIMILARITY} to 1")
    id_type = docs.schema[id_col].dataType
    docs = docs.drop(removed_col, lines_col)
    own = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc"), own.alias("row_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc", id_type), *[T.StructField(c, T.LongType()) for c in OCCURRENCES[1:-1]],
                           T.StructField("counts", T.BinaryType())])
    kept = stored(rows.mapInArrow(_occurrences, schema), "occurrences")
    seen = kept.filter("cells is null").select(*OCCURRENCES[:4])
    place = F.struct("doc", "row_id", "number")
    distinct = stored(seen.groupBy("line").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n")), "distinct-lines")
    bits = kept.filter(f"{BIT_WORDS[0]} is not null").select("line", *BIT_WORDS)
    groups = line_groups(rows.select("row_id", "text"), distinct, bits, similarity, pair_ranks(kept))
    named = distinct.join(groups, distinct["line"] == groups["node"], "left")
    best = named.filter("component is not null").groupBy("component").agg(F.min("place").alias("keep"))
    # Lines of which some occurrence goes, with the one place of their group that stays.
    going = (named.filter("component is not null or n > 1").join(best, "component", "left")
             .select("line", F.coalesce("keep", "place").alias("keep")))
    gone = (seen.join(going, "line")
            .filter((F.col("row_id") != F.col("keep.row_id")) | (F.col("number") != F.col("keep.number")))
            .groupBy("row_id").agg(F.collect_set("number").alias("__gone")))
    gone = stored(gone.withColumnRenamed("row_id", "__row"), "gone-lines")
    dropped(kept, distinct)
    changed = Bitmap.of(gone, "__row")
    text = F.col(text_col).cast("string")
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col], own.alias("__row"),
                        text.alias("__text"), F.lit(None).cast("long").alias("__in"))
    same = plain.mapInArrow(_counted(changed, False), plain.schema).withColumn("__gone", F.lit(None).cast("array<bigint>"))
    less = plain.mapInArrow(_counted(changed, True), plain.schema).join(gone, "__row", "left").select(same.columns)
    done = same.union(less.mapInArrow(_without, less.schema))
    return done.select(*[F.col("__text" if c == text_col else f"c{i}").alias(c) for i, c in enumerate(docs.columns)],
                       F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias(removed_col),
                       F.col("__in").alias(lines_col))
