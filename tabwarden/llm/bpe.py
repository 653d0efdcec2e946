"""Byte-level BPE as a monoid: encode halves, join neighbours by re-encoding a growing window.

Two encodings are joined by encoding anew the bytes of the k tokens on either side of
their boundary, for k = 1, 2, 4, ... The join is done when the token before the window
and the window's first token, encoded together, come out as those two tokens, and
likewise at the window's end. That is proof enough: a sequence of tokens is the encoding
of its bytes when each two neighbours are the encoding of theirs. (Take the first merge
across a token boundary. Until then both neighbours have merged as they do alone, so the
same merge would come first across that boundary in the two alone.)

The empty encoding is the unit, so texts can be cut anywhere and joined in any grouping.
Decoding concatenates up the same tree.

Defined results: null texts are empty ones and have no ids; an id outside the vocabulary
is an error when decoding. Repeated rows and rows in any order keep their columns, an
empty table gives an empty one. The columns made replace columns of the same names.
"""

from __future__ import annotations

import base64
import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import batches as B
from .pieces import encoded_pieces

B.ship(__name__)

LEAF_BYTES = 32
LONG_BYTES = 128
LEAF_IDS = 1 << 16
PIECES = 400_000    # kept with their ids by a worker, some 200 bytes each
PAIRS = 300_000     # kept with whether they stay as they are, some 150 bytes each
NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TreeBpe:
    """Encodes one piece; the ranks are the merge order and the ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.reach: dict[bytes, int] = {}  # the longest token that begins with two given bytes
        for token in ranks:
            self.reach[token[:2]] = max(self.reach.get(token[:2], 1), len(token))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """Tokens of some bytes: the lowest-ranked pair merges first, the leftmost of equals."""
        if len(piece) > LONG_BYTES:
            return self._merged_long(piece)
        rank = self.ranks.get
        tokens = [piece[i : i + 1] for i in range(len(piece))]
        order = [rank(a + b, NONE) for a, b in zip(tokens, tokens[1:])]
        while order:
            least = min(order)
            if least == NONE:
                break
            i = order.index(least)
            tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]
            del order[i]
            if i:
                order[i - 1] = rank(tokens[i - 1] + tokens[i], NONE)
            if i < len(order):
                order[i] = rank(tokens[i] + tokens[i + 1], NONE)
        return tokens

    def _merged_long(self, piece: bytes) -> list[bytes]:
        """The same with a heap of pairs, for windows that had to grow far."""
        n, rank = len(piece), self.ranks.get
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            _, i, upto = heapq.heappop(heap)
            j = following[i] if end[i] else n
            if not end[i] or j >= n or end[j] != upto:
                continue  # one of the two has merged otherwise meanwhile
            end[i], end[j] = upto, 0
            following[i] = k = following[j]
            if k < n:
                previous[k] = i
                if (r := rank(piece[i : end[k]], NONE)) != NONE:
                    heapq.heappush(heap, (r, i, end[k]))
            h = previous[i]
            if h >= 0 and (r := rank(piece[h:upto], NONE)) != NONE:
                heapq.heappush(heap, (r, h, upto))
        return [piece[i : end[i]] for i in range(n) if end[i]]

    def stable(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens stay as they are when they meet."""
        key = (left, right)
        held = self.pairs.get(key)
        if held is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            held = self.pairs[key] = self.merged(left + right) == [left, right]
        return held

    def leaf(self, piece: bytes) -> list[bytes]:
        """Tokens of a short piece: the one way to cut it so that all neighbours are stable."""
        n, ranks = len(piece), self.ranks
        tokens: list[bytes] = []
        reach = self.reach.get
        tried = [n + 1]
        at = 0
        while at < n:
            for size in range(min(tried[-1] - 1, n - at, reach(piece[at : at + 2], 1)), 0, -1):
                token = piece[at : at + size]
                if token in ranks and (not tokens or self.stable(tokens[-1], token)):
                    tried[-1] = size
                    tokens.append(token)
                    tried.append(n + 1)
                    at += size
                    break
            else:
                if not tokens:
                    return self.merged(piece)  # a byte that is no token: the caller reports it
                tried.pop()
                at -= len(tokens.pop())
        return tokens if len(tokens) > 1 else self.merged(piece)

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        if not left or not right:
            return left or right
        k = 1
        while True:
            window = self.merged(b"".join(left[-k:] + right[:k]))
            before, after = left[:-k], right[k:]
            if ((not before or self.stable(before[-1], window[0]))
                    and (not after or self.stable(window[-1], after[0]))):
                return before + window + after
            k *= 2

    def tree(self, piece: bytes) -> list[bytes]:
        """Halves, joined; lists of tokens are concatenated once a level."""
        if len(piece) <= LEAF_BYTES:
            return self.leaf(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def encode(self, piece: bytes) -> list[int]:
        """Ids of a piece. A piece that is a token as a whole is that token."""
        known = self.ranks.get(piece)
        if known is not None:
            return [known]
        return [self.ranks[t] for t in self.tree(piece)]

    def packed(self, pieces: list[bytes]) -> list[bytes]:
        return [array("I", self.encode(p)).tobytes() for p in pieces]


class Decoder:
    """Bytes of id sequences."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = sorted((rank, token) for token, rank in ranks.items())
        size = tokens[-1][0] + 1 if tokens else 0
        self.length = np.full(size, -1, np.int64)
        self.start = np.zeros(size, np.int64)
        at = 0
        for rank, token in tokens:
            self.start[rank], self.length[rank] = at, len(token)
            at += len(token)
        self.data = np.frombuffer(b"".join(token for _, token in tokens), np.uint8)

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and (int(ids.max()) >= len(self.length) or self.length[ids].min() < 0):
            raise ValueError("an id is not in the vocabulary")
        return self.length[ids]

    def leaf(self, ids: np.ndarray) -> np.ndarray:
        return B.gathered(self.data, self.start[ids], self.lengths(ids))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """A short sequence at once, a long one half by half."""
        if len(ids) <= LEAF_IDS:
            return self.leaf(ids)
        half = len(ids) // 2
        return np.concatenate([self.decode(ids[:half]), self.decode(ids[half:])])


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], values], [*names, name])


def _schema(df: DataFrame, name: str, kind: str):
    return df.drop(name).withColumn(name, F.lit(None).cast(kind)).schema


def _encoder(ranks: dict[bytes, int], vocab: str, text_col: str, ids_col: str):
    def run(batches):
        own = (f"bpe {vocab}", f"bpe tree {vocab}")
        decoder, known, held = Decoder(ranks), *map(B.worker_cache, own)
        if "tree" not in held:
            held["tree"] = TreeBpe(ranks)
        bpe = held["tree"]
        for rows, texts in B.slices(batches, text_col, keep=own):
            ids, count = encoded_pieces(texts, known, bpe.packed, PIECES)
            if not np.array_equal(decoder.decode(ids), texts.data):
                raise ValueError("ids do not decode to their texts")  # two pieces with one 64-bit hash
            ends = np.concatenate([[0], np.cumsum(count)]) * 4
            yield _with_column(rows, ids_col, B.binary_rows(np.ascontiguousarray(ids, "<u4").view(np.uint8), ends))

    return run


def _decoder(ranks: dict[bytes, int], ids_col: str, out_col: str):
    def run(batches):
        decoder = Decoder(ranks)
        for batch in batches:
            values = B.texts_of(batch.column(ids_col).fill_null(b""))
            ids = np.frombuffer(values.data.tobytes(), "<u4")
            ends = np.concatenate([[0], np.cumsum(decoder.lengths(ids))])[values.offsets // 4]
            yield _with_column(batch, out_col, B.binary_rows(decoder.decode(ids), ends))

    return run


def encode(docs: DataFrame, vocab: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the ids of each text, as little-endian unsigned 32-bit numbers in one binary value.

    `vocab` is the path of a rank file, read on the driver and sent along. Rows stay
    where they are: nothing is shuffled. `id_arrays` turns the values into arrays.
    """
    return docs.mapInArrow(_encoder(read_ranks(vocab), vocab, text_col, ids_col), _schema(docs, ids_col, "binary"))


def decode(df: DataFrame, vocab: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the bytes that the ids of `encode` stand for."""
    return df.mapInArrow(_decoder(read_ranks(vocab), ids_col, out_col), _schema(df, out_col, "binary"))


def round_trip(docs: DataFrame, vocab: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`encode`, then `decode` in place of the texts, in one pass through one Python worker a task."""
    ranks = read_ranks(vocab)
    to_ids, to_bytes = _encoder(ranks, vocab, text_col, ids_col), _decoder(ranks, ids_col, out_col)

    def run(batches):
        for batch in to_bytes(to_ids(batches)):
            yield batch.drop_columns([text_col])

    schema = docs.drop(text_col, ids_col, out_col).withColumns(
        {ids_col: F.lit(None).cast("binary"), out_col: F.lit(None).cast("binary")}).schema
    return docs.mapInArrow(run, schema)


def id_arrays(df: DataFrame, ids_col: str = "ids") -> DataFrame:
    """The binary ids as an array of numbers, under the same name."""
    def run(batches):
        for batch in batches:
            values = B.texts_of(batch.column(ids_col).fill_null(b""))
            ids = np.frombuffer(values.data.tobytes(), "<u4").astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array((values.offsets // 4).astype(np.int32)), pa.array(ids))
            yield _with_column(batch, ids_col, lists)

    return df.mapInArrow(run, _schema(df, ids_col, "array<long>"))
