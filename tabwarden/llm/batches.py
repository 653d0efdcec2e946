"""Texts of an Arrow batch as byte arrays: slices, words and their hashes, without a Python object per word."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

SLICE_BYTES = 2 << 20


def ship(name: str) -> None:
    """Send the functions of a module with the tasks that use them; executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, shared by the tasks it runs."""
    holder = sys.modules.setdefault("_tabwarden_llm_cache", types.ModuleType("_tabwarden_llm_cache"))
    return holder.__dict__.setdefault(name, {})


#: Tables of fixed size, which several operators use.
FIXED = ("powers", "classes", "scripts")


def keep_only(*names: str) -> None:
    """Empty what this worker keeps for other operators: it lives on from one stage of a job to the next."""
    holder = sys.modules.get("_tabwarden_llm_cache")
    for name, held in vars(holder).items() if holder else ():
        if isinstance(held, dict) and name not in (*names, *FIXED):
            held.clear()
    pa.default_memory_pool().release_unused()


class Texts(NamedTuple):
    """Bytes of several texts in a row; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Words in text order: byte positions, and the text each is in."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray


def texts_of(column: pa.Array) -> Texts:
    """The texts of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(raw[at[0] : at[-1]], at - at[0])


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, keep: tuple[str, ...] = ()
           ) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Rows with their texts, at most `limit` bytes of text at a time; a longer text comes alone.

    Of the worker's caches those in `keep` stay, and the fixed ones.
    """
    keep_only(*keep)
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = texts_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(texts.offsets, texts.offsets[at] + limit, "right")) - 1
            upto = min(max(upto, at + 1), batch.num_rows)
            own = texts.offsets[at : upto + 1]
            yield batch.slice(at, upto - at), Texts(texts.data[own[0] : own[-1]], own - own[0])
            at = upto


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def spaces(data: np.ndarray) -> np.ndarray:
    """Where the bytes \\x20 and \\x09 to \\x0D stand."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def words_of(texts: Texts) -> Words:
    """Runs of bytes other than \\x20 and \\x09 to \\x0D, none across two texts."""
    n = len(texts.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none)
    gap = np.empty(n + 1, bool)
    gap[:n] = spaces(texts.data)
    gap[n] = True
    edge = np.zeros(n + 1, bool)
    edge[texts.offsets] = True
    solid = ~gap[:n]
    first = edge[:n].copy()
    first[1:] |= gap[: n - 1]
    start = np.flatnonzero(solid & first)
    end = np.flatnonzero(solid & (gap[1:] | edge[1:])) + 1
    return Words(start, end, np.searchsorted(texts.offsets, start, "right") - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, and a random number for each byte value."""
    held = worker_cache("powers")
    if held.get("n", 0) < n:
        base = 0x9E3779B97F4A7C13
        size = max(n, SLICE_BYTES + 1)
        for key, value in (("up", base), ("down", pow(base, -1, 1 << 64))):
            steps = np.full(size, value, np.uint64)
            steps[0] = 1
            held[key] = np.cumprod(steps, dtype=np.uint64)
        held["byte"] = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        held["n"] = size
    return held["up"], held["down"], held["byte"]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]: equal bytes, equal hash, wherever they stand."""
    n = len(data)
    up, down, byte = _powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(byte[data] * up[:n], out=prefix[1:], dtype=np.uint64)
    return mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of `size` successive numbers; len(hashes) - size + 1 of them."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = mixed(total + hashes[k : k + n] * np.uint64(2 * k + 3))
    return total


def gathered(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start[0]:start[0] + length[0]], then the next such run, and so on, in one array."""
    total = int(length.sum())
    if not total:
        return values[:0]
    out_start = np.cumsum(length) - length
    return values[np.repeat(start - out_start, length) + np.arange(total)]


def count_by_text(text: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """How many (or how much weight) of the words each text has."""
    return np.bincount(text, weights, minlength=n).astype(np.int64)


def binary_rows(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over bytes that already lie in a row."""
    if len(data) >= 1 << 31:
        raise ValueError("a slice of texts must stay below 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
