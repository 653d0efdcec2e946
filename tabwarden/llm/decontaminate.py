"""Benchmark passages in training texts, found by spaced seeds and verified with substitutions.

A seed is a window of tokens of which a fixed mask reads some and ignores the others. Two
passages that differ in ignored places have one seed hash, so a few replaced words do not
hide a passage: of any WINDOW tokens in a row with up to MISMATCHES replaced, at least one
mask has a hit (tests/llm try all placements). A hit names a document, an item and a
diagonal; there the tokens are compared one by one, and the passage is confirmed when a
window of WINDOW tokens (the whole item if it is shorter) agrees in all but MISMATCHES
(one in six for short items). Items with fewer than MIN_TOKENS tokens are not searched.

Tokens are runs of letters and digits, in lower case. Test hashes reach the tasks as a
filter of bits whose size no input changes; what passes it is joined
exactly, so a full filter costs time and loses nothing. The join is salted by document:
a passage in a third of all documents is split over SALT tasks.

Defined results: null and empty texts have no passages; equal items (by their tokens)
count as the one with the least id; a document has one row for each such item it holds,
rows that repeat id and text count once, documents with no passage have none; null ids
are kept.
Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import batches as B
from .bitmaps import Bitmap, has
from .language import _tables
from .pieces import LETTER, NUMBER, classes, code_points
from .stored import stored

B.ship(__name__)

#: Places of a window that a seed reads.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 5, 6), (0, 1, 2, 5, 7), (0, 3, 4, 6, 7))
WINDOW = 13
MISMATCHES = 2
MIN_TOKENS = 5
SALT = 16


def token_hashes(texts: B.Texts) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every token, and the text it is in."""
    _, lower = _tables()
    points, lead = code_points(texts.data)
    m = len(points)
    if not m:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = classes()[points]
    inside = (kind == LETTER) | (kind == NUMBER)
    edge = np.zeros(m + 1, bool)
    edge[np.searchsorted(lead, texts.offsets)] = True
    first = inside & edge[:m]
    first[1:] |= inside[1:] & ~inside[:-1]
    last = inside & edge[1:]
    last[:-1] |= inside[:-1] & ~inside[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    low = lower[points].astype(np.uint64) + np.uint64(1)
    up, down, _ = B._powers(m + 1)
    prefix = np.zeros(m + 1, np.uint64)
    np.cumsum(B.mixed(low) * up[:m], out=prefix[1:], dtype=np.uint64)
    hashes = B.mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(texts.offsets, lead[start], "right") - 1


def seeds(hashes: np.ndarray, text: np.ndarray, mask: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """A mask's seed hashes and their first tokens, within one text each."""
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(n, salt + 1, np.uint64)
    for k, place in enumerate(mask):
        total = B.mixed(total + hashes[place : place + n] * np.uint64(2 * k + 3))
    at = np.flatnonzero(text[:n] == text[mask[-1] :])
    return total[at], at


def _items(batches):
    for rows, texts in B.slices(batches, "text"):
        hashes, text = token_hashes(texts)
        count = np.bincount(text, minlength=rows.num_rows)
        ends = np.concatenate([[0], np.cumsum(count)])
        yield pa.RecordBatch.from_arrays(
            [rows.column("item"), pa.array(count), B.binary_rows(np.ascontiguousarray(hashes).view(np.uint8), ends * 8)],
            ["item", "n_tokens", "tokens"])


def _item_seeds(batches):
    for batch in batches:
        values = B.texts_of(batch.column("tokens"))
        hashes = np.frombuffer(values.data.tobytes(), np.uint64)
        text = np.searchsorted(values.offsets // 8, np.arange(len(hashes)), "right") - 1
        first = values.offsets // 8
        for k, mask in enumerate(MASKS):
            seed, at = seeds(hashes, text, mask, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(seed.view(np.int64)), batch.column("passage").take(pa.array(text[at])),
                 pa.array((at - first[text[at]]).astype(np.int32))], ["seed", "passage", "item_at"])


def _searcher(wanted: Bitmap):
    """Rows of the documents with hits (tokens), and rows of the hits (seed, doc_at)."""
    def run(batches):
        opened = wanted.opened()
        for rows, texts in B.slices(batches, "text"):
            hashes, text = token_hashes(texts)
            first = np.searchsorted(text, np.arange(rows.num_rows + 1))
            found_seed, found_at = [], []
            for k, mask in enumerate(MASKS):
                seed, at = seeds(hashes, text, mask, k)
                hit = has(opened, seed)
                found_seed.append(seed[hit])
                found_at.append(at[hit])
            seed, at = np.concatenate(found_seed), np.concatenate(found_at)
            if not len(at):
                continue
            owner = text[at]
            docs = np.unique(owner)
            own = pa.array(docs)
            count = first[docs + 1] - first[docs]
            data = B.gathered(hashes, first[docs], count)
            ends = np.concatenate([[0], np.cumsum(count)]) * 8
            none = pa.nulls(len(docs), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc").take(own), rows.column("row_id").take(own),
                 B.binary_rows(np.ascontiguousarray(data).view(np.uint8), ends), none, pa.nulls(len(docs), pa.int32())],
                ["doc", "row_id", "tokens", "seed", "doc_at"])
            own = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc").take(own), rows.column("row_id").take(own), pa.nulls(len(at), pa.binary()),
                 pa.array(seed.view(np.int64)), pa.array((at - first[owner]).astype(np.int32))],
                ["doc", "row_id", "tokens", "seed", "doc_at"])

    return run


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """Start and end in the document, and equal tokens, of what agrees along a diagonal (doc place - item place)."""
    low, high = max(0, diagonal), min(len(doc), diagonal + len(item))
    size = min(WINDOW, len(item))
    if high - low < size:
        return None
    same = doc[low:high] == item[low - diagonal : high - diagonal]
    running = np.concatenate([[0], np.cumsum(same)])
    most = MISMATCHES if size == WINDOW else size // 6
    good = np.flatnonzero(running[size:] - running[:-size] >= size - most)
    if not len(good):
        return None
    start, end = int(good[0]), int(good[-1]) + size
    while not same[start]:
        start += 1
    while not same[end - 1]:
        end -= 1
    return low + start, low + end, int(running[end] - running[start])


def _verify(batches):
    for batch in batches:
        doc, item = B.texts_of(batch.column("tokens")), B.texts_of(batch.column("item_tokens"))
        diagonals = batch.column("diagonals").to_pylist()
        best = []
        for k in range(batch.num_rows):
            a = np.frombuffer(doc.data[doc.offsets[k] : doc.offsets[k + 1]].tobytes(), np.uint64)
            b = np.frombuffer(item.data[item.offsets[k] : item.offsets[k + 1]].tobytes(), np.uint64)
            found = [o for d in sorted(diagonals[k]) if (o := overlap(a, b, d))]
            best.append(max(found, key=lambda o: (o[2], -o[0])) if found else None)
        keep = pa.array([k for k, o in enumerate(best) if o], pa.int64())
        found = [o for o in best if o]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).take(keep) for c in ("doc", "row_id", "passage", "n_tokens")]
            + [pa.array([o[j] for o in found], pa.int64()) for j in range(3)],
            ["doc", "row_id", "passage", "n_tokens", "start", "end", "n_equal"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and passage of the benchmark in it.

    Columns: the document's id, row_id (a hash of its id and text), the least item id of the passage, n_items (with these tokens), n_tokens of the item, and where the
    best overlap starts and ends in the document's tokens, n_equal of which are equal.
    """
    id_type, item_type = docs.schema[id_col].dataType, benchmark.schema[item_id_col].dataType
    items = benchmark.select(F.col(item_id_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    item_schema = T.StructType([T.StructField("item", item_type), T.StructField("n_tokens", T.LongType()),
                                T.StructField("tokens", T.BinaryType())])
    passages = (items.mapInArrow(_items, item_schema).filter(F.col("n_tokens") >= MIN_TOKENS)
                .groupBy("tokens", "n_tokens").agg(F.min("item").alias("passage"), F.count(F.lit(1)).alias("n_items")))
    passages = stored(passages, "passages")
    seed_schema = T.StructType([T.StructField("seed", T.LongType()), T.StructField("passage", item_type),
                                T.StructField("item_at", T.IntegerType())])
    seeds_of_items = stored(passages.mapInArrow(_item_seeds, seed_schema), "seeds")
    search = _searcher(Bitmap.of(seeds_of_items, "seed"))
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_id"),
                       F.col(text_col).cast("string").alias("text"))
    hit_schema = T.StructType([T.StructField("doc", id_type), T.StructField("row_id", T.LongType()),
                               T.StructField("tokens", T.BinaryType()), T.StructField("seed", T.LongType()),
                               T.StructField("doc_at", T.IntegerType())])
    found = stored(rows.mapInArrow(search, hit_schema), "hits")
    hits = found.filter("seed is not null").withColumn("salt", (F.abs(F.hash("row_id")) % SALT).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    salted = seeds_of_items.select("*", salts)
    pairs = (hits.join(salted, ["seed", "salt"]).groupBy("row_id", "passage", "salt")
             .agg(F.collect_set(F.col("doc_at") - F.col("item_at")).alias("diagonals")))
    texts = found.filter("tokens is not null").select("doc", "row_id", "tokens").dropDuplicates(["row_id"])
    passage_texts = passages.select("passage", "n_tokens", F.col("tokens").alias("item_tokens"), salts)
    both = pairs.join(passage_texts, ["passage", "salt"]).join(texts, "row_id")
    out_schema = T.StructType([T.StructField("doc", id_type), T.StructField("row_id", T.LongType()),
                               T.StructField("passage", item_type),
                               *[T.StructField(c, T.LongType()) for c in ("n_tokens", "start", "end", "n_equal")]])
    sure = both.select("doc", "row_id", "passage", "n_tokens", "item_tokens", "tokens", "diagonals").mapInArrow(_verify, out_schema)
    named = sure.join(passages.select("passage", "n_items"), "passage")
    return named.select(F.col("doc").alias(id_col), "row_id", F.col("passage").alias(item_id_col), "n_items", "n_tokens",
                        "start", "end", "n_equal")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """The documents without a passage of the benchmark."""
    found = contaminated(docs, benchmark, id_col, text_col, **columns).select(F.col("row_id").alias("__row")).distinct()
    keyed = docs.withColumn("__row", F.xxhash64(F.col(id_col), F.col(text_col)))
    return keyed.join(found, "__row", "left_anti").drop("__row")
