"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

Words are maximal runs of A-Z, a-z and the letters U+00C0 to U+00FF, A-Z lowered. Candidates
meet in buckets, and a bucket's words are laid out as two padded matrices of code points, one
flush left and one flush right. Two words whose common prefix and common suffix together
reach the longer length less one are a single edit apart, and no others are.

Buckets are exact. Let L be the longer length, c = ceil(2 (L - 1) / 3), a the common prefix
and b the common suffix. Of two near words either a >= c, or b >= c, or both are at least
L - c; so each word is posted under its first c, its last c, and its first and last L - c
code points, for L its own length and one more. A pair counts in the first of the three
kinds that holds, hence once. A bucket of more than TILE words, or of TILE_BYTES of text, is
dealt into blocks, and every pair of blocks is a tile of its own, on any executor; a tile sends
one row for each of its words that has a near one: how many, and the best of them.

Defined results: null and empty texts hold no words; a null doc_id counts as an empty text
where hashes take it; repeated rows count as often as they stand; ties go to the smallest word
in code-point order; an empty table gives no rows; further columns are ignored. A word of
any length is whole; only its own bytes bound what a task holds for it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .batches import Texts, binary_rows, gathered, lowered, ship, slices
from .stored import dropped, stored

ship(__name__)

MIN_LENGTH = 7          # code points
MIN_COUNT = 2           # occurrences in all texts
FORM_RATIO = 10         # a form occurs at least so many times as often
THINNED = 31            # one of so many (document, run) pairs loses a code point
TILE = 2048             # words in a block
TILE_BYTES = 4 << 20    # bytes in a block
CHUNK_CELLS = 16 << 20  # cells of a matrix
SLICE = 4 << 20
LONG_RUN = 64           # bytes from which a run is hashed by itself


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


def crc_on(prefix: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of prefix text and data[start:start + length], given each prefix text's own crc32."""
    out = np.empty(len(start), np.uint32)
    order = np.argsort(-length, kind="stable")
    n_long = int((length > LONG_RUN).sum())
    for i in order[:n_long]:
        out[i] = zlib.crc32(data[start[i] : start[i] + length[i]].tobytes(), int(prefix[i]))
    order = order[n_long:]
    state, at, left = ~prefix[order], start[order], length[order]
    table = _crc_table()
    for k in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -k, "left"))     # those longer than k
        own = state[:live]
        state[:live] = table[(own ^ data[at[:live] + k]) & np.uint32(255)] ^ (own >> np.uint32(8))
    out[order] = ~state
    return out


def thinned_runs(texts: Texts, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some texts as one row of code points, and where each word ends.

    prefix: crc32 of each text's `<doc_id>:`. Words that stay below MIN_LENGTH are left out.
    """
    data = lowered(texts.data)
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[texts.offsets] = True
    lead = np.zeros(n, bool)
    lead[:-1] = (data[:-1] == 0xC3) & ((data[1:] & 0xC0) == 0x80) & ~edge[1:n]
    follows = np.zeros(n, bool)
    follows[1:] = lead[:-1]
    solid = ((data >= 97) & (data <= 122)) | lead | follows
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    place = np.zeros(n + 1, np.int64)                      # of each byte among code points
    np.cumsum(~lead, out=place[1:])
    length = place[end] - place[start]
    long = length >= MIN_LENGTH
    start, end, length = start[long], end[long], length[long]
    owner = np.searchsorted(texts.offsets, start, "right") - 1
    crc = crc_on(prefix[owner], data, start, end - start)
    hit = crc % THINNED == 0
    at = (crc % length.astype(np.uint32)).astype(np.int64)
    enough = length - hit >= MIN_LENGTH
    start, length, hit, at = start[enough], length[enough], hit[enough], at[enough]
    points = np.where(follows, (data & 0x3F) | 0xC0, data)[~lead]
    flat = gathered(points, place[start], length)
    flat = np.delete(flat, (np.cumsum(length) - length)[hit] + at[hit])
    return flat, np.cumsum(length - hit)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in slices(batches, "text", SLICE):
        ids = rows.column("id").to_pylist()
        prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
        flat, ends = thinned_runs(texts, prefix)
        if len(ends):
            found = binary_rows(flat, np.concatenate([[0], ends])).value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word (code points as bytes), n: the words of at least MIN_COUNT occurrences."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.col(text_col).alias("text")).filter("text is not null")
    counted = rows.mapInArrow(_counted, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def postings(words: DataFrame) -> DataFrame:
    """Each word in its six buckets: longer (the longer length of a pair), kind, bucket."""
    length = F.length("word")
    longer = F.explode(F.array(length, length + 1)).alias("longer")
    spread = words.select("word", "n", longer)
    c = F.ceil(2 * (F.col("longer") - 1) / 3).cast("int")
    m = (F.col("longer") - c).cast("int")

    def first(k: Column) -> Column:
        return F.substring(F.col("word"), F.lit(1), k)

    def final(k: Column) -> Column:
        return F.substring(F.col("word"), (F.length("word") - k + 1).cast("int"), k)

    parts = F.array(F.struct(F.lit(0).alias("kind"), first(c).alias("x"), F.lit(b"").alias("y")),
                    F.struct(F.lit(1).alias("kind"), F.lit(b"").alias("x"), final(c).alias("y")),
                    F.struct(F.lit(2).alias("kind"), first(m).alias("x"), final(m).alias("y")))
    return (spread.select("word", "n", "longer", F.explode(parts).alias("p"))
            .select("word", "n", "longer", "p.kind", F.xxhash64("longer", "p.kind", "p.x", "p.y").alias("bucket")))


def tiles(posted: DataFrame, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Postings with the tile (i, j) of their bucket and the block they are of."""
    blocks = F.ceil(F.greatest(F.col("m") / tile, F.col("bytes") / tile_bytes)).cast("int")
    heavy = (posted.groupBy("bucket").agg(F.count("*").alias("m"), F.sum(F.length("word")).alias("bytes"))
             .select("bucket", blocks.alias("blocks")).filter("blocks > 1"))
    dealt = (posted.join(heavy, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")))
    return (dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("longer", "kind", "bucket", F.least("block", "other").alias("i"),
                    F.greatest("block", "other").alias("j"), "block", "word", "n"))


TILE_KEY = ["longer", "kind", "bucket", "i", "j"]


class Sheet:
    """Words of some tiles, tile by tile, as padded matrices."""

    def __init__(self, rows: pa.Table):
        self.words = rows.column("word").combine_chunks()
        texts = texts_of_binary(self.words)
        self.length = np.diff(texts.offsets)
        self.n = rows.column("n").to_numpy()
        self.longer = rows.column("longer").to_numpy()
        self.kind = rows.column("kind").to_numpy()
        self.block = rows.column("block").to_numpy()
        self.crossed = rows.column("i").to_numpy() != rows.column("j").to_numpy()
        width = int(self.length.max())
        at = np.arange(width)
        self.flush_left = np.zeros((len(self.length), width), np.uint8)
        self.flush_left[at < self.length[:, None]] = texts.data
        self.flush_right = np.zeros_like(self.flush_left)
        self.flush_right[at >= width - self.length[:, None]] = texts.data
        borders = borders_of(rows)
        size = np.diff(np.append(borders, len(self.n)))
        self.after = np.repeat(borders + size, size) - np.arange(len(self.n)) - 1     # rows that follow in the tile
        order = np.lexsort((self.flush_left.view(f"S{width}").ravel(), -self.n))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.order = order

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of the pairs of rows are one edit apart and count here."""
        longest, shortest = np.maximum(self.length[x], self.length[y]), np.minimum(self.length[x], self.length[y])
        prefix = agreeing(self.flush_left[x] == self.flush_left[y], shortest)
        suffix = agreeing((self.flush_right[x] == self.flush_right[y])[:, ::-1], shortest)
        c = -(-2 * (self.longer[x] - 1) // 3)
        kind = np.where(prefix >= c, 0, np.where(suffix >= c, 1, 2))
        apart = (prefix + suffix >= longest - 1) & ~((longest == shortest) & (prefix == longest))
        return apart & (longest == self.longer[x]) & (kind == self.kind[x])

    def found(self) -> pa.RecordBatch:
        """For each word with a near one: how many, and the commonest."""
        count = np.zeros(len(self.n), np.int64)
        best = np.full(len(self.n), len(self.n), np.int64)
        live, step = np.flatnonzero(self.after > 0), 1
        while len(live):
            for at in range(0, len(live), max(1, CHUNK_CELLS // self.flush_left.shape[1])):
                x = live[at : at + max(1, CHUNK_CELLS // self.flush_left.shape[1])]
                y = x + step
                mixed = ~self.crossed[x] | (self.block[x] != self.block[y])
                x, y = x[mixed], y[mixed]
                hit = self.near(x, y)
                for one, other in ((x[hit], y[hit]), (y[hit], x[hit])):   # a row stands at most once in each
                    count[one] += 1
                    best[one] = np.minimum(best[one], self.rank[other])
            step += 1
            live = live[self.after[live] >= step]
        has = np.flatnonzero(count)
        top = pa.array(self.order[best[has]])
        return pa.RecordBatch.from_arrays(
            [self.words.take(pa.array(has)), pa.array(count[has]), self.words.take(top), pa.array(self.n[top.to_numpy()])],
            ["word", "n_near", "best", "best_n"])


def texts_of_binary(column: pa.Array) -> Texts:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def agreeing(equal: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many cells of each row agree before the first that does not, at most `most`."""
    length = np.where(equal.all(axis=1), equal.shape[1], equal.argmin(axis=1))
    return np.minimum(length, most)


def borders_of(rows: pa.Table) -> np.ndarray:
    """Where a new tile begins."""
    if not rows.num_rows:
        return np.zeros(0, np.int64)
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for name in TILE_KEY:
        values = rows.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles in their sorted order, as many at a time as make a sheet of bounded size."""
    held: list[pa.RecordBatch] = []
    cells = 0

    def sheets(rows: pa.Table, final: bool) -> Iterator[pa.Table]:
        borders = borders_of(rows)
        longer = rows.column("longer").to_numpy()
        cuts = [0]
        for b, nxt in zip(borders, np.append(borders[1:], rows.num_rows)):
            if b > cuts[-1] and (longer[b] != longer[cuts[-1]] or (nxt - cuts[-1]) * int(longer[b]) > CHUNK_CELLS):
                cuts.append(int(b))
        tail = rows.num_rows if final else int(borders[-1])
        for at, upto in zip(cuts, [*cuts[1:], rows.num_rows]):
            upto = min(upto, tail)
            if upto > at:
                yield rows.slice(at, upto - at)
        yield rows.slice(tail)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        cells += batch.num_rows * int(batch.column("longer").to_numpy().max())
        if cells < CHUNK_CELLS:
            continue
        *ready, rest = sheets(pa.Table.from_batches(held), False)
        for rows in ready:
            yield Sheet(rows.combine_chunks()).found()
        held = rest.combine_chunks().to_batches()
        cells = sum(b.num_rows * int(b.column("longer").to_numpy().max()) for b in held)
    if held:
        for rows in list(sheets(pa.Table.from_batches(held), True))[:-1]:
            yield Sheet(rows.combine_chunks()).found()


def near_words(words: DataFrame, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """word, n_near, best_n and best (the near word of largest n, ties to the smallest)."""
    dealt = tiles(postings(words), tile, tile_bytes)
    found = (dealt.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY, "word")
             .mapInArrow(_compared, "word binary, n_near long, best binary, best_n long"))
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", (-F.col("b.minus")).alias("best_n"), "b.best"))


def roots_of(forms: DataFrame, most: int) -> DataFrame:
    """word, root: where the chain of forms that starts at a word ends.

    Each link multiplies n by FORM_RATIO, so a chain has no more links than `most`, the
    largest n, has digits; each round doubles how far a word has come.
    """
    far = stored(forms.select("word", F.col("form").alias("root")), "roots")
    reach = 1
    while reach < len(str(most)):
        onward = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(far.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        dropped(far)
        far, reach = further, 2 * reach
    return far


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """word, form, root (string), n, n_near, form_n (long): a row for each word."""
    words = stored(vocabulary(docs, id_col, text_col), "words")
    near = near_words(words, tile, tile_bytes)
    common = F.col("best_n") >= FORM_RATIO * F.col("n")
    judged = stored(words.join(near, "word", "left")
                    .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                            F.when(common, F.col("best")).alias("form"), F.when(common, F.col("best_n")).alias("form_n")), "near")
    most = words.agg(F.max("n")).first()[0] or 0
    roots = roots_of(judged.filter("form is not null"), most)

    def shown(name: str) -> Column:
        return F.decode(F.col(name), "ISO-8859-1").alias(name)

    return (judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
            .select(shown("word"), shown("form"), shown("root"), "n", "n_near", "form_n"))
