"""Token ids in files of directly addressable codes: any id can be read without decoding a block.

An id is cut into chunks of CHUNK_BITS bits, lowest first. Level 0 has the lowest chunk of
every id, level 1 the next chunk of those ids that have one, and so on. Each level has a
bitmap that says which of its chunks go on in the next level, and a rank directory: for
each block of RANK_BITS bits, how many bits are set before it. So chunk i of a level goes
on at place rank(i) of the next level: a directory entry and a few popcounts.

A file holds the ids of successive documents. Its layout, all numbers little-endian:

    8 bytes    the magic "TWDAC001"
    4 x u64    documents, ids, levels, chunk bits
    documents  x i64   document ids;  x u8  1 where the id is null
    documents+1 x u64  place of each document's first id, and the number of ids
    levels     times:  u64 n;  n chunks of u8;  ceil(n/512) x u64 of directory;
                       ceil(n/512) x 64 bytes of bitmap (bit k of byte j is chunk 8*j+k)

Files are numbered by ascending document id.

Defined results: a null text has the end id alone; null document ids come first, equal
ones stand in the order of a hash of their texts, each row a document of its own; an
empty table writes no file. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import batches as B
from .pieces import encoded_pieces
from .stored import shared_path, stored

B.ship(__name__)

MAGIC = b"TWDAC001"
CHUNK_BITS = 8
RANK_BITS = 512
FILE_IDS = 16 << 20


class DacLevel:
    """Chunks of one level, with the bitmap of those that go on and its rank directory."""

    def __init__(self, chunks: np.ndarray, bitmap: np.ndarray, directory: np.ndarray):
        self.chunks, self.bitmap, self.directory = chunks, bitmap, directory

    @classmethod
    def build(cls, chunks: np.ndarray, goes_on: np.ndarray) -> DacLevel:
        blocks = -(-len(chunks) // RANK_BITS)
        bits = np.zeros(blocks * RANK_BITS, bool)
        bits[: len(chunks)] = goes_on
        ones = bits.reshape(-1, RANK_BITS).sum(1) if blocks else np.zeros(0, np.int64)
        return cls(chunks, np.packbits(bits, bitorder="little"), (np.cumsum(ones) - ones).astype("<u8"))

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place: the directory, and popcounts within the block."""
        block = at // RANK_BITS
        words = self.bitmap.view("<u8").reshape(-1, RANK_BITS // 64)[block]
        inside = at % RANK_BITS
        left = np.clip(inside[:, None] - 64 * np.arange(RANK_BITS // 64), 0, 64).astype(np.uint64)
        mask = np.where(left >= 64, ~np.uint64(0), (np.uint64(1) << (left & np.uint64(63))) - np.uint64(1))
        return self.directory[block].astype(np.int64) + np.bitwise_count(words & mask).sum(1).astype(np.int64)


class DacFile:
    """The ids of some documents; `ids_at` reads any of them directly."""

    def __init__(self, doc_ids: np.ndarray, null: np.ndarray, starts: np.ndarray, levels: list[DacLevel]):
        self.doc_ids, self.null, self.starts, self.levels = doc_ids, null, starts, levels

    @classmethod
    def build(cls, doc_ids, null, counts, ids: np.ndarray) -> DacFile:
        levels, rest = [], np.asarray(ids, np.uint32)
        while True:
            more = rest >> np.uint32(CHUNK_BITS)
            levels.append(DacLevel.build((rest & np.uint32((1 << CHUNK_BITS) - 1)).astype(np.uint8), more > 0))
            rest = more[more > 0]
            if not len(rest):
                break
        starts = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
        return cls(np.asarray(doc_ids, "<i8"), np.asarray(null, np.uint8), starts, levels)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.doc_ids), int(self.starts[-1]), len(self.levels), CHUNK_BITS], "<u8")
        parts = [MAGIC, head.tobytes(), self.doc_ids.tobytes(), self.null.tobytes(), self.starts.tobytes()]
        for level in self.levels:
            parts += [np.uint64(len(level.chunks)).tobytes(), level.chunks.tobytes(),
                      level.directory.astype("<u8").tobytes(), level.bitmap.tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> DacFile:
        if raw[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        docs, _, n_levels, bits = np.frombuffer(raw, "<u8", 4, 8).astype(np.int64).tolist()
        if bits != CHUNK_BITS:
            raise ValueError(f"chunks of {bits} bits are not supported")
        at = 40

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        doc_ids, null, starts = take("<i8", docs), take("u1", docs), take("<u8", docs + 1)
        levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            chunks, blocks = take("u1", n), -(-n // RANK_BITS)
            directory = take("<u8", blocks)
            bitmap = take("u1", blocks * RANK_BITS // 8)
            levels.append(DacLevel(chunks, bitmap.copy(), directory))
        return cls(doc_ids, null, starts, levels)

    def ids_at(self, at) -> np.ndarray:
        """The ids at any places, each by at most one rank a level."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        live = np.arange(len(at))
        for k, level in enumerate(self.levels):
            out[live] |= level.chunks[at].astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            on = level.bit(at)
            live, at = live[on], at[on]
            if not len(live):
                break
            at = level.rank(at)
        return out

    def all_ids(self) -> np.ndarray:
        """All ids in order: the same, with one running rank for each level."""
        out = self.levels[0].chunks.astype(np.uint32)
        live = np.arange(len(out))
        for k in range(1, len(self.levels)):
            before = self.levels[k - 1]
            bits = np.unpackbits(before.bitmap, bitorder="little")[: len(before.chunks)].astype(bool)
            live = live[bits]
            out[live] |= self.levels[k].chunks.astype(np.uint32) << np.uint32(CHUNK_BITS * k)
        return out


def byte_letters() -> str:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else 256 and on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in printable else chr(next(spare)) for b in range(256))


def _tokenizer(vocabulary: str):
    from tokenizers import Tokenizer

    held = B.worker_cache("tokenizers")
    if vocabulary not in held:
        held[vocabulary] = Tokenizer.from_str(vocabulary)
    return held[vocabulary]


def _with_added_tokens(vocabulary: str, texts: B.Texts, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids, but those of texts that hold one of the vocabulary's added tokens by the library's own encoding."""
    names = [t["content"].encode() for t in json.loads(vocabulary).get("added_tokens") or []]
    raw = texts.data.tobytes()
    if not any(name in raw for name in names):
        return ids, count
    parts = np.split(ids, np.cumsum(count)[:-1])
    for i, (low, high) in enumerate(zip(texts.offsets.tolist(), texts.offsets[1:].tolist())):
        own = raw[low:high]
        if any(name in own for name in names):
            parts[i] = np.array(_tokenizer(vocabulary).encode(own.decode(), add_special_tokens=False).ids, np.uint32)
    return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def library_encoder(vocabulary: str) -> Callable[[list[bytes]], list[bytes]]:
    """Encodes pieces with the tokenizers library. Special tokens' strings are ordinary text."""
    model = _tokenizer(vocabulary).model
    letters = {b: c for b, c in enumerate(byte_letters())}

    def encode(pieces):
        return [np.array([t.id for t in model.tokenize(p.decode("latin-1").translate(letters))], "<u4").tobytes()
                for p in pieces]

    return encode


def check_vocabulary(vocabulary: str) -> None:
    """Pieces are encoded one by one; that is the library's result for these settings only."""
    kind = json.loads(vocabulary)
    split = kind.get("pre_tokenizer") or {}
    if (kind.get("normalizer") or kind["model"]["type"] != "BPE" or split.get("type") != "ByteLevel"
            or split.get("add_prefix_space") or not split.get("use_regex", True)):
        raise ValueError("a byte-level BPE without normalizer and prefix space is needed")


def _encoder(vocabulary: str, end_id: int, added_tokens: bool):
    def run(batches):
        encode = library_encoder(vocabulary)
        known = B.worker_cache("pieces of the library")
        for rows, texts in B.slices(batches, "text", keep=("tokenizers", "pieces of the library")):
            ids, count = encoded_pieces(texts, known, encode)
            if added_tokens:
                ids, count = _with_added_tokens(vocabulary, texts, ids, count)
            # Two bytes an id while they fit, so that little is shuffled.
            ends = np.cumsum(count)
            with_end = np.insert(ids, ends, end_id).astype("<u4")
            bounds = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
            small = not len(with_end) or int(with_end.max()) < 1 << 16
            packed = with_end.astype("<u2") if small else with_end
            width = packed.itemsize
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc"), rows.column("tie"), rows.column("file_no"), pa.array(np.full(rows.num_rows, width, np.int32)),
                 B.binary_rows(np.ascontiguousarray(packed).view(np.uint8), bounds * width)],
                ["doc", "tie", "file_no", "width", "ids"])

    return run


def file_system(path: str):
    """The file system of a path that executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _writer(folder: str):
    def run(batches):
        held: list[tuple] = []
        size, now, part = 0, None, 0

        def flush():
            doc, null, counts, ids = (np.concatenate(x) for x in zip(*held))
            raw = DacFile.build(doc, null, counts, ids).to_bytes()
            system, base = file_system(folder)
            name = f"{now:08d}-{part:05d}.dac"
            # A retried task writes the same bytes; a rename shows whole files only.
            system.create_dir(base, recursive=True)
            tried = f"{base}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(tried) as out:
                out.write(raw)
            system.move(tried, f"{base}/{name}")
            return pa.RecordBatch.from_pydict(
                {"file_no": [now], "part": [part], "name": [name], "docs": [len(doc)], "ids": [len(ids)]},
                schema=pa.schema([("file_no", pa.int64()), ("part", pa.int64()), ("name", pa.string()),
                                  ("docs", pa.int64()), ("ids", pa.int64())]))

        for batch in batches:
            number = np.asarray(batch.column("file_no"))
            width = np.asarray(batch.column("width"))
            values = B.texts_of(batch.column("ids"))
            length = np.diff(values.offsets) // width
            doc = batch.column("doc")
            null = np.asarray(doc.is_null())
            doc = np.asarray(doc.fill_null(0))
            cuts = np.flatnonzero((number[1:] != number[:-1]) | (width[1:] != width[:-1])) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
                if low == high:
                    continue
                at = low
                while at < high:
                    if held and (number[at] != now or size >= FILE_IDS):
                        yield flush()
                        part = part + 1 if number[at] == now else 0
                        held, size = [], 0
                    now = int(number[at])
                    room = np.searchsorted(np.cumsum(length[at:high]), FILE_IDS - size, "left") + 1
                    upto = min(high, at + int(room))
                    raw = values.data[values.offsets[at] : values.offsets[upto]]
                    ids = np.frombuffer(raw.tobytes(), f"<u{width[at]}").astype(np.uint32)
                    held.append((doc[at:upto], null[at:upto], length[at:upto], ids))
                    size += len(ids)
                    at = upto
        if held:
            yield flush()

    return run


def write_ids(docs: DataFrame, vocab: str, folder: str, end_id: int = 2, id_col: str = "doc_id",
              text_col: str = "text", docs_per_file: int = 4096, added_tokens: bool = False) -> DataFrame:
    """Encode the texts, append `end_id` to each, and write the ids into files below `folder`.

    Returns a row per file in order: file_no, part, name, docs, ids, and `before`, the ids
    of all files ahead of it. `folder` must be one that all executors share. Bounds of
    document ids between files come from a scan of the ids alone; rows are then shuffled
    once, as ids. Files end after about 16 million ids, so one id's many rows fill several.
    `id_col` must be a whole number. With `added_tokens` the strings of the vocabulary's added
    tokens are these tokens, as the library reads them; else they are ordinary text.
    """
    with open(vocab, encoding="utf-8") as file:
        vocabulary = file.read()
    check_vocabulary(vocabulary)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    n = rows.select(F.count("doc")).first()[0]
    files = max(1, -(-n // docs_per_file))
    bounds: list[int] = []
    if files > 1:
        at = [k / files for k in range(1, files)]
        found = rows.select(F.percentile_approx("doc", at, 10 * files)).first()[0]
        bounds = sorted(set(found))
    tie = F.xxhash64("text")
    numbered = rows.select("doc", "text", tie.alias("tie"))

    def number(batches):
        edges = np.array(bounds, np.int64)
        for batch in batches:
            doc = batch.column("doc")
            no = np.searchsorted(edges, np.asarray(doc.fill_null(0)), "left") + 1
            no[np.asarray(doc.is_null())] = 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(no.astype(np.int64))],
                                             [*batch.schema.names, "file_no"])

    encode = _encoder(vocabulary, end_id, added_tokens)

    def run(batches):
        return encode(number(batches))

    ids = numbered.mapInArrow(run, "doc long, tie long, file_no long, width int, ids binary")
    spread = ids.repartition(max(files + 1, spark.sparkContext.defaultParallelism), "file_no")
    written = spread.sortWithinPartitions("file_no", F.col("doc").asc_nulls_first(), "tie", "ids").drop("tie")
    listing = stored(written.mapInArrow(_writer(folder), "file_no long, part long, name string, docs long, ids long"),
                     "dac-listing")
    ahead = Window.orderBy("file_no", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return listing.withColumn("before", F.coalesce(F.sum("ids").over(ahead), F.lit(0)))


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """The documents of written files: doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    def run(batches):
        system, base = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_stream(f"{base}/{row['name']}") as source:
                    dac = DacFile.from_bytes(source.read())
                ids = dac.all_ids()
                starts = dac.starts.astype(np.int64)
                for low in range(0, len(dac.doc_ids), 1024):
                    own = starts[low : low + 1025]
                    doc = pa.array(dac.doc_ids[low : low + 1024], mask=dac.null[low : low + 1024] == 1)
                    part = np.ascontiguousarray(ids[own[0] : own[-1]], "<u4")
                    yield pa.RecordBatch.from_arrays(
                        [doc, pa.array(own[:-1] + row["before"]), pa.array(np.diff(own)),
                         B.binary_rows(part.view(np.uint8), (own - own[0]) * 4)],
                        ["doc_id", "start", "n_tokens", "ids"])

    # One file, one task at a time: the listing is small and its rows are dealt out.
    n = max(1, files.count())
    return files.repartitionByRange(n, "file_no", "part").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")


def token_at(spark: SparkSession, files: DataFrame, folder: str, places: DataFrame, place_col: str = "place") -> DataFrame:
    """The id at each of many places in the whole sequence, read directly from the files.

    Places beyond the end, and null ones, get a null id.
    """
    listing = files.select("name", "before", "ids").orderBy("before").collect()  # a row per file
    names = np.array([r["name"] for r in listing], object)
    before = np.array([r["before"] for r in listing], np.int64)
    total = int(before[-1] + listing[-1]["ids"]) if listing else 0
    asked = places.select(F.col(place_col).cast("long").alias("place")).distinct()

    def find(batches):
        for batch in batches:
            place = np.asarray(batch.column("place"))
            at = np.searchsorted(before, place, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(names[at], pa.string()), pa.array(before[at])],
                                             ["place", "name", "before"])

    found = asked.filter((F.col("place") >= 0) & (F.col("place") < total)).mapInArrow(
        find, "place long, name string, before long")

    def run(key, group):
        system, base = file_system(folder)
        with system.open_input_stream(f"{base}/{key[0].as_py()}") as source:
            dac = DacFile.from_bytes(source.read())
        place = np.asarray(group.column("place"))
        ids = dac.ids_at(place - np.asarray(group.column("before")))
        return pa.table({"place": place, "id": ids.astype(np.int64)})

    ids = found.groupBy("name").applyInArrow(run, "place long, id long")
    return asked.join(ids, "place", "left").withColumnRenamed("place", place_col)


def new_folder(spark: SparkSession) -> str:
    return shared_path(spark, "dac")
