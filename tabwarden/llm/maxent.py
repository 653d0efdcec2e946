"""Scores of texts by a hashed maximum-entropy model of words in context.

Words are runs of bytes other than \\x20 and \\x09 to \\x0D, ASCII lower case, and each text
ends with one end token. The probability of a token is factored by class:

    p(class | context) * p(subclass | class, context) * p(word | class, subclass)

The first two are softmaxes over hashed features of the words before: the last word, the
one before it alone (skip), and both together (trigram). The last is the word's share of its
cell. Class 0 holds the words that training has once or never;
never counts as one word, as in the base score. Frequent words, no more than TOP by their
share, are dealt to classes by weight, all others by hash. What training targets is what a
token would be if it were left out of the counts, so that unseen words get their due.

1. One scan writes chunks of tokens as numbers into the chunk's own sorted word list.
2. Word lists are cut by hash range and counted, a range at a time; each chunk gets the
   counts of its words back. Ranges are as many as the lists' total size asks for.
3. ROUNDS rounds of distributed gradient updates: tasks go over their chunks in batches of
   sparse rows, from the same weights, and send how far each row moved and how often it was
   used; rows move by the mean, weighted by use. Weights have a fixed size.
4. Chunks are scored in the same batches.

Words are 64-bit hashes. Defined results: a null text is an empty one (an end token);
without training rows every word is unseen; equal rows score alike and keep a row each;
null ids are kept, an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from . import batches as B
from .stored import dropped, stored

B.ship(__name__)

CLASSES = 32
SUBCLASSES = 32
ROWS = 1 << 13          # weight rows of each feature template
TEMPLATES = 3           # of the class; the subclass has the first, with the class
ROUNDS = 2
RATE = 0.08
BATCH = 1 << 14
CHUNK_TOKENS = 1 << 19
RANGE_WORDS = 1 << 20
TOP = 512
BLOCK = 1 << 10         # weight rows sent together
RARE, START = 1, 0
END = np.uint64(0x0E0D0F7E5717ED42)


def packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def tokens_of(texts: B.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in order, each text's end token included, and how many each text has."""
    n = len(texts.offsets) - 1
    low = B.Texts(B.lowered(texts.data), texts.offsets)
    words = B.words_of(low)
    count = np.bincount(words.text, minlength=n)
    hashes = B.span_hashes(low.data, words.start, words.end)
    return np.insert(hashes, np.cumsum(count), END), count + 1


def _chunk(parts: list) -> pa.RecordBatch:
    docs, held, tokens, count = zip(*parts)
    docs = pa.concat_arrays(docs)
    held, tokens, count = np.concatenate(held), np.concatenate(tokens), np.concatenate(count)
    vocab, number = np.unique(tokens, return_inverse=True)
    learn = np.repeat(~held, count)
    train = np.bincount(number[learn], minlength=len(vocab)).astype("<u4")
    one = pa.array([0, len(docs)], pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.ListArray.from_arrays(one, docs), pa.ListArray.from_arrays(one, pa.array(held)),
         pa.ListArray.from_arrays(one, pa.array(count.astype(np.int64))), pa.array([packed(number.astype("<u4"))], pa.binary()),
         pa.array([vocab.astype("<u8").tobytes()], pa.binary()), pa.array([packed(train)], pa.binary()),
         pa.array([len(vocab)], pa.int64())], ["docs", "held", "count", "tokens", "vocab", "train", "n_vocab"])


def _chunks(batches):
    parts, size = [], 0
    for rows, texts in B.slices(batches, "text"):
        tokens, count = tokens_of(texts)
        parts.append((rows.column("doc"), np.asarray(rows.column("held")), tokens, count))
        size += len(tokens)
        if size >= CHUNK_TOKENS:
            yield _chunk(parts)
            parts, size = [], 0
    if parts:
        yield _chunk(parts)


def _ranges(bits: int):
    """Each chunk's word list and training counts, cut by the highest bits of the hash."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                vocab = np.frombuffer(row["vocab"], "<u8")
                train = unpacked(row["train"], "<u4", len(vocab))
                cuts = np.searchsorted(vocab >> np.uint64(64 - bits), np.arange(1 << bits)) if bits else np.zeros(1, np.int64)
                cuts = [*cuts.tolist(), len(vocab)]
                parts = [(r, s, e) for r, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([r for r, _, _ in parts], pa.int64()), "chunk": pa.array([row["chunk"]] * len(parts), pa.int64()),
                    "vocab": pa.array([vocab[s:e].tobytes() for _, s, e in parts], pa.binary()),
                    "train": pa.array([packed(train[s:e]) for _, s, e in parts], pa.binary())})

    return run


COUNTED = ("part long, chunk long, counts binary, word long, word_count long, "
           "tokens long, words long, once long, twice long")


def _counted(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one range: for each chunk those of its words, the most frequent words, and sums."""
    rows = [(c, np.frombuffer(v, "<u8"), t) for b in batches
            for c, v, t in zip(*(b.column(x).to_pylist() for x in ("chunk", "vocab", "train")))]
    every = np.concatenate([v for _, v, _ in rows])
    train = np.concatenate([unpacked(t, "<u4", len(v)) for _, v, t in rows]).astype(np.int64)
    vocab, number = np.unique(every, return_inverse=True)
    total = np.bincount(number, train, len(vocab)).astype(np.int64)
    own = np.cumsum([len(v) for _, v, _ in rows])[:-1]
    counts = [packed(c.astype("<u4")) for c in np.split(np.minimum(total, 2**32 - 1)[number], own)]
    top = np.argsort(-total, kind="stable")[: 2 * TOP]
    top = top[total[top] > 0]
    n, m, part = len(rows), len(top), key[0].as_py()
    empty = lambda k, kind: pa.nulls(k, kind)
    long = pa.int64()
    yield pa.RecordBatch.from_arrays(
        [pa.array([part] * (n + m + 1), long), pa.concat_arrays([pa.array([c for c, _, _ in rows], long), empty(m + 1, long)]),
         pa.concat_arrays([pa.array(counts, pa.binary()), empty(m + 1, pa.binary())]),
         pa.concat_arrays([empty(n, long), pa.array(vocab[top].view(np.int64)), empty(1, long)]),
         pa.concat_arrays([empty(n, long), pa.array(total[top]), empty(1, long)]),
         *[pa.concat_arrays([empty(n + m, long), pa.array([int(x)], long)])
           for x in (total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum())]],
        [c.split()[0] for c in COUNTED.split(", ")])


class Cells:
    """The class and subclass of words, from their hashes and counts."""

    def __init__(self, top: list[tuple[int, int]]):
        words = np.array([w for w, _ in top], np.int64).view(np.uint64)
        load = np.zeros(CLASSES - 1)
        dealt = np.zeros(len(top), np.int64)
        for k, (_, n) in enumerate(top):  # most frequent first, each to the lightest class
            dealt[k] = int(load.argmin())
            load[dealt[k]] += n
        order = np.argsort(words)
        self.words, self.dealt = words[order], dealt[order] + 1

    def of(self, word: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and subclass of words with these counts, were they seen more than once."""
        cls = 1 + ((word >> np.uint64(8)) % np.uint64(CLASSES - 1)).astype(np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            cls = np.where(self.words[at] == word, self.dealt[at], cls)
        return cls, ((word >> np.uint64(24)) % np.uint64(SUBCLASSES)).astype(np.int64)


def _coded(cells: Cells):
    """Chunks with the count, cell and context code of each of their words, and sums by cell."""
    def run(batches):
        for batch in batches:
            for k, row in enumerate(batch.select(["vocab", "train", "n_vocab", "parts"]).to_pylist()):
                word = np.frombuffer(row["vocab"], "<u8")
                train = unpacked(row["train"], "<u4", len(word)).astype(np.int64)
                # Ranges ascend with the hash, as the words do; a range's length is its words'.
                parts = sorted((p["part"], p["counts"]) for p in row["parts"])
                count = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(c), "<u4") for _, c in parts]).astype(np.int64)
                cls, sub = cells.of(word, count)
                often = count > 1
                total = np.bincount(np.where(often, cls * SUBCLASSES + sub, 0), train * often, CLASSES * SUBCLASSES)
                code = np.where(count > 3, ((word >> np.uint64(32)) % np.uint64(65534)).astype(np.int64) + 2, RARE).astype("<u2")
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays(
                    [*[one.column(c) for c in ("docs", "held", "count", "tokens", "n_vocab")],
                     pa.array([packed(count.astype("<u4"))], pa.binary()),
                     pa.array([packed((cls * SUBCLASSES + sub).astype("<u2"))], pa.binary()),
                     pa.array([code.tobytes()], pa.binary()), pa.array([total.astype(np.int64).tolist()], pa.list_(pa.int64()))],
                    ["docs", "held", "count", "tokens", "n_vocab", "counts", "cells", "codes", "cell_counts"])

    return run


class Chunk:
    """A chunk's tokens with what model and base need of each."""

    def __init__(self, row: dict):
        self.count = np.asarray(row["count"], np.int64)
        self.held = np.asarray(row["held"], bool)
        n = int(self.count.sum())
        self.token = unpacked(row["tokens"], "<u4", n).astype(np.int64)
        v = row["n_vocab"]
        self.word_count = unpacked(row["counts"], "<u4", v).astype(np.int64)
        self.cell = unpacked(row["cells"], "<u2", v).astype(np.int64)
        code = np.frombuffer(row["codes"], "<u2").astype(np.uint64)[self.token]
        start = np.cumsum(self.count) - self.count
        place = np.arange(n) - np.repeat(start, self.count)
        before = []
        for back in (1, 2):
            c = np.zeros(n, np.uint64)
            c[back:] = code[:-back] if n > back else code[:0]
            c[place < back] = START
            before.append(c)
        self.before = before

    def features(self, at: np.ndarray) -> np.ndarray:
        """Weight rows of the class, by template."""
        one, two = (x[at] for x in self.before)
        keys = (one, two, one * np.uint64(0x9E3779B97F4A7C15) + two + np.uint64(1))
        return np.stack([(B.mixed(k + np.uint64(t << 40)) % np.uint64(ROWS)).astype(np.int64) + t * ROWS
                         for t, k in enumerate(keys)], 1)

    def sub_features(self, at: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Weight rows of the subclass, given the class."""
        own = self.before[0][at] + (cls.astype(np.uint64) << np.uint64(48)) + np.uint64(7)
        return (B.mixed(own) % np.uint64(ROWS)).astype(np.int64)[:, None]


def softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


class Model:
    """Weights of both softmaxes, and what is left of a word in its cell."""

    def __init__(self, cell_counts: np.ndarray, totals: dict):
        grid = cell_counts.reshape(CLASSES, SUBCLASSES).astype(np.float64)
        self.totals = totals
        self.cell = np.maximum(cell_counts, 1).astype(np.float64)
        by_class = grid.sum(1)
        by_class[0] = totals["once"] + 2 * totals["twice"]
        self.bias = np.log(np.maximum(by_class, 0.5) / max(by_class.sum(), 1)).astype(np.float32)
        self.sub_bias = np.where(grid > 0, np.log(np.maximum(grid, 1) / np.maximum(grid.sum(1, keepdims=True), 1)), -30).astype(np.float32)
        self.weights = np.zeros((TEMPLATES * ROWS, CLASSES), np.float32)
        self.sub_weights = np.zeros((ROWS, SUBCLASSES), np.float32)

    def unseen(self) -> tuple[float, float]:
        """Shares of class 0: of the word never seen, and of each word seen once."""
        never = (self.totals["once"] + 1) / (self.totals["once"] + 2 * self.totals["twice"] + 2)
        return never, (1 - never) / max(self.totals["once"], 1)

    def classes(self, rows: np.ndarray) -> np.ndarray:
        return softmax(self.weights[rows].sum(1) + self.bias)

    def subclasses(self, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
        return softmax(self.sub_weights[rows].sum(1) + self.sub_bias[cls])


def _descend(weights, squares, used, rows, gradient):
    """One step along the gradient of a batch: rows that several tokens use are summed first."""
    k = rows.shape[1]
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    token = order // k
    row, first = np.unique(flat[order], return_index=True)
    total = np.add.reduceat(gradient[token], first, axis=0)
    used[row] += np.diff(np.append(first, len(flat)))
    squares[row] += (total * total).mean(1)
    weights[row] -= (RATE / np.sqrt(squares[row] + 1e-6))[:, None] * total


def train_on(model: Model, chunk: Chunk, state: dict, rng: np.random.Generator) -> None:
    """All training tokens of a chunk once, in batches drawn over the whole chunk."""
    at = np.flatnonzero(np.repeat(~chunk.held, chunk.count))
    rng.shuffle(at)
    for low in range(0, len(at), BATCH):
        own = at[low : low + BATCH]
        word = chunk.token[own]
        often = chunk.word_count[word] > 2  # left out of the counts, a word of two is seen once
        cell = chunk.cell[word]
        cls = np.where(often, cell // SUBCLASSES, 0)
        rows = chunk.features(own)
        gradient = model.classes(rows)
        gradient[np.arange(len(own)), cls] -= 1
        _descend(model.weights, state["squares"], state["used"], rows, gradient)
        own, cls, sub = own[often], cls[often], (cell % SUBCLASSES)[often]
        if len(own):
            rows = chunk.sub_features(own, cls)
            gradient = model.subclasses(rows, cls)
            gradient[np.arange(len(own)), sub] -= 1
            _descend(model.sub_weights, state["sub_squares"], state["sub_used"], rows, gradient)


def new_state() -> dict:
    return {"squares": np.zeros(TEMPLATES * ROWS, np.float32), "used": np.zeros(TEMPLATES * ROWS, np.int64),
            "sub_squares": np.zeros(ROWS, np.float32), "sub_used": np.zeros(ROWS, np.int64)}


CODED = ["held", "count", "tokens", "n_vocab", "counts", "cells", "codes"]


def _gradient_round(model: Model):
    """How far a task's rows moved (half precision) and how often they were used, in blocks of rows."""
    def run(batches):
        own, state, rng, any_rows = copy.deepcopy(model), new_state(), np.random.default_rng(7), False
        for batch in batches:
            for row in batch.to_pylist():
                any_rows = True
                train_on(own, Chunk(row), state, rng)
        if not any_rows:
            return
        for base, new, old, used in ((0, own.weights, model.weights, state["used"]),
                                     (TEMPLATES * ROWS, own.sub_weights, model.sub_weights, state["sub_used"])):
            moved = (new - old).astype("<f2")
            for low in range(0, len(moved), BLOCK):
                part = slice(low, low + BLOCK)
                if used[part].any():
                    yield pa.RecordBatch.from_pydict({
                        "block": pa.array([base + low], pa.int32()), "moved": pa.array([moved[part].tobytes()], pa.binary()),
                        "used": pa.array([np.minimum(used[part], 2**32 - 1).astype("<u4").tobytes()], pa.binary())})

    return run


MOVED = "block int, moved binary, used binary"


def _mean_move(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's mean move over all tasks, weighted by use; one task's part at a time."""
    total, uses = 0.0, np.zeros(BLOCK)
    for batch in batches:
        for moved, used in zip(batch.column("moved").to_pylist(), batch.column("used").to_pylist()):
            used = np.frombuffer(used, "<u4").astype(np.float64)
            total = total + np.frombuffer(moved, "<f2").reshape(BLOCK, -1).astype(np.float64) * used[:, None]
            uses += used
    mean = (total / np.maximum(uses, 1)[:, None]).astype("<f4")
    yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "moved": pa.array([mean.tobytes()], pa.binary()),
                                      "used": pa.array([np.minimum(uses, 2**32 - 1).astype("<u4").tobytes()], pa.binary())})


def trained(chunks: DataFrame, model: Model) -> Model:
    """Each round takes its share of the chunks; every training token counts once."""
    numbered = chunks.select("part_of_round", *CODED)
    for k in range(ROUNDS):
        share = numbered.filter(F.col("part_of_round") == k).select(*CODED)
        moves = share.mapInArrow(_gradient_round(model), MOVED).groupBy("block").applyInArrow(_mean_move, MOVED)
        for row in moves.toLocalIterator():  # as many blocks as the weights have
            at = row["block"]
            target, at = (model.weights, at) if at < TEMPLATES * ROWS else (model.sub_weights, at - TEMPLATES * ROWS)
            target[at : at + BLOCK] += np.frombuffer(row["moved"], "<f4").reshape(BLOCK, -1)
    return model


def score_chunk(model: Model, chunk: Chunk) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, base and model log10 probability of each text."""
    n_texts, n = len(chunk.count), len(chunk.token)
    text = np.repeat(np.arange(n_texts), chunk.count)
    totals = model.totals
    known = chunk.word_count[chunk.token]
    base = np.log10((chunk.word_count + 0.5) / (totals["tokens"] + 0.5 * (totals["words"] + 1)))[chunk.token]
    never, once = model.unseen()
    score = np.empty(n)
    for low in range(0, n, BATCH):
        own = np.arange(low, min(n, low + BATCH))
        word = chunk.token[own]
        count, cell = chunk.word_count[word], chunk.cell[word]
        often = count > 1
        cls = np.where(often, cell // SUBCLASSES, 0)
        p = model.classes(chunk.features(own))[np.arange(len(own)), cls].astype(np.float64)
        p[~often] *= np.where(count[~often] == 0, never, once)
        if often.any():
            at, of = own[often], cls[often]
            p[often] *= model.subclasses(chunk.sub_features(at, of), of)[np.arange(len(at)), (cell % SUBCLASSES)[often]]
            p[often] *= count[often] / model.cell[cell[often]]
        score[own] = np.log10(np.maximum(p, 1e-300))
    return chunk.count, np.bincount(text, known > 0, n_texts).astype(np.int64), np.bincount(text, base, n_texts), np.bincount(text, score, n_texts)


def _scored(model: Model):
    def run(batches):
        for batch in batches:
            for k, row in enumerate(batch.select(CODED).to_pylist()):
                chunk = Chunk(row)
                count, known, base, score = score_chunk(model, chunk)
                docs = batch.column("docs").slice(k, 1).flatten()
                yield pa.RecordBatch.from_arrays([docs, pa.array(chunk.held), pa.array(count), pa.array(known), pa.array(base), pa.array(score)],
                                                 ["doc", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, held_out: str = "held_out", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows that are not held out, and score all.

    One row per document: its id, held_out, n_tokens, n_known, train_tokens, base_score
    (unigrams with half a count added) and score, both as log10 of the text's probability.
    """
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(held_out), F.lit(False)).alias("held"),
                       F.col(text_col).cast("string").alias("text"))
    lists = [T.StructField("docs", T.ArrayType(id_type)), T.StructField("held", T.ArrayType(T.BooleanType())),
             T.StructField("count", T.ArrayType(T.LongType())), T.StructField("tokens", T.BinaryType())]
    schema = T.StructType([*lists, T.StructField("vocab", T.BinaryType()), T.StructField("train", T.BinaryType()),
                           T.StructField("n_vocab", T.LongType())])
    chunks = stored(rows.mapInArrow(_chunks, schema).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    listed = chunks.agg(F.sum("n_vocab")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, listed / RANGE_WORDS)))))
    parts = chunks.select("chunk", "vocab", "train").mapInArrow(_ranges(bits), "part long, chunk long, vocab binary, train binary")
    counted = stored(parts.groupBy("part").applyInArrow(_counted, COUNTED), "counted")
    sums = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "words", "once", "twice")]).first().asDict()
    least = max(1, sums["tokens"] / TOP)  # so at most TOP words come to the driver
    top = counted.filter(F.col("word_count") >= least).orderBy(F.desc("word_count"), "word").select("word", "word_count").collect()
    own = counted.filter("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("part", "counts")).alias("parts"))
    coded_schema = T.StructType([*lists, T.StructField("n_vocab", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in
                                 ("counts", "cells", "codes")], T.StructField("cell_counts", T.ArrayType(T.LongType()))])
    coded = chunks.join(own, "chunk").mapInArrow(_coded(Cells([(r[0], r[1]) for r in top])), coded_schema)
    coded = stored(coded.withColumn("part_of_round", F.pmod(F.xxhash64("tokens"), F.lit(ROUNDS))), "coded")
    dropped(chunks, counted)
    cell_counts = np.zeros(CLASSES * SUBCLASSES, np.int64)
    for cell, n in coded.select(F.posexplode("cell_counts").alias("cell", "n")).groupBy("cell").agg(F.sum("n")).collect():
        cell_counts[cell] = n
    cell_counts[:SUBCLASSES] = 0  # class 0 has its own share
    model = trained(coded, Model(cell_counts, sums))
    out_schema = T.StructType([T.StructField("doc", id_type), T.StructField("held_out", T.BooleanType()),
                               *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")],
                               *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])
    out = coded.select("docs", *CODED).mapInArrow(_scored(model), out_schema)
    return out.select(F.col("doc").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(sums["tokens"]).cast("long").alias("train_tokens"),
                      "base_score", "score")
