"""Language of mixed text: scripts narrow the languages, scores of words and a Viterbi pass label spans.

A word is a run of letters of one script. Its score for a language is the mean, over the
sizes 1 to 4, of the summed log probabilities of its character n-grams (with a mark at
either end), hashed into BUCKETS numbers; languages that hardly use its script are no
candidates. A Viterbi pass over a text's words pays SWITCH for each change of language,
so a few odd words change nothing and a passage does. The text's language is the one of
most letters, its score their share of all letters.

The model is counts: languages x BUCKETS numbers, summed by Spark over all training rows
and bounded by MAX_LANGS, whatever the size of the corpus.

Defined results: a text that is null or has no letter is `und` with score 0, as is every
text when there is nothing to learn from; equal shares go to the language first in order;
rows whose language is null teach nothing. Words in a script that no language has are
labelled by their neighbours. The columns made replace columns of the same names.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import batches as B
from .pieces import LETTER, classes, code_points

B.ship(__name__)

BUCKETS = 1 << 16
SIZES = (1, 2, 3, 4)
SMALL_SLICE = 1 << 19   # bytes of text at a time, where memory counts more than time; n-grams take some 80 times that
SWITCH = 6.0
WORST = -8.0
MAX_LANGS = 1000
MIN_SCRIPT_SHARE = 0.001
UNKNOWN = "und"
#: Blocks of Unicode by script.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "gurmukhi": ((0xA00, 0xA7F),),
    "gujarati": ((0xA80, 0xAFF),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "kannada": ((0xC80, 0xCFF),),
    "malayalam": ((0xD00, 0xD7F),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "ethiopic": ((0x1200, 0x139F),),
    "kana": ((0x3040, 0x30FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "han": ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)),
}
MODEL = "lang string, bucket int, n long"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The script number of each letter (0: no letter) and each character in lower case."""
    held = B.worker_cache("scripts")
    if "script" not in held:
        letter = classes() == LETTER
        script = np.where(letter, len(SCRIPTS) + 1, 0).astype(np.uint8)
        for k, blocks in enumerate(SCRIPTS.values(), 1):
            for low, high in blocks:
                script[low : high + 1][letter[low : high + 1]] = k
        lower = np.arange(0x110000, dtype=np.uint32)
        for c in np.flatnonzero(letter):
            if unicodedata.category(chr(c)) in ("Lu", "Lt") and len(small := chr(c).lower()) == 1:
                lower[c] = ord(small)
        held["script"], held["lower"] = script, lower
    return held["script"], held["lower"]


class LetterWords:
    """The words of a slice, and its distinct words with their n-grams."""

    def __init__(self, texts: B.Texts):
        script_of, lower = _tables()
        points, lead = code_points(texts.data)
        m = len(points)
        script = script_of[points]
        edge = np.zeros(m + 1, bool)
        self.text_start = np.searchsorted(lead, texts.offsets)  # in characters
        edge[self.text_start] = True
        change = edge[:m].copy()
        change[1:] |= script[1:] != script[:-1]
        starts = np.flatnonzero(change)
        stops = np.append(starts[1:], m)
        word = script[starts] > 0 if m else np.zeros(0, bool)
        self.start, self.end = starts[word], stops[word]
        self.script = script[self.start]
        self.letters = self.end - self.start
        self.text = np.searchsorted(texts.offsets, lead[self.start], "right") - 1 if m else np.zeros(0, np.int64)
        self.low = lower[points]
        hashes = self._hashes()
        _, self.first, self.which = np.unique(hashes, return_index=True, return_inverse=True)

    def _hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's characters."""
        n = len(self.low)
        up, down, _ = B._powers(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(B.mixed(self.low + np.uint32(1)) * up[:n], out=prefix[1:], dtype=np.uint64)
        return B.mixed((prefix[self.end] - prefix[self.start]) * down[self.start] + self.letters.astype(np.uint64))

    def grams(self):
        """For each n-gram size: hash buckets, and the distinct word each belongs to."""
        start, length = self.start[self.first], self.letters[self.first]
        n = len(start)
        framed = length + 2
        at = np.cumsum(framed) - framed
        marks = np.zeros(int(framed.sum()), np.uint64)
        body = np.repeat(at + 1 - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        marks[body] = B.gathered(self.low, start, length).astype(np.uint64) + np.uint64(1)
        owner = np.repeat(np.arange(n), framed)
        for size in SIZES:
            if len(marks) < size:
                continue
            hashes = B.window_hashes(marks, size)
            inside = owner[: len(hashes)] == owner[size - 1 :]
            if size == 1:
                inside = inside & (marks > 0)
            yield (hashes[inside] % np.uint64(BUCKETS)).astype(np.int64), owner[: len(hashes)][inside]


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", limit: int = B.SLICE_BYTES) -> DataFrame:
    """Counts of n-grams and scripts for each language: lang, bucket, n.

    A task sums its rows into a vector for each language before anything is shuffled.
    """
    def run(batches):
        found: dict[str, np.ndarray] = {}
        for rows, texts in B.slices(batches, "text", limit):
            words = LetterWords(texts)
            langs = rows.column("lang").to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            n = len(words.first)
            if not n:
                continue
            grams = list(words.grams())
            for k, name in enumerate(names):
                own = number[words.text] == k
                times = np.bincount(words.which[own], minlength=n)
                total = found.setdefault(name, np.zeros(BUCKETS + len(SCRIPTS) + 2, np.int64))
                for bucket, owner in grams:
                    total[:BUCKETS] += np.bincount(bucket, times[owner], BUCKETS).astype(np.int64)
                total[BUCKETS:] += np.bincount(words.script[own], words.letters[own], len(SCRIPTS) + 2).astype(np.int64)
        for name, total in found.items():
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(full), "bucket": full.astype(np.int32), "n": total[full]})

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.filter("text is not null and lang is not null").mapInArrow(run, MODEL)
    return counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities of buckets, and the scripts each language uses."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        grams = counts[:, :BUCKETS].astype(np.float64) + 0.1
        self.log = np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32)
        scripts = counts[:, BUCKETS:]
        self.uses = (scripts >= MIN_SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)) & (scripts > 0)

    @classmethod
    def collect(cls, model: DataFrame) -> Model | None:
        """At most MAX_LANGS x BUCKETS numbers come to the driver."""
        langs = sorted(r["lang"] for r in model.select("lang").distinct().limit(MAX_LANGS + 1).collect())
        if len(langs) > MAX_LANGS:
            raise ValueError(f"more than {MAX_LANGS} languages")
        if not langs:
            return None
        counts = np.zeros((len(langs), BUCKETS + len(SCRIPTS) + 2), np.int64)
        table = model.toArrow()
        row = {x: k for k, x in enumerate(langs)}
        at = np.array([row[x] for x in table.column("lang").to_pylist()])
        counts[at, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
        return cls(langs, counts)

    def scores(self, words: LetterWords) -> np.ndarray:
        """Words x languages: 0 for the best candidate, WORST for languages of other scripts."""
        n, k = len(words.first), len(self.langs)
        total = np.zeros((n, k), np.float32)
        for bucket, owner in words.grams():
            for j in range(k):
                total[:, j] += np.bincount(owner, self.log[bucket, j], n)
        total /= len(SIZES)
        allowed = self.uses.T[words.script[words.first]]
        total = np.where(allowed, total, -np.inf)
        best = total.max(1, keepdims=True) if k else total
        known = np.isfinite(best[:, 0])
        out = np.zeros((n, k), np.float32)
        out[known] = np.maximum(total[known] - best[known], WORST)
        return out[words.which]


def viterbi(scores: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """The best label of each word, all texts of the slice side by side, word by word."""
    n, k = scores.shape
    labels = np.zeros(n, np.int64)
    if not n or k == 1:
        return labels
    count = np.bincount(text, minlength=n_texts)
    order = np.argsort(-count, kind="stable")
    count_sorted = count[order]
    first = (np.cumsum(count) - count)[order]
    came = np.zeros((n, k), np.uint16)
    value = np.zeros((n_texts, k), np.float32)
    alive = n_texts - np.searchsorted(count_sorted[::-1], np.arange(int(count.max())), "right")
    own = np.arange(k, dtype=np.uint16)
    for t, live in enumerate(alive):
        at = first[:live] + t
        now = value[:live]
        if t:
            best = now.argmax(1)
            top = now[np.arange(live), best][:, None] - SWITCH
            came[at] = np.where(now >= top, own, best[:, None].astype(np.uint16))
            now = np.maximum(now, top)
        value[:live] = now + scores[at]
    last = value.argmax(1)
    for t in range(len(alive) - 1, -1, -1):
        at = first[: alive[t]] + t
        labels[at] = last[: alive[t]]
        last[: alive[t]] = came[at, last[: alive[t]]] if t else last[: alive[t]]
    return labels


def identify(docs: DataFrame, model: DataFrame, text_col: str = "text", lang_col: str = "lang_pred",
             score_col: str = "score", spans_col: str = "lang_spans", limit: int = B.SLICE_BYTES) -> DataFrame:
    """Add each text's language, its score, and the labelled spans (start, end in characters, language)."""
    fitted = Model.collect(model)
    made = (lang_col, score_col, spans_col)
    schema = (docs.drop(*made).withColumn(lang_col, F.lit("")).withColumn(score_col, F.lit(0.0))
              .withColumn(spans_col, F.lit(None).cast("array<struct<start:long,end:long,lang:string>>")).schema)

    def run(batches):
        for rows, texts in B.slices(batches, text_col, limit):
            n = rows.num_rows
            words = LetterWords(texts)
            langs = fitted.langs if fitted else [UNKNOWN]
            names = np.array([*langs, UNKNOWN], object)
            if fitted:
                labels = viterbi(fitted.scores(words), words.text, n)
            else:
                labels = np.zeros(len(words.text), np.int64)
            k = len(langs)
            share = np.bincount(words.text * k + labels, words.letters, n * k).reshape(n, k)
            total = share.sum(1)
            best = share.argmax(1)
            score = share[np.arange(n), best] / np.maximum(total, 1)
            none = total == 0
            best[none] = k
            if not fitted:
                score[:] = 0.0
            change = np.ones(len(labels), bool)
            change[1:] = (labels[1:] != labels[:-1]) | (words.text[1:] != words.text[:-1])
            head = np.flatnonzero(change)
            tail = np.append(head[1:], len(labels)) - 1
            base = words.text_start[words.text[head]] if len(head) else head
            spans = pa.StructArray.from_arrays(
                [pa.array(words.start[head] - base), pa.array(words.end[tail] - base if len(head) else head),
                 pa.array(names[labels[head]], pa.string())], ["start", "end", "lang"])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(words.text[head], minlength=n))])
            kept = [c for c in rows.schema.names if c not in made]
            yield pa.RecordBatch.from_arrays(
                [*[rows.column(c) for c in kept], pa.array(names[best], pa.string()), pa.array(score),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)], [*kept, *made])

    return docs.mapInArrow(run, schema)
