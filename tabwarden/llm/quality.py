"""Quality rules: figures of each text, and lines that too many documents of a host share.

The lines of a document are normalised (ASCII letters in lower case, each run of
digits as one 0, runs of blanks as one, none at the ends) and hashed. A line found in
more than `max_docs` documents of one host is removed from all documents of that host.
A document fails when fewer than `min_words` words are in it, when over half of its
words stand in repeated three-word windows, or when the removed lines leave less than
`min_left` of its words.

Defined results: a null text is an empty one and fails; a null host is a host of its
own; repeated rows are documents of their own, each with its row; an empty table
gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import batches as B
from .stored import stored

B.ship(__name__)

WINDOW = 3
SYMBOLS = b"#*$%&|<>"
KEYS = ("doc", "host", "row_id")
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = ("host string, row_id long, " + ", ".join(f"{f} long" for f in FIGURES)
          + ", line long, line_words long")


def repeated_words(words: B.Words, hashes: np.ndarray, n_texts: int) -> np.ndarray:
    """Words in windows of WINDOW words that their text has twice or more, per text."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(n_texts, np.int64)
    inside = words.text[:n] == words.text[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    keys = B.mixed(B.window_hashes(hashes, WINDOW)[at] + words.text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(covered, at[twice], 1)
    np.add.at(covered, at[twice] + WINDOW, -1)
    return B.count_by_text(words.text[np.cumsum(covered[:-1]) > 0], n_texts)


def line_spans(texts: B.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every line; lines end at \\n."""
    breaks = np.flatnonzero(texts.data == 10)
    full = np.flatnonzero(np.diff(texts.offsets) > 0)
    start = np.sort(np.concatenate([texts.offsets[full], breaks + 1]))
    end = np.sort(np.concatenate([breaks, texts.offsets[full + 1]]))
    text = np.searchsorted(texts.offsets, end, "left") - 1
    return start, np.maximum(end, start), text


def normalised(texts: B.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that count in a comparison of lines, and for each position how many of them stand before it."""
    low = B.lowered(texts.data)
    digit = (low >= 48) & (low <= 57)
    low[digit] = 48
    blank = B.spaces(low)
    keep = ~blank
    first = np.zeros(len(low) + 1, bool)
    first[texts.offsets] = True
    keep[1:] &= ~(digit[1:] & digit[:-1] & ~first[1:-1])
    before = np.zeros(len(low) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return low[keep], before


def _figures(texts: B.Texts):
    n = len(texts.offsets) - 1
    words = B.words_of(texts)
    hashes = B.span_hashes(texts.data, words.start, words.end)
    chars_before = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=chars_before[1:])
    symbols_before = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(np.isin(texts.data, np.frombuffer(SYMBOLS, np.uint8)), out=symbols_before[1:])

    start, end, text = line_spans(texts)
    words_before = np.searchsorted(words.start, np.append(start, len(texts.data)), "left")
    line_words = np.searchsorted(words.start, end, "left") - words_before[:-1]
    start, end, text, line_words = (x[line_words > 0] for x in (start, end, text, line_words))
    own = text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    raw = B.mixed(B.span_hashes(texts.data, start, end) + own)
    _, first = np.unique(raw, return_index=True)
    later = np.ones(len(raw), bool)
    later[first] = False
    figures = {
        "n_words": B.count_by_text(words.text, n),
        "word_chars": B.count_by_text(words.text, n, (chars_before[words.end] - chars_before[words.start])),
        "n_symbols": symbols_before[texts.offsets[1:]] - symbols_before[texts.offsets[:-1]],
        "n_dup_lines": B.count_by_text(text[later], n),
        "n_repeat_words": repeated_words(words, hashes, n),
    }
    data, before = normalised(texts)
    word = B.span_hashes(data, before[words.start], before[words.end])
    first_word = np.searchsorted(words.start, start, "left")
    running = np.zeros(len(word) + 1, np.uint64)
    place = np.arange(len(word)) - np.repeat(first_word, line_words)
    np.cumsum(B.mixed(word + B.mixed(place.astype(np.uint64) + np.uint64(1))), out=running[1:], dtype=np.uint64)
    line = running[first_word + line_words] - running[first_word]
    return figures, text, line, line_words


def _rows(batches):
    for rows, texts in B.slices(batches, "text"):
        figures, text, line, line_words = _figures(texts)
        n = rows.num_rows
        none = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*[rows.column(c) for c in KEYS], *[pa.array(figures[f]) for f in FIGURES], none, none],
            [*KEYS, *FIGURES, "line", "line_words"])
        key = B.mixed(line + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        total = np.bincount(which, line_words, minlength=len(first)).astype(np.int64)
        m = len(first)
        owner = pa.array(text[first])
        yield pa.RecordBatch.from_arrays(
            [*[rows.column(c).take(owner) for c in KEYS], *[pa.nulls(m, pa.int64()) for _ in FIGURES],
             pa.array(line[first].view(np.int64)), pa.array(total)],
            [*KEYS, *FIGURES, "line", "line_words"])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  max_docs: int = 100, min_left: float = 0.3, min_words: int = 50) -> DataFrame:
    """One row per document: its id, the figures, removed_words, base_failed and kept.

    One scan writes a row per document and one per distinct line of a document to
    the shared folder; counting the lines and finding the removed ones shuffles
    numbers only. Counts of hot lines and hosts are summed before the shuffle.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"),
                       F.col(host_col).cast("string").alias("host"))
    numbered = rows.withColumn("row_id", F.monotonically_increasing_id())
    ids = f"doc {docs.schema[id_col].dataType.simpleString()}, "
    table = stored(numbered.mapInArrow(_rows, ids + SCHEMA), "quality")
    lines = table.filter("line is not null")
    key = [F.col("line"), F.coalesce(F.concat(F.lit("h"), "host"), F.lit("")).alias("host_key")]
    hot = (lines.groupBy(*key).agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > max_docs)
           .select("line", "host_key"))
    gone = (lines.select("row_id", "line_words", *key).join(hot, ["line", "host_key"])
            .groupBy("row_id").agg(F.sum("line_words").alias("gone")))
    out = table.filter("line is null").join(gone, "row_id", "left")
    removed = F.coalesce("gone", F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = (F.col("n_words") - removed) >= min_left * F.col("n_words")
    return out.select(F.col("doc").alias(id_col), *FIGURES, removed.alias("removed_words"),
                      failed.alias("base_failed"), (~failed & left).alias("kept"))

