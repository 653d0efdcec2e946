import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from tabwarden.llm import maxent as M

GAP = re.compile("[\x20\x09-\x0d]+")


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in GAP.split(low) if w] + [None]


def base_of(rows):
    """(doc, held_out, n_tokens, n_known, N, base) by plain counting."""
    count = Counter(w for _, t, held in rows if not held for w in words(t))
    n, v = sum(count.values()), len(count)
    return [(d, held, len(words(t)), sum(count[w] > 0 for w in words(t)), n,
             sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))) for d, t, held in rows]


def matches(got, want):
    key = lambda r: tuple((x is not None, x) for x in r[:5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert math.isfinite(g[6]) and g[6] <= 1e-9


def test_base_and_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE_WORDS", 4)   # several ranges
    monkeypatch.setattr(M, "CHUNK_TOKENS", 50)  # several chunks
    texts = ["the The cat", "the cat sat", "a b c d e f g " * 9, None, "", " \n", "É é", "x " * 3000, "cat the sat new", "nothing known here"]
    rows = [(i, t, i % 4 == 1) for i, t in enumerate(texts)] + [(0, "the The cat", False), (None, "the", True), (None, "the", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, held_out boolean, word int")
    got = M.score_texts(docs)
    matches([tuple(r) for r in got.collect()], base_of([(d, t, bool(h)) for d, t, h in rows]))
    assert M.score_texts(docs.limit(0)).count() == 0
    untaught = M.score_texts(docs.filter("held_out"))
    matches([tuple(r) for r in untaught.collect()], base_of([(d, t, True) for d, t, h in rows if h]))


def test_probabilities_of_all_words_add_up():
    """For any context: all words seen, and the one never seen."""
    rng = np.random.default_rng(2)
    vocab = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    count = rng.integers(1, 9, 4000)
    cls, sub = M.Cells([(int(vocab[5].view(np.int64)), 8)]).of(vocab, count)
    cell = cls * M.SUBCLASSES + sub
    cell_counts = np.bincount(cell[count > 1], count[count > 1], M.CLASSES * M.SUBCLASSES).astype(np.int64)
    sums = {"tokens": int(count.sum()), "words": 4000, "once": int((count == 1).sum()), "twice": int((count == 2).sum())}
    model = M.Model(cell_counts, sums)
    model.weights += rng.normal(0, 0.3, model.weights.shape).astype(np.float32)
    model.sub_weights += rng.normal(0, 0.3, model.sub_weights.shape).astype(np.float32)
    p = model.classes(np.array([[1, M.ROWS + 2, 2 * M.ROWS + 3]]))[0]
    never, once = model.unseen()
    total = p[0] * (never + once * sums["once"])
    for c in range(1, M.CLASSES):
        q = model.subclasses(np.array([[7]]), np.array([c]))[0]
        own = (cls == c) & (count > 1)
        total += (p[c] * q[sub[own]] * count[own] / model.cell[cell[own]]).sum()
    assert total == pytest.approx(1, abs=1e-4)


def test_query_beats_the_base_on_rows_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in docs]
    got = [tuple(r) for r in entry.queries()["op2_maxent"](spark, sf).collect()]
    matches(got, base_of(rows))
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > 0.95 * sum(g[5] for g in held)
