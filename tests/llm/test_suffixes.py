import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tabwarden.llm import suffixes
from tabwarden.llm.batches import Texts


def by_hand(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(x[i:i + width] for x in texts for i in range(len(x) - width + 1))
    out = []
    for (doc_id, _), x in zip(rows, texts):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - width + 1):
            if seen[x[i:i + width]] > 1:
                gone[i:i + width] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        out.append((doc_id, len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digest(df, id_col="doc_id"):
    out = []
    for r in df.collect():
        gone = sum(s.end - s.start for s in r.spans)
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
        out.append((r[id_col], r.n_bytes, gone, len(r.spans), hashlib.sha256(r.kept).hexdigest()))
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    from tabwarden.llm.queries import QUERIES, table

    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_suffixes"](spark, "/root/testdata/sf0.001").collect()), key=str)
    want = by_hand(rows, 200)
    assert got == want and sum(r[2] > 0 for r in want) > 10


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(30)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    shared = [text(12) for _ in range(4)]
    rows = [(i, text(rng.randint(0, 25)) + rng.choice(shared)[: rng.randint(10, 60)] + text(rng.randint(0, 25))) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, rows[1][1] + "z"), (103, "z" + rows[1][1]), (104, None), (105, "")]
    rows += [(106, "a" * 300), (107, "b" * 41 + "ab" * 60), (108, shared[0] * 3), (None, shared[1]), (None, shared[1]), (109, "x" * 40)]
    rows += [(110, "\0" * 90 + "q"), (111, "k" + "\0" * 39)]
    return rows


@pytest.mark.parametrize("seed, batches, group", [(1, 4, 1000), (2, 5, 3), (3, 1, 1)])
def test_against_brute_force(spark, seed, batches, group):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, b"x", 1) for i, t in rows], "key long, text string, t binary, salt int")
    got = digest(suffixes.without_repeats(docs, "key", batches=batches, width=40, window=20, group=group), "key")
    assert got == by_hand(rows, 40)


def test_long_texts_in_pieces():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 101, 30_000).astype(np.uint8)
    data[9000:9700] = data[100:800]
    data[20_000:20_500] = 97
    texts = Texts(data, np.array([0, len(data)]))

    def whole(piece):
        parts = list(suffixes.places_of(texts, piece=piece))
        return [np.concatenate([p[k] for p in parts]).tolist() for k in range(6)]

    assert whole(2 << 20) == whole(3000) == whole(700)
    assert sum(whole(700)[3]) == len(data) - suffixes.WIDTH + 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.without_repeats(docs).isEmpty()


def test_hash_of_texts_that_defeat_polynomials(spark):
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    rows = [(1, a + "x" * 250), (2, b + "y" * 250), (3, a + "z" * 250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(suffixes.without_repeats(docs)) == by_hand(rows, 200)
