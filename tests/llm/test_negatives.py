import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwarden.llm import negatives

KIND = "id long, label int, vector array<double>, key string, w int"


def by_hand(rows, is_anchor, n_pos=5, n_neg=3):
    """rows: (id, label, whole-numbered vector); plain loops over Python's whole numbers."""
    fit = {(i, l, tuple(v)) for i, l, v in rows
           if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, label, v in fit:
        if not is_anchor(i):
            continue
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(v, y)), j, k) for j, k, y in fit if j != i)
        for s, j, _ in [x for x in scores if x[2] == label][:n_pos]:
            window = [(t, m) for t, m, k in scores if k != label and 50 * -s <= 100 * -t <= 95 * -s][:n_neg]
            out += [(i, j, rank, m, -s, -t) for rank, (t, m) in enumerate(window, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_against_brute_force(spark):
    from tabwarden.llm.queries import QUERIES, table

    rows = []
    for r in table(spark, "/root/testdata/sf0.01", "embeddings").collect():
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        rows.append((r.vec_id, label, [float(np.floor(256.0 * float(x))) for x in r.embedding]))
    want = by_hand(rows, lambda i: i % 50 == 0)
    assert rows_of(QUERIES["op12_negatives"](spark, "/root/testdata/sf0.01")) == want and len(want) > 50


def clustered(seed, n, dim=6):
    rng = random.Random(seed)
    hubs = [[rng.randint(-60, 60) for _ in range(dim)] for _ in range(9)]
    return [(i, rng.randint(0, 3), [float(x + rng.randint(-3, 3)) for x in rng.choice(hubs)]) for i in range(n)]


@pytest.mark.parametrize("seed, block, splits", [(1, 4096, 64), (2, 40, 8)])
def test_against_brute_force(spark, seed, block, splits):
    rows = clustered(seed, 700)
    rows += [(1000 + i, i % 2, rows[0][2]) for i in range(120)]                      # copies, ties
    rows += [rows[0], rows[0], (0, 1, rows[1][2]), (5, 1, [float("nan")] * 6), (10, 2, None), (15, None, rows[0][2]),
             (20, 1, [None] + [1.0] * 5), (None, 1, rows[0][2]), (25, 0, [30.0, 40.0]), (30, 1, []), (35, 2, [float("inf")] * 6)]
    docs = spark.createDataFrame([(*r, "k", 7) for r in rows], KIND)
    got = rows_of(negatives.hard_negatives(docs, F.col("id") % 5 == 0, block=block, splits=splits))
    assert got == by_hand(rows, lambda i: i % 5 == 0)


def test_few_rows(spark):
    none = spark.createDataFrame([], KIND)
    assert negatives.hard_negatives(none, F.col("id") % 5 == 0).isEmpty()
    one = spark.createDataFrame([(0, 1, [1.0], "", 0)], KIND)
    assert negatives.hard_negatives(one, F.col("id") % 5 == 0).isEmpty()
    same = spark.createDataFrame([(0, 1, [0.0], "", 0), (1, 1, [0.0], "", 0), (2, 3, [0.0], "", 0)], KIND)
    assert rows_of(negatives.hard_negatives(same, F.col("id") == 0)) == [(0, 1, 1, 2, 0, 0)]


def test_huge_components_do_not_fail(spark):
    rows = [(i, i % 2, [1e15 * (i + 1), 3e18], "", 0) for i in range(20)]
    assert negatives.hard_negatives(spark.createDataFrame(rows, KIND), F.col("id") % 5 == 0).columns[0] == "anchor_id"


def test_ranges_leave_out_subtrees():
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(3000, 4)) * 5 + rng.integers(-3, 4, size=(3000, 1)) * 200)
    metric = negatives.Metric(4, float((x * x).sum(axis=1).max()))
    ids, labels = np.arange(3000), rng.integers(0, 3, 3000)
    q = x[:20]
    lo, hi = np.full((20, 1), -np.inf), np.full((20, 1), np.inf)
    search = negatives.Search(metric, 5, True, x, ids, labels, q, ids[:20], labels[:20], lo, hi)
    compared = []
    plain = search.compare
    search.compare = lambda rows, anchors: (compared.append(len(rows) * len(anchors)), plain(rows, anchors))
    search.run()
    assert sum(compared) < 0.8 * 20 * 3000
    for a in range(20):
        score = x @ q[a]
        ok = [i for i in np.lexsort((ids, -score)) if labels[i] == labels[a] and i != a][:5]
        assert search.found[3][search.found[0] == a].tolist() == ok
