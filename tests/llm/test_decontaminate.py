import random
from itertools import combinations

import numpy as np

import __spark_entry__ as entry
from tabwarden.llm import decontaminate as D

WORDS = [f"w{k}" for k in range(3000)]


def test_masks_see_every_window_with_the_allowed_replacements():
    for bad in combinations(range(D.WINDOW), D.MISMATCHES):
        seen = any(not {s + p for p in mask} & set(bad) for mask in D.MASKS for s in range(D.WINDOW - mask[-1]))
        assert seen, bad


def brute(docs, items):
    """All documents against all items on all diagonals."""
    import re

    def tokens(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    firsts = {}
    for item, text in items:
        t = tuple(tokens(text))
        if len(t) >= D.MIN_TOKENS:
            firsts[t] = min(firsts.get(t, item), item)
    out = set()
    for doc, text in docs:
        own = tokens(text)
        for t, item in firsts.items():
            size = min(D.WINDOW, len(t))
            most = D.MISMATCHES if size == D.WINDOW else size // 6
            if any(sum(own[s + i] != t[j + i] for i in range(size)) <= most
                   for s in range(len(own) - size + 1) for j in range(len(t) - size + 1)):
                out.add((doc, item))
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 5, 8, 12, 13, 30, 60])))) for i in range(25)]
    items += [(90, items[4][1].upper() + "!"), (91, None), (92, ""), (93, items[5][1])]
    docs = []
    for i in range(120):
        body = [rng.choice(WORDS) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            own = rng.choice(items)[1]
            part = (own or "").split()
            for k in range(len(part)):
                if rng.random() < 0.08:
                    part[k] = rng.choice(WORDS)
            cut = rng.randint(0, 4)
            at = rng.randint(0, len(body))
            body[at:at] = part[cut:]
        docs.append((i, ", ".join(body)))
    docs += [(None, items[6][1]), (200, None), (201, ""), (202, "x " * 30_000 + items[7][1]), (5, docs[5][1])]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = D.contaminated(d, b)
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert found == brute(docs, items) and len(found) > 40
    assert got.filter("doc_id = 5").select("row_id").distinct().count() <= 1
    left = D.clean(d, b)
    assert left.columns == d.columns
    assert sorted((r["doc_id"], r["text"]) for r in left.filter("doc_id is not null").collect()) == sorted(
        ((i, t) for i, t in docs if i is not None and i not in {x[0] for x in found}), key=lambda r: r[0])
    assert D.contaminated(d.limit(0), b).count() == 0 and D.contaminated(d, b.limit(0)).count() == 0


def test_overlap_places():
    item = np.arange(20, dtype=np.uint64)
    doc = np.concatenate([np.full(7, 99), item, np.full(5, 98)]).astype(np.uint64)
    doc[12] = 77
    assert D.overlap(doc, item, 7) == (7, 27, 19)
    assert D.overlap(doc[:18], item, 7) is None


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(*c).collect()]
    want = brute(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    got = {(r["doc_id"], r["item_id"]) for r in entry.queries()["op4_decontaminate"](spark, sf).collect()}
    assert got == want and want
