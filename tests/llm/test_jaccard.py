import random
import re

import pytest

import __spark_entry__ as entry
from tabwarden.llm import jaccard as J

GAP = re.compile("[\x20\x09-\x0d]+")


def shingles(text, width=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in GAP.split(low) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1:]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            up[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    out = []
    for own in groups.values():
        ids = [rows[i][0] for i in own if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids) if ids else None, len(own)) for i in own]
    return sorted(out, key=repr)


def variants(rng, n, edits, length=80):
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(length)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(length)] = rng.choice(words)
        yield " ".join(own)


def rows_of(seed):
    rng = random.Random(seed)
    texts = [*variants(rng, 60, 4), *variants(rng, 40, 2), *variants(rng, 5, 1, 8), *variants(rng, 30, 6, 150)]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(80)]
    texts += ["One two", "one TWO", "one", None, "", " \n", "é è", "É è", "x " * 20_000, "x " * 19_000] + ["the same text of some words"] * 12
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "lonely words are here now"), (None, texts[0])]
    return rows


@pytest.mark.parametrize("seed, settings", [
    (1, {}), (2, {"PIVOTS": 3, "LEAF": 4}), (3, {"REGION_BYTES": 20_000, "LEAF": 6}), (4, {"REGION_BYTES": 6_000, "LEVELS": 1})])
def test_against_brute_force(spark, monkeypatch, seed, settings):
    for name, value in settings.items():
        monkeypatch.setattr(J, name, value)
    rows = rows_of(seed)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, component string")
    got = J.jaccard_components(docs)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_no_rows(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = entry.queries()["op9_jaccard"](spark, sf)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
