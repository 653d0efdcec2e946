import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tabwarden.llm import batches as B, components as C, lines as L

pa = pytest.importorskip("pyarrow")
GAP = re.compile("[\x20\x09-\x0d]+")


def norm(line):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
    return tuple(re.sub("[0-9]+", "0", w) for w in GAP.split(low) if w)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def takes_part(words):
    return any(re.search("[a-z0-9]|[^\x00-\x7f]", w) for w in words)


def brute(rows):
    """Texts and counts after removal: all distinct lines compared, linked by an edit similarity of 0.8 alone."""
    seen = {}
    for doc, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if takes_part(norm(line)):
                seen.setdefault(norm(line), set()).add((doc, text, k))
    names = sorted(seen)
    bags = {n: Counter(n) for n in names}
    up = {n: n for n in names}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for i, a in enumerate(names):
        for b in names[i + 1:]:
            longer = max(len(a), len(b))
            if 5 * min(len(a), len(b)) < 4 * longer or 5 * (longer - (bags[a] & bags[b]).total()) > longer:
                continue        # more edits than one in five words, without counting them
            if root(a) != root(b) and 5 * distance(a, b) <= longer:
                up[root(b)] = root(a)
    groups = {}
    for n in names:
        groups.setdefault(root(n), set()).update(seen[n])
    stays = set()
    for own in groups.values():
        stays.add(min(own, key=lambda p: (p[0] is not None, p[0] or 0, p[2])))
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        inside = [k for k, line in enumerate(parts) if takes_part(norm(line))]
        gone = [k for k in inside if (doc, text, k) not in stays]
        left = "\n".join(p for k, p in enumerate(parts) if k not in gone) if gone else text
        out.append((doc, left, len(gone), len(inside)))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    bases = [[rng.choice(words) for _ in range(rng.choice([5, 12, 40, 60]))] for _ in range(14)]
    texts = []
    for _ in range(70):
        own = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 8])):
                line[rng.randrange(len(line))] = rng.choice(words)
            if rng.random() < 0.1:
                rng.shuffle(line)
            own.append(("  " if rng.random() < 0.2 else " ").join(line))
        own += rng.choice([["short line"], [""], ["| | | | | |"], [], ["Page 3 of 17 in this book"], ["page 4 of 5 in this BOOK"]])
        texts.append("\n".join(own))
    return list(enumerate(texts)) + [(100, None), (101, ""), (None, texts[0]), (5, texts[5]), (102, "é à ü ö ñ\n" * 3)]


@pytest.mark.parametrize("seed, most", [(1, 20_000), (2, 3)])
def test_against_brute_force(spark, monkeypatch, seed, most):
    monkeypatch.setattr(L, "MOST", most)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, line string, lines_in int")
    got = L.dedup_lines(docs).select("doc_id", "text", "lines_removed", "lines_in")
    want = brute(rows)
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    # No line goes that should stay; of those that should go, blocks and SimHashes miss one in twenty at most.
    assert [(g[0], g[3]) for g in got] == [(w[0], w[3]) for w in want]
    assert all(g[1] == w[1] if g[2] == w[2] else g[2] < w[2] for g, w in zip(got, want))
    assert sum(g[2] for g in got) >= 0.95 * sum(w[2] for w in want)
    assert sum(w[2] for w in want) > 40
    assert L.dedup_lines(docs.limit(0)).count() == 0


def test_equal_lines_of_any_length_group(spark):
    rows = [(1, "Log in\nHome\n---"), (2, "log  IN\n---\nHome page"), (3, "Log in\nHome"), (4, None), (None, "Home")]
    got = {r["doc_id"]: (r["text"], r["lines_removed"], r["lines_in"]) for r in
           L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("Log in\n---", 1, 2), 2: ("---\nHome page", 1, 2), 3: ("", 2, 2),
                   4: (None, 0, 0), None: ("Home", 0, 1)}


def test_many_lines_of_one_text(spark):
    """A text of 100,000 lines, all of them found in another one too, in linear time."""
    text = "\n".join(f"row{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(100_000))
    got = L.dedup_lines(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"))
    n = len(set(text.split("\n")))
    assert {(r["doc_id"], r["lines_removed"]) for r in got.collect()} == {(1, 100_000 - n), (2, 100_000)}


def test_edit_distance():
    rng = random.Random(9)
    for _ in range(400):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert L.edit_distance(a, b) == distance(a, b)


def test_blocks_move_with_their_words():
    """Words before, after or between others leave the blocks that they do not touch."""
    rng = random.Random(4)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    for _ in range(50):
        line = [rng.choice(words) for _ in range(60)]
        at = rng.randrange(15, 45)
        keys = []
        for own in (line, ["new", *line], [*line, "new"], line[:at] + ["new"] + line[at:]):
            some = L.Lines(B.texts_of(pa.array([" ".join(own)])))
            keys.append(set(some.blocks(np.arange(1))[0].tolist()))
        # Blocks that touch an edit differ, and those that ended with the line.
        assert all(len(keys[0] & other) >= len(keys[0]) - 5 for other in keys[1:])


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    n = 300
    edges = {"chain": [(i, i + 1) for i in range(n)], "star": [(n, i) for i in range(n)], "none": [(4, 4)],
             "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(200)]}[shape]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and up[a] != up[b]:
                up[a] = up[b] = min(up[a], up[b])
                changed = True
    assert got == up


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((d, n, g, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, g, n in brute(rows))
    got = entry.queries()["op10_lines"](spark, sf)
    assert sorted(map(tuple, got.collect())) == want
