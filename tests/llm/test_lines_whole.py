"""Recall of links against a brute force that takes no hash and no constant of the operator but the similarity."""
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import test_lines

from tabwarden.llm import lines as L

SF = "/root/testdata/sf0.01/documents.parquet"


def groups_by_edits(rows):
    """How many lines go, by the word edits of all pairs of distinct lines."""
    seen = {}
    for _, text in rows:
        for line in (text or "").split("\n"):
            if test_lines.takes_part(test_lines.norm(line)):
                seen[test_lines.norm(line)] = seen.get(test_lines.norm(line), 0) + 1
    names, up = sorted(seen), {n: n for n in seen}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for i, a in enumerate(names):
        for b in names[i + 1:]:
            longer = max(len(a), len(b))
            if 5 * min(len(a), len(b)) >= 4 * longer and 5 * test_lines.distance(a, b) <= longer:
                up[root(b)] = root(a)
    return sum(seen.values()) - len({root(n) for n in names})


def near_lines(seed):
    """Lines with up to a fifth of their words changed, taken out or put in."""
    rng = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    texts = []
    for length in [5, 6, 9, 10, 11, 15, 20, 24, 25, 40] * 3:
        base = [rng.choice(words) for _ in range(length)]
        for _ in range(4):
            own = list(base)
            for _ in range(rng.randint(0, length // 5 + 1)):
                at = rng.randrange(len(own))
                own[at:at + rng.choice([0, 1, 1])] = [rng.choice(words)] * rng.choice([0, 1, 1])
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(999, "la la la one two three la la"), (998, "la la la one two three la")]


@pytest.mark.parametrize("seed, most", [(1, 20_000), (2, 3), (3, 2)])
def test_near_lines_group(spark, monkeypatch, seed, most):
    monkeypatch.setattr(L, "MOST", most)
    rows = near_lines(seed)
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    want = groups_by_edits(rows)
    assert want > 40 and want >= sum(r["lines_removed"] for r in got.collect()) >= 0.95 * want


def distinct_lines():
    texts = pq.read_table(SF, columns=["text"]).column("text").to_pylist()
    found = {test_lines.norm(line) for text in texts for line in (text or "").split("\n")}
    return sorted(x for x in found if len(x) >= 5 and test_lines.takes_part(x))


def near_pairs(lines):
    """All pairs with an edit similarity of 0.8, each compared unless lengths or shared words rule it out."""
    names = {w: k for k, w in enumerate(sorted({w for x in lines for w in x}))}
    counts = np.zeros((len(lines), 256), np.uint8)
    for k, line in enumerate(lines):
        np.add.at(counts[k], [names[w] % 256 for w in line], 1)
    size = np.array([len(x) for x in lines])
    pairs = set()
    for i in range(len(lines)):
        longer = np.maximum(size[i], size[i + 1:])
        j = np.flatnonzero(5 * np.abs(size[i] - size[i + 1:]) <= longer) + i + 1
        # An edit changes two counts by one at most. No line here has 256 words of one cell.
        apart = np.abs(counts[j].astype(np.int16) - counts[i]).sum(1)
        for k in j[5 * apart <= 2 * longer[j - i - 1]].tolist():
            if 5 * test_lines.distance(lines[i], lines[k]) <= max(size[i], size[k]):
                pairs.add((i, k))
    return pairs


def groups(pairs, n):
    up = list(range(n))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in pairs:
        up[root(b)] = root(a)
    return [root(k) for k in range(n)]


@pytest.mark.parametrize("most", [20_000, 5])
def test_recall_on_whole_lines(spark, monkeypatch, most):
    """Every group found is part of a true one, and nine of ten lines that should go do."""
    monkeypatch.setattr(L, "MOST", most)
    lines = distinct_lines()
    true = groups(near_pairs(lines), len(lines))
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(lines)], "doc_id long, text string")
    gone = {r["doc_id"] for r in L.dedup_lines(docs.repartition(8)).collect() if r["lines_removed"]}
    first = {}
    for k, name in enumerate(true):
        first.setdefault(name, k)
    should = {k for k, name in enumerate(true) if first[name] != k}
    assert gone <= should
    assert len(gone) >= 0.95 * len(should) > 100
    print(f"recall: {len(gone)} of {len(should)} lines")
