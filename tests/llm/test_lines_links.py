"""No link is lost: long lines whose edits are spread so that no run of words stays whole."""
import random

import numpy as np
import pyarrow as pa
import pytest
import test_lines
import test_lines_whole

from tabwarden.llm import batches as B, lines as L

WORDS = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)]


def scattered(rng, length):
    """A line, and one as long with every fifth word another one."""
    line = [rng.choice(WORDS) for _ in range(length)]
    return line, [f"new{w}" if k % 5 == 2 else w for k, w in enumerate(line)]


def test_scattered_edits(spark):
    rng = random.Random(5)
    rows = []
    for length in (25, 30, 45, 60, 100, 200, 400):
        rows += [" ".join(x) for x in scattered(rng, length)]
    got = L.dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert {r["doc_id"]: r["lines_removed"] for r in got.collect()} == {k: k % 2 for k in range(len(rows))}


@pytest.mark.parametrize("seed, most", [(11, 20_000), (12, 3)])
def test_all_lines_go(spark, monkeypatch, seed, most):
    """Documents as by brute force, without a share that may be missed."""
    monkeypatch.setattr(L, "MOST", most)
    rng = random.Random(seed)
    texts = [t for _, t in test_lines_whole.near_lines(seed) + test_lines.corpus(seed)]
    texts += [" ".join(x) for k in range(0, 12, 2) for x in scattered(rng, 30 + 5 * k)]
    rows = list(enumerate(dict.fromkeys(texts)))
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r["doc_id"], r["text"], r["lines_removed"], r["lines_in"]) for r in got.collect()), key=repr)
    assert got == test_lines.brute(rows)


def test_linked_lines_share_a_block_and_pass_its_marks():
    """Words put in, taken out and changed, repeats included; in any order of the pairs."""
    rng = random.Random(6)
    ranks = np.random.default_rng(1).integers(0, 3, L.CELLS).astype(np.uint8)
    for few in (4, 30, 600):
        for _ in range(150):
            line = [rng.choice(WORDS[:few]) for _ in range(rng.randint(4, 70))]
            other = list(line)
            for _ in range(len(line) // 5 + 1):
                at = rng.randrange(len(other))
                other[at:at + rng.choice([0, 1, 1])] = [rng.choice(WORDS[:few])] * rng.choice([0, 1, 1])
            if line == other or 5 * test_lines.distance(line, other) > max(len(line), len(other)):
                continue
            lines = L.Lines(B.texts_of(pa.array([" ".join(line) + "\n" + " ".join(other)])))
            both = np.arange(2)
            key, own, place = lines.blocks(both, 0.8, ranks)
            mark = lines.marks(both)[own] | place << np.uint64(L.BITS)
            first = {k: m for k, o, m in zip(key.tolist(), own.tolist(), mark) if o == 0}
            pairs = [(first[k], m) for k, o, m in zip(key.tolist(), own.tolist(), mark) if o == 1 and k in first]
            a, b = (np.array(x, np.uint64) for x in zip(*pairs))
            assert L.marks_allow(a, b, 0.8).any()
