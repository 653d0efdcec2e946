"""Blocks travel packed, buckets are compared by marks and fingerprints, and no pair of lines twice."""
import random

import numpy as np
import pyarrow as pa
import pytest
import test_lines
import test_lines_links

from tabwarden.llm import batches as B, lines as L


def test_fingerprints_of_linked_lines_pass_and_of_others_do_not():
    """Long lines, of which a fingerprint of 40 bits let every pair pass."""
    rng = random.Random(8)
    for length in (30, 60, 100):
        rows = [" ".join(x) for _ in range(20) for x in test_lines_links.scattered(rng, length)]
        lines = L.Lines(B.texts_of(pa.array(["\n".join(rows)])))
        every = np.arange(len(rows))
        bits, mark = lines.fingerprints(every), lines.marks(every)
        assert L.fingerprints_allow(bits, mark, every[::2], every[1::2], 0.8).all()
        i, j = np.triu_indices(len(rows), 2)
        assert L.fingerprints_allow(bits, mark, i, j, 0.8).mean() < 0.1


def test_partners_leave_no_row_out():
    """A row whose only partner already has one keeps it; rows of other buckets are none."""
    pairs = {(0, 1), (0, 3), (5, 6)}
    ends = np.array([5] * 5 + [8] * 3)
    got = L.partners(ends, np.arange(8), lambda i, j: np.array([p in pairs for p in zip(i.tolist(), j.tolist())], bool))
    assert got.tolist() == [1, 0, -1, 0, -1, 6, 5, -1]


@pytest.mark.parametrize("held, most, paired", [(50, 3, 1000), (50, 20_000, 2), (4 << 20, 20_000, 0)])
def test_large_blocks(spark, monkeypatch, held, most, paired):
    """Blocks that are cut as they come in, and buckets compared with and without lists of pairs."""
    monkeypatch.setattr(L, "HELD", held)
    monkeypatch.setattr(L, "MOST", most)
    monkeypatch.setattr(L, "PAIRED", paired)
    rng = random.Random(13)
    rows = list(enumerate(dict.fromkeys([t for _, t in test_lines.corpus(13)] + [
        "an opening that is common " + " ".join(rng.sample(test_lines_links.WORDS, rng.randint(1, 4))) for _ in range(150)])))
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    got = sorted(((r["doc_id"], r["text"], r["lines_removed"], r["lines_in"]) for r in got.collect()), key=repr)
    assert got == test_lines.brute(rows)


def test_posts_take_sixteen_bytes(spark):
    """A block's row is 16 bytes; it was 24 when each was a row of the shuffle."""
    rng = random.Random(3)
    texts = ["\n".join(" ".join(test_lines_links.scattered(rng, 40)[0]) for _ in range(20)) for _ in range(10)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    out = list(L._posted(0.8, np.zeros(L.CELLS, np.uint8), 4)([batch]))
    posts = sum(len(v) for x in out for v in x.column("keys").to_pylist()) // 4
    bytes_ = sum(len(v) for x in out for c in ("keys", "lines", "marks") for v in x.column(c).to_pylist())
    assert posts == 200 * 17 and bytes_ == 16 * posts
