"""What op9 must not lose or multiply."""
import random

import numpy as np
import pyarrow as pa
import test_jaccard

from tabwarden.llm import jaccard as J


def test_buckets_of_different_nodes_stay_apart():
    rng = np.random.default_rng(1)
    node = rng.integers(-2**63, 2**63 - 1, 4000)
    batch = pa.RecordBatch.from_pydict({"key": np.repeat(np.arange(2000), 2), "node": node})
    out = pa.Table.from_batches(J._met([batch]))
    assert len(set(out.column("key").to_pylist())) == 2000 and sorted(out.column("node").to_pylist()) == sorted(node.tolist())


def test_near_copies_above_a_region_are_not_multiplied(spark, monkeypatch):
    monkeypatch.setattr(J, "REGION_BYTES", 30_000)
    monkeypatch.setattr(J, "LEVELS", 2)
    rng = random.Random(7)
    texts = [*test_jaccard.variants(rng, 240, 4, 120), *test_jaccard.variants(rng, 40, 9, 120)]
    rows = list(enumerate(texts))
    written, real = [], J.stored

    def counted(df, label):
        out = real(df, label)
        if label == "regions":
            written.append(out.count())
        return out

    monkeypatch.setattr(J, "stored", counted)
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == test_jaccard.brute(rows)
    assert written[0] > 100 and sum(written) <= (1 + 1.5 + 1.5 ** 2) * written[0]
