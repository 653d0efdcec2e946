import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tabwarden.llm import dac

VOCAB = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    return t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 600), max_size=3000), st.integers(1, 5))
def test_files_round_trip_and_random_access(ids, docs):
    cuts = sorted(random.Random(len(ids)).randint(0, len(ids)) for _ in range(docs - 1))
    counts = np.diff([0, *cuts, len(ids)])
    raw = dac.DacFile.build(range(docs), [0] * docs, counts, np.array(ids, np.uint32)).to_bytes()
    back = dac.DacFile.from_bytes(raw)
    assert back.all_ids().tolist() == ids and np.diff(back.starts.astype(int)).tolist() == counts.tolist()
    places = np.random.default_rng(1).permutation(len(ids))[:200]
    assert back.ids_at(places).tolist() == [ids[p] for p in places]


def expected(rows, library):
    """Rows sorted as the files have them (ids are unique here)."""
    start = 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        yield doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_written_and_read(spark, library, monkeypatch):
    rng = random.Random(2)
    words = ["the", "naïve", "it's", "<|endoftext|>", "漢字", "\n\n", "x" * 3000, "don't", "42", "…"]
    rows = [(i * 3 - 50, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(None, "no id"), (1000, None), (1001, "")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    folder = dac.new_folder(spark)
    files = dac.write_ids(docs, VOCAB, folder, docs_per_file=10)
    assert files.count() >= 6
    got = [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in
           dac.read_ids(files, folder).orderBy("start").collect()]
    assert got == list(expected(rows, library))
    total = sum(g[2] for g in got)
    asked = spark.createDataFrame([(0,), (total - 1,), (total,), (-1,), (None,), (17,)], "place long")
    ids = [i for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
           for i in library.encode(t or "", add_special_tokens=False).ids + [2]]
    found = {r["place"]: r["id"] for r in dac.token_at(spark, files, folder, asked).collect()}
    assert found == {0: ids[0], total - 1: ids[-1], total: None, -1: None, None: None, 17: ids[17]}


def test_repeated_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(7, "b"), (7, "a"), (7, "b")], "doc_id long, text string")
    folder = dac.new_folder(spark)
    files = dac.write_ids(docs, VOCAB, folder)
    assert [(r["start"], r["n_tokens"]) for r in dac.read_ids(files, folder).orderBy("start").collect()] == [(0, 2), (2, 2), (4, 2)]
    empty = dac.write_ids(docs.limit(0), VOCAB, dac.new_folder(spark))
    assert empty.count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = entry.queries()["op7_dac"](spark, sf).orderBy("start").collect()
    assert [tuple(r) for r in got] == list(expected(rows, library))
