import hashlib

import public_tokenizers
import pytest
import test_decontaminate
import test_jaccard
import test_lines
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from tabwarden.llm import bpe, language

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(spark, rows, items):
    """The stages by the brute-force versions of the other tests; languages by the operator itself."""
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = language.identify(docs, language.learn(docs)).filter("lang_pred <> 'und' and score >= 0.5")
    rows = [(r["doc_id"], r["text"]) for r in labels.collect()]
    rows = [(d, t) for d, t, gone, _ in test_lines.brute(rows) if not gone or t.split()]
    rows = sorted({(d, t) for (d, t) in rows})
    group = {d: c for d, _, c, _ in test_jaccard.brute(rows)}
    rows = [(d, t) for d, t in rows if group[d] == d]
    bad = {d for d, _ in test_decontaminate.brute(rows, items)}
    vocab = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(vocab), special_tokens={})
    return sorted((d, len(library.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows if d not in bad)


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = entry.queries()["pipeline"](spark, sf)
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in got.collect()) == brute(spark, rows, items)


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns_and_take_odd_rows(spark, k):
    text = "the words of this document are all its own, and there are enough of them to be kept by every stage"
    rows = [(1, text, "en", "s", len(text)), (1, text, "en", "s", len(text)), (2, None, None, None, None),
            (3, "", "en", None, 0), (None, "another text " + text[::-1], None, "s", None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", row_id string, line int")
    _, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} >= {1, None}
    assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
