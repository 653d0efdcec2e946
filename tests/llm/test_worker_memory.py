"""Workers live on from one stage to the next: what one operator keeps goes when another begins."""
import pyarrow as pa

from tabwarden.llm import batches as B, language

BATCH = pa.RecordBatch.from_pydict({"text": pa.array(["some words here", None])})


def test_caches_of_other_operators_go():
    own, other = B.worker_cache("bpe own"), B.worker_cache("bpe other")
    own["piece"], other["piece"] = b"1", b"2"
    texts = B.texts_of(BATCH.column("text"))
    B.span_hashes(texts.data, *B.words_of(texts)[:2])
    assert len(list(B.slices([BATCH], "text", keep=("bpe own",)))) == 1
    assert own and not other and B.worker_cache("powers")
    list(B.slices([BATCH], "text"))
    assert not own and B.worker_cache("powers")


def test_small_slices_change_no_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    small = language.SMALL_SLICE // 16
    got = [sorted(map(tuple, language.identify(docs, language.learn(docs, limit=n), limit=n).select("doc_id", "lang_pred", "score").collect()), key=repr)
           for n in (small, B.SLICE_BYTES)]
    assert got[0] == got[1]
