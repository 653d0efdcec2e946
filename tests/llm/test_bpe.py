import hashlib
import random
import struct

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tabwarden.llm import batches as B, bpe, pieces

pa = pytest.importorskip("pyarrow")
VOCAB = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(VOCAB)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n: int, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    letters = "ab'strevlmd  \n\t\xa0\x0b\x1cé1２²!?.　_漢字'’𝔸x "
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_pieces_are_the_pattern_matches():
    texts = odd_texts(4000) + ["", "don't we'll they've 'S x's's ''s '", " \n\n  x", "a  ", "  "]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    pattern = regex.compile(public_tokenizers.PATTERN)
    for rows, own in B.slices([batch], "text", 2048):
        spans = pieces.piece_spans(own)
        raw = own.data.tobytes()
        got = [[] for _ in range(rows.num_rows)]
        for s, e, k in zip(spans.start.tolist(), spans.end.tolist(), spans.text.tolist()):
            got[k].append(raw[s:e].decode())
        assert got == [[m.group() for m in pattern.finditer(t)] for t in rows.column("text").to_pylist()]


@pytest.mark.parametrize("letters", ["ab", "aeiou ", "thequick", "éèàñ", "=-", "ab漢", " ", "a"])
def test_trees_equal_the_library(ranks, library, letters):
    rng = random.Random(5)
    tree = bpe.TreeBpe(ranks)
    for n in (1, 2, 3, 31, 32, 33, 64, 65, 129, 500, 1500):
        piece = "".join(rng.choice(letters) for _ in range(n)).encode()
        assert tree.encode(piece) == library.encode_single_piece(piece) if hasattr(library, "encode_single_piece") \
            else tree.encode(piece) == list(library._encode_single_piece(piece))


def test_join_is_associative(ranks):
    rng = random.Random(8)
    tree = bpe.TreeBpe(ranks)
    for _ in range(200):
        a, b, c = (bytes(rng.choice(b"abeht =") for _ in range(rng.randint(0, 40))) for _ in range(3))
        ta, tb, tc = map(tree.tree, (a, b, c))
        assert tree.join(tree.join(ta, tb), tc) == tree.join(ta, tree.join(tb, tc)) == tree.merged(a + b + c)


def test_frames(spark, library):
    texts = odd_texts(300) + [None, "", "x" * 50_000, "Hello <|endoftext|> there"]
    rows = [(i, t, "mine") for i, t in enumerate(texts)] + [(3, texts[3], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    done = bpe.decode(bpe.encode(docs, VOCAB), VOCAB)
    got = bpe.id_arrays(done).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    assert bpe.encode(docs.limit(0), VOCAB).count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(bytearray(struct.pack("<I", 60000)),)], "ids binary"), VOCAB).collect()


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in entry.queries()["op1_bpe"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect():
        ids = library.encode_ordinary(r["t"])
        mine = got[r["doc_id"]]
        assert mine["n_tokens"] == len(ids)
        assert mine["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert mine["decoded_sha256"] == hashlib.sha256(r["t"].encode()).hexdigest()
