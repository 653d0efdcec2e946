"""op7 against the library as it reads its vocabulary, added tokens and all."""
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry


def test_added_tokens_are_tokens(spark, tmp_path):
    rows = [(1, "a <|endoftext|> b"), (2, "plain"), (3, "<|endoftext|><|endoftext|>naïve 漢字"), (4, None), (5, "<|endoftext|"), (6, "x<|endoftext|>")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = entry.queries()["op7_dac"](spark, str(tmp_path)).orderBy("start").collect()
    assert [tuple(r) for r in got] == want and library.token_to_id("<|endoftext|>") == 50256
