import re
import zlib
from collections import Counter, defaultdict

import pytest

from tabwarden.llm import spelling

LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def by_hand(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    masked = defaultdict(set)       # equal when one code point is left out
    for w in words:
        for i in range(len(w) + 1):
            masked[w[:i] + "*" + w[i:]].add(w)
            if i < len(w):
                masked[w[:i] + "*" + w[i + 1:]].add(w)
    near = defaultdict(set)
    for group in masked.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_against_brute_force(spark):
    from tabwarden.llm.queries import QUERIES, table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = rows_of(QUERIES["op11_spelling"](spark, "/root/testdata/sf0.01"))
    assert got == by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[1] is not None for r in got) > 100 and sum(r[4] > 1 for r in got) > 100


@pytest.mark.parametrize("tile, tile_bytes", [(2048, 4 << 20), (3, 4 << 20), (2048, 30)])
def test_edges(spark, tile, tile_bytes):
    long = "x" * 300 + "é" * 2_000
    base = "abcdefgh écoleÿs ABCDEFGH abcdefghi abcdefgi abcxefgh xabcdefgh bcdefghij "
    stems = " ".join(f"station{a}{b}" for a in "abcdefghij" for b in "klmnopqrst")
    rows = [(1, base), (1, base), (2, None), (3, ""), (None, base + "aaaaaaaa aaaaaaaaa aaaaaaaaaa"), (4, "aaaaaaaa aaaaaaaaa aaaaaaaaaa"),
            (5, f"{long} {long} {long}y {long}y"), (6, "abcdāefgh straßenbau straßenbahn ×÷×÷×÷×"),
            (7, "abcdefgh-abcdefgh\nabcdefgh\tabcdefgh " * 40), (8, "×÷×÷×÷× straßenbau straßenbahẞn"),
            (9, stems), (10, stems), (11, "ÉCOLEÿs")]
    docs = spark.createDataFrame([(i, t, "word", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert rows_of(spelling.spelling_variants(docs, tile=tile, tile_bytes=tile_bytes)) == by_hand(rows)


def test_chains_follow_to_the_last(spark):
    text = "stations " * 2000 + "station " * 150 + "statio " * 2 + "tstation " * 12
    rows = [(i, text) for i in range(3)]
    got = rows_of(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == by_hand(rows)


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_crc_goes_on_from_a_prefix():
    import numpy as np

    data = np.frombuffer(b"abcdefgh" * 20, np.uint8)
    start, length = np.array([0, 3, 8, 1]), np.array([8, 1, 100, 64])
    prefix = np.array([zlib.crc32(p) for p in (b"1:", b"", b"77:", b"-5:")], np.uint32)
    want = [zlib.crc32(bytes(data[s:s + n]), int(p)) for s, n, p in zip(start, length, prefix)]
    assert spelling.crc_on(prefix, data, start, length).tolist() == want
