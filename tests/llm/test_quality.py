import random
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
from tabwarden.llm.quality import quality_rules

GAP = re.compile("[\x20\x09-\x0d]+")


def words_of(text):
    return [w for w in GAP.split(text) if w]


def figures(text):
    text = text or ""
    words = words_of(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    marked = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 3)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(marked))


def norm(line):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
    return " ".join(re.sub("[0-9]+", "0", w) for w in words_of(low))


def brute(rows, max_docs, min_left=0.3, min_words=50):
    docs = Counter()
    for _, text, host in rows:
        docs.update({(host, norm(line)) for line in (text or "").split("\n")})
    out = []
    for doc, text, host in rows:
        f = figures(text)
        gone = sum(len(words_of(line)) for line in (text or "").split("\n") if docs[host, norm(line)] > max_docs)
        failed = f[0] < min_words or 100 * f[4] > 50 * f[0]
        out.append((doc, *f, gone, failed, not failed and f[0] - gone >= min_left * f[0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = ["Page 12 of 90", "page  7 of 3 ", "The SAME line", "a b a b a b", "été | x", "\t", "", "1st", "2nd 9",
             *(" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 20))) for _ in range(12))]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9))), rng.choice(["h", "g", None])) for i in range(150)]
    rows += [(150, None, "h"), (151, "", "h"), (152, "\n", None), (153, "x " * 20_000, "g"), (3, rows[3][1], "h"), (None, "7", "")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, line int, kept string")
    got = quality_rules(docs, max_docs=6, min_words=10)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 6, min_words=10)
    assert quality_rules(docs.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = entry.queries()["op8_quality"](spark, sf)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 100)
