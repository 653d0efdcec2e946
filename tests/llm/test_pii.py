import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tabwarden.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def fits(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), no, m.end(), kind) for no, (kind, pattern) in enumerate(BASE.items())
             for m in re.finditer(pattern, text or "") if fits(kind, m.group())]
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found)]


def with_luhn(rng, n):
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def odd_texts(n):
    rng = random.Random(4)
    bits = ["a.b@c.d", "_x@e-f.g.h", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "007.0008.1.255", "1..2.3.4.5", "12.3.4", "+1 (017) 555-7713",
            "+1", "+12345678901234567", "+1 2 3 4 5 6 7 8 9 0.", "é", "𝔸", " ", "-", ".", "5", " 5 5", "call ", "\n", "x",
            "4539 1488-0343 6467", "00000000000000", "1" * 20, "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432",
            "GB82WEST12345698765433", "SSN 123-45-6789", "123-45-6789", "phone (201) 555-0123", "%+-", "@x", "@x.y"]
    for _ in range(n):
        parts = [rng.choice(bits) for _ in range(rng.randint(0, 12))] + [with_luhn(rng, rng.randint(13, 20))] * rng.randint(0, 1)
        rng.shuffle(parts)
        yield rng.choice(["", " "]).join(parts)


def test_base_spans_are_those_of_the_patterns(spark):
    texts = [*odd_texts(3000), None, "", "9" * 30_000, "a" * 30_000 + "@", "a@" * 5000, "1.2.3.4 " * 2000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    found = pii.find_personal_data(docs.repartition(8))
    base = pii.joined(F.filter("spans", lambda s: s["base"]))
    got = {r["doc_id"]: r for r in found.select("doc_id", base.alias("mine"), "spans").collect()}
    for i, t in enumerate(texts):
        assert got[i]["mine"] == ",".join(base_spans(t)), t and t[:200]
        assert all((t or "")[s["start"]:s["end"]] for s in got[i]["spans"])
    assert found.limit(0).count() == 0 and "base" in found.columns


@pytest.mark.parametrize("text, kinds", [
    ("pay to DE89 3704 0044 0532 0130 00 today", ["iban"]),
    ("pay to DE89 3704 0044 0532 0130 01 today", []),
    ("GB82WEST12345698765432", ["iban"]),
    ("number 123-45-6789 here", []),
    ("social security number 123-45-6789", ["ssn"]),
    ("ssn 000-45-6789", []),
    ("tel. (201) 555-0123", ["local_phone"]),
    ("room (201) 555-0123", []),
    ("call +1 (201) 555-0123", ["phone"]),
])
def test_checksums_and_context(spark, text, kinds):
    row = pii.find_personal_data(spark.createDataFrame([(text,)], "text string")).first()
    assert [s["kind"] for s in row["spans"]] == kinds


def test_context_raises_scores_and_redaction(spark):
    df = spark.createDataFrame([("mail me: a@b.c, or a@b.c",), ("a@b.c",), (None,)], "text string")
    out = pii.redact(pii.find_personal_data(df)).collect()
    assert [r["text"] for r in out] == ["mail me: [EMAIL], or [EMAIL]", "[EMAIL]", None]
    assert out[0]["spans"][0]["score"] > out[1]["spans"][0]["score"]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in entry.queries()["op5_pii"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        spans = base_spans(r["text"])
        mine = got[r["doc_id"]]
        assert mine["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [mine[f"n_{k}"] for k in BASE] == [sum(s.startswith(k + ":") for s in spans) for k in BASE]
        assert set(spans) <= set(mine["spans"].split(",")) | {""}
