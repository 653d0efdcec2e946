"""Text patterns against plain Python definitions."""

import ipaddress
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabwarden import rules
from tabwarden.functions import answers, names, paths, text


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def nine_free_digits(s):
    """Whether nine digits stand in one stretch of digits, dashes and blanks that neither
    follows nor runs into a letter, digit, underscore or dot."""
    def joins(i):
        return 0 <= i < len(s) and (s[i].isalnum() or s[i] in "_.")

    def inside(i):
        return i < len(s) and (s[i].isdecimal() or s[i] == "-" or s[i].isspace())

    for start in range(len(s)):
        if joins(start - 1):
            continue
        digits, i = 0, start
        while inside(i):
            digits += s[i].isdecimal()
            i += 1
            if digits >= 9 and not joins(i):
                return True
    return False


def test_long_digits_random(spark):
    rnd = random.Random(7)
    values = ["".join(rnd.choice("0123456789 -.a_\n") for _ in range(rnd.randint(0, 24))) for _ in range(6000)]
    assert column(spark, values, text.has_long_digits) == [nine_free_digits(v) for v in values]


def test_long_digits_by_hand(spark):
    yes = ["123456789", "123-45-6789", "555 010 1234 x", "1 2 3 4 5 6 7 8 9", "x 123456789-", "--123456789", "٣٣٣٣٣٣٣٣٣"]
    no = ["12345678", "a123456789", "1.123456789", "123456789.", "12345 6789é", "", "-- --"]
    assert column(spark, yes + no, text.has_long_digits) == [True] * len(yes) + [False] * len(no)


def test_email_and_web_by_hand(spark):
    emails = ["a@b.co", "x a.b+c-d_e@mail-1.example.org!", "é@é.com", "@a@b.cc", "a@b.c1 a@b.co", "A@B.COM", "1@2.xy"]
    others = ["", "a@b", "a@b.c", "a@ b.co", "@b.co", "a@.co", "a b.co", "a@b.12", "ab.co@", "a@b,co", "mail at b.co"]
    assert column(spark, emails + others, text.has_email) == [True] * len(emails) + [False] * len(others)
    sites = ["www.x", "see http://a", "HTTPS://a.b", "WWW.é", "xwww.y", "http://www.", "(https://)"]
    plain = ["", "www.", "www. x", "http:/a", "https://", "http:// a", "ww.x", "ftp://x"]
    assert column(spark, sites + plain, text.has_web) == [True] * len(sites) + [False] * len(plain)


def test_platform_ids(spark):
    a = "A" + "B" * 9
    values = ["0" * 24, "0" * 23, "0" * 25, " \t" + "aB3" * 8 + "\n", "g" * 24, a, a[:-1], "A" + "1" * 20,
              "A" + "1" * 21, " " + a.lower() + " "]
    assert column(spark, values, text.is_prolific) == [True, False, False, True] + [False] * 6
    assert column(spark, values, text.is_mturk) == [False] * 5 + [True, False, True, False, True]


PRIVATE = [ipaddress.ip_network(n) for n in ("0.0.0.0/32", "10.0.0.0/8", "127.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16",
                                             "169.254.0.0/16", "100.64.0.0/10")]


def ip_grade(v):
    """0: no address, 1: a part above 255, 2: private, 3: public. Zeros in front do not count."""
    parts = v.strip().split(".")
    if len(parts) != 4 or not all(p.isdecimal() and len(p) <= 3 for p in parts):
        return 0
    if any(int(p) > 255 for p in parts):
        return 1
    address = ipaddress.ip_address(".".join(str(int(p)) for p in parts))
    return 2 if any(address in net for net in PRIVATE) else 3


def test_ip_grades(spark):
    rnd = random.Random(9)
    edge = [0, 1, 9, 10, 15, 16, 31, 32, 63, 64, 99, 100, 127, 128, 168, 169, 172, 192, 254, 255, 256, 999]
    values = [".".join(str(rnd.choice(edge)) for _ in range(4)) for _ in range(8000)]
    values += [".".join(f"{rnd.choice(edge):03d}" for _ in range(4)) for _ in range(2000)]
    values += ["10.0.0", "1.2.3.4.5", " 8.8.8.8\n", "8.8.8.8x", "", "0.0.0.0", "1234.1.1.1"]
    assert column(spark, values, text.ip_class) == [ip_grade(v) for v in values]


def test_controls_and_trim(spark):
    assert column(spark, ["a\x00b\x0cc\x7f\t\n\r", "  x "], text.strip_controls) == ["abc\t\n\r", "  x "]
    assert column(spark, ["  x y \n"], text.trim_ws) == ["x y"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3000), st.integers(1, 3000)), min_size=200, max_size=400))
def test_one_decimal_equals_python(spark, pairs):
    shares = [min(a, b) / max(a, b) * 100 for a, b in pairs] + [0.05, 0.15, 0.25, 0.35, 12.25, 12.75, 99.95, 100.0, 0.0]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(shares)], "i int, s double")
    got = [r[0] for r in df.orderBy("i").select(text.one_decimal(F.col("s"))).collect()]
    assert got == [f"{s:.1f}" for s in shares]


def test_number_text(spark):
    values = [5.0, 40.0009765625, 12345678.0, 0.1, 1e-4, -3.25, 1e15]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(text.plain_double(F.col("x")))
    assert [r[0] for r in df.collect()] == ["5.0", "40.0009765625", "12345678.0", "0.1", "0.0001", "-3.25",
                                            "1000000000000000.0"]


def test_padded_row_never_cuts(spark):
    long = "v" * 60
    row = spark.range(1).select(text.padded_row(F.lit(long), F.lit(12345678), F.lit(12.5))).first()[0]
    assert row == f"  {long:<50} {12345678:>6} ({12.5:.1f}%)"
    row = spark.range(1).select(text.padded_row(F.lit("ab"), F.lit(3), F.lit(0.25))).first()[0]
    assert row == f"  {'ab':<50} {3:>6} ({0.25:.1f}%)"


@pytest.mark.parametrize("name, label, expected", [
    ("age", "", True), ("AGE_1", "", True), ("village", "", True), ("manager", "", True), ("page_id", "", True),
    ("average", "", False), ("percentage", "", False), ("storage", "", False), ("message", "", False),
    ("image", "", False), ("stage", "", False), ("coverage", "", False), ("language", "", False), ("wage", "", False),
    ("q12", "Date of birth", True), ("x", "Discapacidad", True), ("stage_age", "", True), ("score", "", False),
    (None, "Religion", True), ("fecha_nacimiento", None, True),
])
def test_forced_names(spark, name, label, expected):
    df = spark.createDataFrame([(name, label)], "n string, l string")
    assert df.select(names.is_forced_name(F.col("n"), F.col("l"))).first()[0] is expected


@pytest.mark.parametrize("name, label, expected", [
    ("WorkerId", "", True), (" workerid ", "", True), ("worker_id", "", False), ("q1", "Prolific ID", True),
    ("mturk_id", "", True), ("mturkcode", "", False), ("q1", "MTurk code mturkcode", False), ("0", None, False),
    ("mturkcode", "mturk", True),
])
def test_platform_names(spark, name, label, expected):
    df = spark.createDataFrame([(name, label)], "n string, l string")
    assert df.select(names.is_platform_name(F.col("n"), F.col("l"))).first()[0] is expected


@pytest.mark.parametrize("raw, expected", [
    ('{"evaluation": "a"}', "a"),
    ('x ```json\n{"evaluation": "a"}\n``` y', "a"),
    ('```\n{"evaluation": "a"}\n```\n```json\n{"evaluation": "b"}\n```', "b"),
    ('```json\n{"evaluation": "a"}\n```\n```json\n{broken\n```', "a"),
    ('```json\n{"evaluation": "a"}\n```\n```json\n{"other": 1}\n```', None),
    ("junk", None), (None, None), ("", None), ("5", None), ('```json\nnope\n``` {"evaluation": "a"}', None),
])
def test_answers(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "r string")
    assert df.select(answers.answer_field(answers.answer_json(F.col("r")), "evaluation")).first()[0] == expected


def test_first_word(spark):
    assert column(spark, ["yes", " Yes!", "No.", "no, it's a score", "unclear", "", "1no"], answers.first_word) == [
        "yes", "yes", "no", "no", "unclear", "", ""]


def test_paths(spark):
    listed = ["a/b.csv", ".DS_Store", "x/._a.csv", "__macosx/a.csv", "d/.git/c.csv", "Thumbs.DB", "a/desktop.ini", "a.b/c"]
    assert column(spark, listed, paths.is_junk) == [False, True, True, True, True, True, True, False]
    kinds = column(spark, ["a.tar.gz", "A.TGZ", "a.csv.gz", "a.ZIP", "a.rar", "a.7z", "a.tar.bz2", "a.csv"], paths.archive_kind)
    assert kinds == ["tar", "tar", "gz", "zip", "rar", "7z", "tar", None]
    assert column(spark, ["a/b.CSV", "x.txt", "p.parquet", "noext", ".csv"], paths.load_kind) == [
        "delimited", "sniffed", "columnar", None, None]
    assert rules.MAX_ATTEMPTS == 4
