import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from tabwarden.llm import language

EN = "the quick brown fox jumps over the lazy dog and then it goes home with all of its friends "
DE = "der schnelle braune Fuchs springt über den faulen Hund und geht dann mit allen Freunden nach Hause "
RU = "быстрая коричневая лиса прыгает через ленивую собаку и потом идёт домой со всеми друзьями "


@pytest.fixture(scope="module")
def model(spark):
    rows = [(EN, "en"), (DE, "de"), (RU, "ru"), (EN * 2, "en"), (None, "xx"), ("nothing", None), ("", "de")]
    return language.learn(spark.createDataFrame(rows, "text string, lang string")).cache()


def labels(spark, model, *texts):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, score string")
    return [r for r in language.identify(docs, model).orderBy("doc_id").collect()]


def test_spans_of_mixed_text(spark, model):
    mixed = EN * 3 + DE * 4 + RU * 2
    row, = labels(spark, model, mixed)
    assert [s["lang"] for s in row["lang_spans"]] == ["en", "de", "ru"]
    cuts = [len(EN) * 3, len(EN) * 3 + len(DE) * 4]
    assert [abs(s["start"] - c) < 12 for s, c in zip(row["lang_spans"][1:], cuts)] == [True, True]
    assert row["lang_pred"] == "de" and 0.3 < row["score"] < 0.6


def test_defined_cases(spark, model):
    got = labels(spark, model, None, "", "12 + 34 = !?", "Иван", "漢字", "The dog", EN * 400, "a")
    assert [(r["lang_pred"], r["score"]) for r in got[:3]] == [("und", 0.0)] * 3
    assert got[3]["lang_pred"] == "ru" and got[5]["lang_pred"] == "en" and got[6]["lang_pred"] == "en"
    assert got[4]["lang_pred"] in ("de", "en", "ru") and all(0 <= r["score"] <= 1 for r in got)
    empty = spark.createDataFrame([], "text string, lang string")
    assert language.identify(empty, model).count() == 0
    untaught, = labels(spark, language.learn(empty), EN)
    assert (untaught["lang_pred"], untaught["score"]) == ("und", 0.0)


def brute_viterbi(scores):
    """The best path over all paths' costs, word by word with plain lists."""
    best = [(0.0, [])] * len(scores[0]) if len(scores) else []
    for t, row in enumerate(scores):
        new = []
        for k, s in enumerate(row):
            came = max(range(len(best)), key=lambda j: (best[j][0] - language.SWITCH * (j != k and t > 0), j == k))
            new.append((best[came][0] - language.SWITCH * (came != k and t > 0) + s, [*best[came][1], k]))
        best = new
    return max(b[0] for b in best) if best else 0.0


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(5)
    count = np.array([0, 1, 7, 0, 30, 2, 12])
    text = np.repeat(np.arange(len(count)), count)
    scores = -rng.exponential(3, (len(text), 3)).astype(np.float32)
    found = language.viterbi(scores, text, len(count))
    for k in range(len(count)):
        own, path = scores[text == k].astype(float), found[text == k]
        cost = sum(own[i, p] for i, p in enumerate(path)) - language.SWITCH * int((path[1:] != path[:-1]).sum())
        assert cost == pytest.approx(brute_viterbi(own.tolist()), abs=1e-3)


def test_query_is_accurate_on_rows_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in entry.queries()["op3_language"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(docs)
    held = [r for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(got[r["doc_id"]]["held_out"] for r in held) and sum(g["held_out"] for g in got.values()) == len(held)
    right = sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held)
    assert right / len(held) > 0.98
