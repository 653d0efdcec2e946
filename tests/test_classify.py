"""Prompts, retries, verdicts."""

import pytest
from pyspark.sql import functions as F

from tabwarden import rules
from tabwarden.operators import classify
from tabwarden.plans.screen import finished, screen_dataset
from tabwarden.sources.tables import Table

VERDICT = "is_gps boolean, value string, answer_reasoning string, floor_met boolean, note string"


@pytest.mark.parametrize("row, evaluation, parts", [
    ((False, "consent", "why", False, ""), "consent", ["why"]),
    ((False, "not_pii", "why", True, "[N]"), "direct_pii", ["[N]", "why", "not_pii"]),
    ((False, "direct_pii", "why", True, "[N]"), "direct_pii", ["[N]", "why"]),
    ((False, None, None, True, "[N]"), "direct_pii", ["[N]", "no usable answer"]),
    ((False, None, None, False, ""), "error", ["no usable answer"]),
    ((False, "made_up", "why\x0c", None, None), "made_up", ["why"]),
    ((True, "yes", "why", False, ""), "direct_pii", ["why"]),
    ((True, "Yes!", "why", False, ""), "direct_pii", ["why"]),
    ((True, "No.", "why", False, ""), "not_pii", ["why"]),
    ((True, "no, it's a score", "why", False, ""), "not_pii", ["why"]),
    ((True, "unclear", "why", False, ""), "direct_pii", ["why"]),
    ((True, "maybe", "", False, ""), "direct_pii", []),
    ((True, None, None, False, ""), "direct_pii", ["kept to be safe"]),
])
def test_verdict_table(spark, row, evaluation, parts):
    got = classify.merge_verdicts(spark.createDataFrame([row], VERDICT)).first()
    assert got.evaluation == evaluation
    assert all(p in got.reasoning for p in parts) and "\x0c" not in got.reasoning


def prompts_of(spark, n):
    return spark.createDataFrame([(i, "evaluation", f"p{i % 3}", f"prompt {i % 3}") for i in range(n)],
                                 "col_id int, required_key string, prompt_id string, prompt string")


def test_equal_prompts_are_asked_once_and_rounds_stop(spark):
    log = classify.run_classifier(prompts_of(spark, 9), lambda ps: ['{"evaluation": "not_pii"}'] * len(ps), sleep=fail)
    assert log.count() == 3 and log.filter("valid").count() == 3


def test_left_out_and_malformed_answers_are_asked_again(spark):
    def short(ps):
        return ['{"evaluation": "consent"}'] * max(1, len(ps) - 2) if len(ps) > 1 else [("x", 1)] if "5" in ps[0] else ['{"evaluation": "consent"}']

    prompts = spark.createDataFrame([(i, "evaluation", f"p{i}", f"prompt {i}") for i in range(8)],
                                    "col_id int, required_key string, prompt_id string, prompt string")
    log = classify.run_classifier(prompts, short, parallelism=1, sleep=lambda s: None)
    assert log.filter("attempt = 1").count() == 8
    done = {r.prompt_id for r in log.filter("valid").collect()}
    assert len(done) >= 7 and log.groupBy("prompt_id").agg(F.max("attempt").alias("n")).filter("n > 4").isEmpty()


def fail(seconds):
    raise AssertionError("no wait is needed when every answer is valid")


def test_retries_until_valid_and_four_at_most(spark, tmp_path):
    marks = str(tmp_path)

    def flaky(ps):
        import os
        import time
        if "prompt 1" in ps:
            raise RuntimeError("model is down")
        out = []
        for p in ps:
            name = p.replace(" ", "_")
            n = len([f for f in os.listdir(marks) if f.startswith(name)])
            open(f"{marks}/{name}_{time.time_ns()}", "w").close()
            ok = n >= {"prompt 0": 0, "prompt 2": 2}[p]
            out.append(('{"evaluation": "consent"}', 10, 5, 1.5) if ok else ("junk", 10, 5, 0.5))
        return out

    waited = []
    log = classify.run_classifier(prompts_of(spark, 3), flaky, parallelism=1, sleep=waited.append)
    assert waited == list(rules.ATTEMPT_WAITS) == [1, 5, 10]
    per = {r.prompt_id: (r.n, r.v) for r in log.groupBy("prompt_id").agg(
        F.count("*").alias("n"), F.count_if("valid").alias("v")).collect()}
    assert per == {"p0": (2, 1), "p1": (4, 0), "p2": (4, 1)}
    assert classify.first_valid(log).filter("prompt_id = 'p1'").isEmpty()


def test_first_valid(spark):
    log = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, True), ("b", 1, False)],
                                "prompt_id string, attempt int, valid boolean")
    assert [(r.prompt_id, r.attempt) for r in classify.first_valid(log).collect()] == [("a", 2)]


def survey(spark):
    return Table(spark.range(300).selectExpr(
        "concat(substr(md5(string(id)), 1, 24)) as code", "concat('8.8.8.', id % 200) as ip",
        "40.125 + id / 1024.0D as v1", "-99.5 + id / 1024.0D as v2", "id % 5 as likert",
        "concat('secret-', id) as token"), "data/s.csv", dataset_id="d1", labels={"token": "Access\x0c token"})


def test_dry_run_and_blind_prompts(spark):
    land = spark.createDataFrame([(130, 79, 81)], "lat_idx int, lon_start int, lon_end int")
    res = screen_dataset(spark, [survey(spark)], land)
    rows = {r.col_name: r for r in res.results.collect()}
    assert set(rows) == {"code", "ip", "v1", "v2", "token"} and res.attempts is None
    assert {r.evaluation for r in rows.values()} == {"test - not checked"}
    assert rows["token"].label == "Access token" and rows["token"].tabulation.startswith("[Longest values]")
    by_name = {r.col_name: r.prompt for r in res.prompts.join(res.columns, "col_id").select("col_name", "prompt").collect()}
    for p in by_name.values():       # what the pattern checks found must never reach the classifier
        assert not any(w in p.lower() for w in ("prolific", "mturk", "[pattern", "floor"))
    assert "40.1" not in by_name["v1"] and "looks_like_coordinate" in by_name["v1"]
    assert "secret-" in by_name["token"] and "Rows: 300" in by_name["token"]


def test_whole_run(spark):
    def responder(ps):
        out = []
        for p in ps:
            if "looks_like" in p:
                out.append('{"looks_like_coordinate": "no, a score", "reasoning": "r"}')
            elif "Column: token" in p:
                out.append("garbage")
            elif "Column: ip" in p:
                out.append(('{"evaluation": "odd", "reasoning": "r"}', 7, 3, 0.25))
            else:
                out.append('{"evaluation": "not_pii", "reasoning": "r"}')
        return out

    land = spark.createDataFrame([(130, 79, 81)], "lat_idx int, lon_start int, lon_end int")
    files = spark.createDataFrame([("d1", "data/s.csv", "data/s.csv", True), ("d1", "copy.csv", "data/s.csv", False),
                                   ("d1", "readme.md", "readme.md", False)],
                                  "dataset_id string, path string, primary_path string, loaded boolean")
    res = screen_dataset(spark, [survey(spark)], land, responder, files=files, waits=(0, 0, 0), run_info={"model": "m"})
    got = {(r.file, r.col_name): r for r in res.results.collect()}
    assert len(got) == 10 and got["copy.csv", "ip"].duplicate_of == "data/s.csv"
    assert got["data/s.csv", "code"].evaluation == "direct_pii"
    assert got["data/s.csv", "v1"].evaluation == "not_pii"
    assert got["data/s.csv", "token"].evaluation == "error"
    run = finished(res.run).first()
    assert (run.n_files_total, run.n_data_files, run.n_duplicates, run.n_files_not_loaded) == (3, 1, 1, 1)
    assert (run.n_columns_total, run.n_columns_candidate, run.n_columns_checked, run.n_direct_pii) == (6, 5, 5, 4)
    assert (run.n_warnings, run.n_errors, run.n_calls, run.prompt_tokens, run.ended != "") == (0, 1, 8, 7, True)


def test_no_tables_and_a_failing_coordinate_test(spark, monkeypatch):
    files = spark.createDataFrame([("d", "a.png", "a.png", False)],
                                  "dataset_id string, path string, primary_path string, loaded boolean")
    res = screen_dataset(spark, [], None, lambda ps: [], files=files, waits=())
    run = res.run.first()
    assert res.results.isEmpty() and (run.dataset_id, run.n_files_total, run.n_columns_checked) == ("d", 1, 0)

    import tabwarden.plans.screen as screen

    def broken(*args):
        raise RuntimeError("no land today")

    monkeypatch.setattr(screen, "gps_candidates", broken)
    res = screen_dataset(spark, [survey(spark)])
    assert "no land today" in res.issues.first().message
    assert {r.col_name for r in res.results.collect()} == {"code", "ip", "token"}


def test_a_damaged_table_costs_only_itself(spark, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    spark.range(5).selectExpr("id + 5000 as id").coalesce(1).write.parquet(good)
    spark.range(5).coalesce(1).write.parquet(bad)
    tables = [Table(spark.read.parquet(bad), "bad", dataset_id="d"), Table(spark.read.parquet(good), "good", dataset_id="d")]
    part = next((tmp_path / "bad").glob("*.parquet"))
    part.write_bytes(part.read_bytes()[:40])
    (tmp_path / "bad" / f".{part.name}.crc").unlink()
    res = screen_dataset(spark, tables)
    assert [r.file for r in res.results.collect()] == ["good"]
    assert res.issues.first().message.startswith("bad: could not be read") and res.run.first().n_errors == 1
