"""Answers that outlive the run that asked for them."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tabwarden.operators import classify
from tabwarden.plans.screen import screen_dataset
from tabwarden.sources.answer_store import AnswerStore
from tabwarden.sources.tables import Table

GOOD = ('{"evaluation": "not_pii", "reasoning": "r"}', 10, 5, 1.5)


def prompts_of(spark, n):
    return spark.range(n).select(F.concat(F.lit("p"), "id").alias("prompt_id"), F.concat(F.lit("prompt "), "id").alias("prompt"),
                                 F.lit("evaluation").alias("required_key"))


def test_a_stopped_run_goes_on_where_it_stopped(spark, tmp_path):
    store = AnswerStore(spark, str(tmp_path / "answers"), "m")
    assert store.read().isEmpty()

    def half(ps):
        return [GOOD if int(p.split()[1]) % 2 else "junk" for p in ps]

    class Stopped(Exception):
        pass

    def stop(seconds):
        raise Stopped

    with pytest.raises(Stopped):        # after the first round
        classify.run_classifier(prompts_of(spark, 6), half, (1,), sleep=stop, store=store)
    assert sorted(r.prompt_id for r in store.read().collect()) == ["p1", "p3", "p5"]
    asked = tmp_path / "asked"
    asked.mkdir()
    folder = str(asked)

    def noting(ps):
        for p in ps:
            open(f"{folder}/{p}", "x").close()      # fails if a prompt is asked twice
        return [GOOD] * len(ps)

    log = classify.run_classifier(prompts_of(spark, 8), noting, (0,), store=store)
    got = {r.prompt_id: (r.attempt, r.valid, r.prompt_tokens) for r in log.collect()}
    assert got == {f"p{i}": (0, True, 0) if i in (1, 3, 5) else (1, True, 10) for i in range(8)}
    assert sorted(os.listdir(folder)) == [f"prompt {i}" for i in (0, 2, 4, 6, 7)]

    def never(ps):
        raise AssertionError("all is known")

    assert classify.run_classifier(prompts_of(spark, 8), never, (0,), store=store).filter("attempt = 0 and valid").count() == 8
    store.compact()
    assert len(store._rounds()) == 1 and store.read().count() == 8
    other = AnswerStore(spark, str(tmp_path / "answers"), "another model")
    assert other.read().isEmpty()


def test_an_incomplete_round_does_not_count(spark, tmp_path):
    store = AnswerStore(spark, str(tmp_path / "answers"))
    (tmp_path / "answers" / "round-x").mkdir(parents=True)
    assert store.read().isEmpty()


def test_usage_counts_only_calls(spark, tmp_path):
    table = Table(spark.range(300).selectExpr("concat('secret-', id) as token", "id + 5000 as code"), "t.csv", dataset_id="d")
    store = AnswerStore(spark, str(tmp_path / "answers"))

    def run(responder):
        res = screen_dataset(spark, [table], responder=responder, waits=(), answers=store)
        return res.run.first(), sorted(map(tuple, res.results.collect()))

    first, results = run(lambda ps: [GOOD] * len(ps))
    again, same = run(lambda ps: ["junk"] * len(ps))
    assert results == same and (first.n_calls, first.prompt_tokens) == (2, 20) and not again.n_calls


def test_calls_are_spaced(spark):
    began = time.monotonic()
    log = classify.run_classifier(prompts_of(spark, 128), lambda ps: [GOOD] * len(ps), (), parallelism=1, calls_per_second=2)
    assert log.count() == 128 and time.monotonic() - began > 1.5      # four calls, half a second apart
