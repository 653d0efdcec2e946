"""Prompts, batch classification with retries, and verdicts.

The classifier itself is injected: a function that answers a list of prompts.
Pattern floors never reach a prompt; they meet the answers in the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .. import rules
from ..functions import answers, text
from ..plans.durable import durable
from ..sources.answer_store import AnswerStore

# An answer is a text, or (text, prompt_tokens, completion_tokens, seconds), or None for a failed call.
Responder = Callable[[list[str]], Sequence[object]]
ATTEMPTS = ("prompt_id string, attempt int, raw string, prompt_tokens bigint, "
            "completion_tokens bigint, seconds double")


def build_prompts(columns: DataFrame, tabulations: DataFrame) -> DataFrame:
    """(col_id, required_key, prompt_id, prompt) for candidate columns.

    Coordinate columns are judged by name and label alone; their values are not shown.
    """
    head = F.concat(
        F.lit("Screen one column of a research table for personal data.\n\nFile: "), F.col("file"),
        F.lit("\nColumn: "), F.col("col_name"), F.lit("\nLabel: "), F.col("label"))
    standard = F.concat(
        head, F.lit("\nType: "), F.col("spark_type"), F.lit("\nRows: "), F.col("n_rows").cast("string"),
        F.lit("\n\nValues, with count and share of rows:\n"), F.coalesce("tabulation", F.lit("")),
        F.lit(
            "\n\nJudge the values, not the name alone. Choose one evaluation:\n"
            "direct_pii: identifies a person by itself, such as names, contact details, exact places\n"
            "internal_id: a unique number or code used only inside the study\n"
            "possible_indirect: may identify a person together with other columns\n"
            "not_pii: categories, codes, measurements, survey timestamps\n"
            "consent: records whether or how consent was given\n"
            'Answer with one JSON object: {"reasoning": "...", "evaluation": "..."}'))
    coordinate = F.concat(
        head,
        F.lit("\n\nTogether with a nearby column the values could be positions on land. "
              "From name and label only: is this a latitude or longitude?\n"
              'Answer with one JSON object: {"reasoning": "...", '
              '"looks_like_coordinate": "yes", "no" or "unclear"}'))
    gps = F.col("reason_code") == "gps"
    return (columns.join(tabulations, "col_id", "left")
            .select("col_id",
                    F.when(gps, "looks_like_coordinate").otherwise("evaluation").alias("required_key"),
                    F.when(gps, coordinate).otherwise(standard).alias("prompt"))
            .withColumn("prompt_id", F.sha2("prompt", 256)))


# Prompts in one call, by attempt: what was in a failed call is asked alone from then on.
CALL_SIZES = (32, 1)


def full_answer(answer: object) -> tuple[str | None, int, int, float]:
    """Text, tokens and seconds of an answer; one that is neither a text nor such a tuple is a failed attempt."""
    if isinstance(answer, str):
        return answer, 0, 0, 0.0
    if isinstance(answer, tuple) and len(answer) == 4 and isinstance(answer[0], (str, type(None))):
        try:
            return answer[0], int(answer[1]), int(answer[2]), float(answer[3])
        except (TypeError, ValueError):
            pass
    return None, 0, 0, 0.0


def ask(prompts: DataFrame, responder: Responder, attempt: int, seconds_per_call: float = 0) -> DataFrame:
    """One round of calls in the Python workers, a few prompts at a time, and a row for every prompt.

    A call that fails is a failed attempt of all its prompts; they are asked again in
    the next round, in smaller calls. Answers that a call leaves out are failed attempts.
    A task begins no call earlier than seconds_per_call after the one before.
    """
    size = CALL_SIZES[min(attempt, len(CALL_SIZES)) - 1]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free = 0.0
        for batch in batches:
            for low in range(0, len(batch), size):
                part = batch.iloc[low : low + size]
                time.sleep(max(0.0, free - time.monotonic()))
                free = time.monotonic() + seconds_per_call
                try:
                    given = list(responder(part["prompt"].tolist()))
                except Exception:
                    given = []
                given = (given + [None] * len(part))[: len(part)]
                rows = [(prompt_id, attempt, *full_answer(a)) for prompt_id, a in zip(part["prompt_id"], given)]
                yield pd.DataFrame(rows, columns=["prompt_id", "attempt", "raw", "prompt_tokens",
                                                  "completion_tokens", "seconds"])

    return prompts.select("prompt_id", "prompt").mapInPandas(call, ATTEMPTS)


def with_validity(attempts: DataFrame, keys: DataFrame) -> DataFrame:
    """Parse each attempt; it is valid if the answer holds the required key."""
    parsed = attempts.join(keys, "prompt_id").withColumn("answer", answers.answer_json(F.col("raw")))
    value = F.when(
        F.col("required_key") == "evaluation", answers.answer_field(F.col("answer"), "evaluation")
    ).otherwise(answers.answer_field(F.col("answer"), "looks_like_coordinate"))
    return parsed.withColumns({
        "value": value,
        "reasoning": F.coalesce(answers.answer_field(F.col("answer"), "reasoning"), F.lit("")),
        "valid": value.isNotNull(),
    })


def run_classifier(prompts: DataFrame, responder: Responder, waits: Sequence[float] = rules.ATTEMPT_WAITS,
                   parallelism: int | None = None, sleep: Callable[[float], None] = time.sleep,
                   store: AnswerStore | None = None, calls_per_second: float | None = None) -> DataFrame:
    """The attempts log: every prompt is asked until an answer is valid, four times at most.

    Equal prompts are asked once. Each round is kept in the shared folder before
    it is used, so a lost executor never repeats calls that were answered, and
    the wait between rounds is spent once and not per column. What a store has an answer
    for is not asked; that answer is attempt 0 of the log, without tokens or time. Valid answers
    go to the store after each round. All tasks together make calls_per_second calls at most.
    """
    tasks = parallelism or prompts.sparkSession.sparkContext.defaultParallelism
    keys = prompts.select("prompt_id", "required_key").distinct()
    pending = prompts.groupBy("prompt_id").agg(
        F.first("prompt").alias("prompt"), F.first("required_key").alias("required_key"))
    log = None
    if store is not None:
        known = store.read().select("prompt_id", F.lit(0).alias("attempt"), "raw", F.lit(0).cast("bigint").alias("prompt_tokens"),
                                    F.lit(0).cast("bigint").alias("completion_tokens"), F.lit(0.0).alias("seconds"))
        log = durable(with_validity(known, keys).filter("valid"))
        pending = pending.join(log.select("prompt_id"), "prompt_id", "left_anti")
        if pending.isEmpty():
            return log
    pending = pending.repartition(tasks)
    gap = tasks / calls_per_second if calls_per_second else 0
    for attempt in range(1, len(waits) + 2):
        done = durable(with_validity(ask(pending, responder, attempt, gap), keys))
        if store is not None:
            store.add(done)
        log = done if log is None else log.unionByName(done)
        missed = done.filter(~F.col("valid")).select("prompt_id")
        pending = pending.join(missed, "prompt_id", "left_semi")
        if attempt > len(waits) or missed.isEmpty():
            break
        sleep(waits[attempt - 1])
    return log


def first_valid(attempts: DataFrame, key: str = "prompt_id") -> DataFrame:
    """The first valid attempt per key; keys without one are absent."""
    order = Window.partitionBy(key).orderBy("attempt")
    return (attempts.filter("valid").withColumn("rn", F.row_number().over(order))
            .filter("rn = 1").drop("rn"))


def merge_verdicts(columns: DataFrame) -> DataFrame:
    """Add evaluation and reasoning to rows of (is_gps, value, answer_reasoning, floor_met, note).

    value is the classifier's answer or null; a floor forces direct_pii and keeps
    the classifier's own view in the text.
    """
    value, why = F.col("value"), F.coalesce(F.col("answer_reasoning"), F.lit(""))
    floor = F.coalesce(F.col("floor_met"), F.lit(False))
    word = answers.first_word(value)
    failed = f"no usable answer in {rules.MAX_ATTEMPTS} attempts"
    gps_note = "Values pair with a neighbouring column as positions on land."
    evaluation = (
        F.when(F.col("is_gps"), F.when(word == "no", "not_pii").otherwise("direct_pii"))
        .when(floor, "direct_pii").when(value.isNull(), "error").otherwise(value))
    gps_reason = (
        F.when(value.isNull(), F.lit(f"Possible coordinate. {gps_note} Classifier: {failed}; kept to be safe."))
        .when(word == "yes", F.concat(F.lit(f"Coordinate. {gps_note} Name or label agrees. Classifier: "), why))
        .when(word == "no", F.concat(F.lit(f"Not a coordinate. {gps_note} Name or label says otherwise. "
                                           "Classifier: "), why))
        .otherwise(F.concat(F.lit(f"Possible coordinate. {gps_note} Name or label does not tell. "
                                  "Classifier: "), why)))
    reasoning = (
        F.when(F.col("is_gps"), gps_reason)
        .when(floor & value.isNull(), F.concat(F.col("note"), F.lit(f" Classifier: {failed}")))
        .when(floor & (value == "direct_pii"), F.concat(F.col("note"), F.lit(" Classifier: "), why))
        .when(floor, F.concat(F.col("note"), F.lit(" Classifier: "), why,
                              F.lit(" (its own verdict: "), value, F.lit(")")))
        .when(value.isNull(), F.lit(f"Classifier: {failed}"))
        .otherwise(why))
    return columns.withColumns({"evaluation": evaluation, "reasoning": text.strip_controls(reasoning)})


def unexpected_evaluations(verdicts: DataFrame) -> DataFrame:
    """Issue rows for evaluations outside the known list; the verdict itself is kept."""
    known: Column = F.col("evaluation").isin(*rules.EVALUATIONS, "error", rules.DRY_RUN_EVALUATION)
    return verdicts.filter(~known).select(
        "dataset_id", F.lit("WARNING").alias("level"),
        F.concat(F.lit("unknown evaluation '"), "evaluation", F.lit("' for column "), "col_name",
                 F.lit(" in "), "file").alias("message"))
