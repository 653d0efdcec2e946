"""Answers of a classifier that outlive the run that asked for them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import Storage

ANSWER = "prompt_id string, raw string, model string"


class AnswerStore:
    """Valid answers by the digest of their prompt, in a folder for each round of calls.

    A round counts once it is complete, so a stopped run loses the calls of one round at
    most. Rounds only add rows; of several answers to one prompt any is as good.
    """

    def __init__(self, spark: SparkSession, folder: str, model: str = ""):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.model = model

    def _rounds(self) -> list[str]:
        at = Storage(self.spark, self.folder)
        return [f"{self.folder}/{n}" for n in at.listed() if n.startswith("round-") and at.exists(n, "_SUCCESS")]

    def read(self) -> DataFrame:
        """(prompt_id, raw): one valid answer of this model for each prompt that has one."""
        rounds = self._rounds()
        if not rounds:
            return self.spark.createDataFrame([], "prompt_id string, raw string")
        kept = self.spark.read.schema(ANSWER).parquet(*rounds).filter(F.col("model") == self.model)
        return kept.groupBy("prompt_id").agg(F.min("raw").alias("raw"))

    def add(self, attempts: DataFrame) -> None:
        """Keep the valid answers of a round."""
        valid = attempts.filter("valid").select("prompt_id", "raw", F.lit(self.model).alias("model"))
        valid.write.parquet(f"{self.folder}/round-{uuid.uuid4().hex}")

    def compact(self) -> None:
        """Fold all rounds into one. Not while another driver writes or reads them."""
        rounds = self._rounds()
        if len(rounds) < 2:
            return
        kept = self.spark.read.schema(ANSWER).parquet(*rounds)
        kept.groupBy("model", "prompt_id").agg(F.min("raw").alias("raw")).write.parquet(f"{self.folder}/round-{uuid.uuid4().hex}")
        at = Storage(self.spark, self.folder)
        for r in rounds:
            at.delete(r.rpartition("/")[2])
