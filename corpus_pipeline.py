"""A training corpus from raw documents, in five stages; each reads what the one before wrote.

    language ID         rejects texts without letters, and those where no language has half of them
    line dedup          near-equal lines stay once in the corpus; documents with no word left go
    n-gram Jaccard join one document of each group of near copies stays
    decontamination     documents with a benchmark passage go
    byte-level BPE      ids of the texts, and the decoded bytes' digest

A stage makes its decisions from all rows it is given and from nothing else but
`benchmark`. Null languages are filled in; rows that repeat id and text are one document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwarden.llm import bpe, decontaminate, jaccard, language, lines
from tabwarden.llm.stored import stored

MIN_LANGUAGE_SHARE = 0.5
ORACLE_SQL = None  # Viterbi labels, SimHash and token ids are beyond SQL; tests/llm has a brute-force version


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of `docs`, and keeps what is mostly in one language."""
    small = language.SMALL_SLICE  # the workers' memory is shared with what the other stages leave
    found = language.identify(docs, language.learn(docs, limit=small), lang_col="__lang", score_col="__share",
                              spans_col="__spans", limit=small)
    kept = found.filter((F.col("__lang") != language.UNKNOWN) & (F.col("__share") >= MIN_LANGUAGE_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(docs, removed_col="__removed", lines_col="__lines")
    kept = done.filter((F.col("__removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocab = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), vocab)
    return done.select("doc_id", "lang", "source", "ids", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
