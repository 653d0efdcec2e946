"""Logged conversations: those that begin a longer one go, the others are rendered.

A log that writes a conversation after each turn holds every prefix of it. The turns of a
conversation are numbered by (turn, role, text), and each has a hash of its number, role
and text; the rolling hash of the first k turns is the exclusive-or of their hashes, in
two independent 64-bit parts. A conversation is dropped when its whole hash is the prefix
hash of a longer one, and of equal conversations the one with the least id stays.

All of it is SQL: windows, partial aggregates over (length, hash), an anti-join whose
sides have one row for each key, so that a first turn or a conversation that thousands
share is folded before it is shuffled. The windows run over blocks of BLOCK turn numbers
and are put together by the blocks' sums, so that one endless conversation is no one task.

Defined results: a row that repeats (conv_id, turn, role, text) counts once; turns of one
number stand in the order of role and text, null first; a null role or text is its own
value when hashing, and rendered as `unknown` and as nothing; rows of a null conv_id are
one conversation; an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .stored import stored

BLOCK = 1024
START, END = "<|im_start|>", "<|im_end|>"


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """conv, k (1 for the first turn), role, text, and the prefix hashes h1 and h2 of the first k turns."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).distinct()
    block = F.floor(F.coalesce(F.col("turn"), F.lit(-(1 << 62))) / BLOCK)
    rows = rows.withColumn("block", block)
    inside = Window.partitionBy("conv", "block").orderBy(
        F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    placed = rows.withColumn("place", F.row_number().over(inside).cast("long"))
    blocks = placed.groupBy("conv", "block").agg(F.max("place").alias("n"))
    ahead = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    placed = _joined(placed, blocks).withColumn("k", F.col("place") + F.col("ahead"))
    return _rolling(placed)


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["conv"].eqNullSafe(right["conv"]) & (left["block"] == right["block"])


def _joined(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    b = blocks.select(F.col("conv").alias("b_conv"), F.col("block").alias("b_block"),
                      *[c for c in blocks.columns if c not in ("conv", "block")])
    return rows.join(b, rows["conv"].eqNullSafe(b["b_conv"]) & (rows["block"] == b["b_block"])).drop("b_conv", "b_block")


def _rolling(placed: DataFrame) -> DataFrame:
    value = [F.col("k"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    placed = placed.withColumn("t1", F.xxhash64(F.lit(1), *value)).withColumn("t2", F.xxhash64(F.lit(2), *reversed(value)))
    running = Window.partitionBy("conv", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("r1", F.bit_xor("t1").over(running)).withColumn("r2", F.bit_xor("t2").over(running))
    sums = placed.groupBy("conv", "block").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    ahead = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = (sums.withColumn("a1", F.coalesce(F.bit_xor("s1").over(ahead), F.lit(0)))
            .withColumn("a2", F.coalesce(F.bit_xor("s2").over(ahead), F.lit(0))).drop("s1", "s2"))
    return _joined(placed, sums).select("conv", "k", "role", "text", F.col("r1").bitwiseXOR(F.col("a1")).alias("h1"),
                                        F.col("r2").bitwiseXOR(F.col("a2")).alias("h2"))


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """conv, n_turns and n_copies of the conversations that begin no other one."""
    whole = prefixes.groupBy("conv").agg(F.max(F.struct("k", "h1", "h2")).alias("w")).select("conv", "w.k", "w.h1", "w.h2")
    keep = whole.groupBy("k", "h1", "h2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    sizes = whole.select("conv", F.col("k").alias("n"))
    s = sizes.select(F.col("conv").alias("s_conv"), "n")
    inner = (prefixes.join(s, prefixes["conv"].eqNullSafe(s["s_conv"])).filter(F.col("k") < F.col("n"))
             .select("k", "h1", "h2").distinct())
    return keep.join(inner, ["k", "h1", "h2"], "left_anti").select("conv", F.col("k").alias("n_turns"), "n_copies")


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")),
                    F.lit(END + "\n"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", **columns: str) -> DataFrame:
    """One row per maximal conversation: its id, n_turns, n_copies and the rendered text."""
    prefixes = stored(numbered_turns(turns, conv_col, **columns), "turns")  # three branches read it
    kept = maximal_conversations(prefixes).withColumnRenamed("conv", "m_conv")
    rows = prefixes.join(kept, prefixes["conv"].eqNullSafe(kept["m_conv"]))
    said = F.struct(F.col("k"), turn_text(F.col("role"), F.col("text")).alias("said"))
    whole = rows.groupBy("conv").agg(F.max("n_turns").alias("n_turns"), F.max("n_copies").alias("n_copies"),
                                     F.array_sort(F.collect_list(said)).alias("said"))
    return whole.select(F.col("conv").alias(conv_col), "n_turns", "n_copies",
                        F.array_join(F.col("said.said"), "").alias("rendered"))
