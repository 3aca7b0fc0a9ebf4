"""Conversation compaction, prompt context and outline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from loreframe.functions import text as tx
from loreframe.functions.constants import (
    CONTEXT_CHARS,
    PROMPT_MESSAGES,
    RECENT_MESSAGES,
    SUMMARY_LINE_CHARS,
)
from loreframe.scale import dense_position

# A summary line is at least five characters, so this many lines always fill the whole summary.
SUMMARY_LINES = CONTEXT_CHARS // 5 + 2


def _lines(column: str, separator: str):
    rows = F.sort_array(F.collect_list(F.struct("turn", column)))
    return F.array_join(F.transform(rows, lambda r: r[column]), separator)


def compact_context(turns: DataFrame) -> DataFrame:
    """Last messages in full, everything older as one bounded summary.

    Only the first ``SUMMARY_LINES`` older messages can reach the summary, so both parts are
    top-k windows and a very long conversation never gathers in one task.
    """
    said = turns.filter(F.col("role").isin("user", "assistant")).withColumn("c", tx.compact(F.col("text")))
    said = said.filter("c <> ''").select("conv_id", "turn", "role", "c")
    newest = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    oldest = W.partitionBy("conv_id").orderBy("turn")
    recent_rows = said.withColumn("rn", F.row_number().over(newest)).filter(
        F.col("rn") <= RECENT_MESSAGES
    )
    agent = F.concat(F.col("role"), F.lit(": "), tx.truncate(F.col("c"), CONTEXT_CHARS))
    recent = (
        recent_rows.withColumn("line", agent)
        .groupBy("conv_id")
        .agg(
            F.count(F.lit(1)).alias("recent_count"),
            F.min("turn").alias("cut"),
            _lines("line", "\n").alias("recent"),
        )
    )
    who = F.when(F.col("role") == "user", "用户：").otherwise("助手：")
    older = (
        said.withColumn("rn", F.row_number().over(oldest))
        .filter(F.col("rn") <= SUMMARY_LINES)
        .join(recent.select("conv_id", "cut"), "conv_id")
        .filter(F.col("turn") < F.col("cut"))
        .withColumn("line", F.concat(who, tx.truncate(F.col("c"), SUMMARY_LINE_CHARS)))
        .groupBy("conv_id")
        .agg(_lines("line", "；").alias("summary"))
    )
    return recent.join(older, "conv_id", "left").select(
        "conv_id",
        "recent_count",
        "recent",
        tx.truncate(F.coalesce("summary", F.lit("")), CONTEXT_CHARS).alias("summary"),
    )


def clean_context(turns: DataFrame) -> DataFrame:
    """First messages of a context, without bad roles and blanks, as a history block."""
    first = W.partitionBy("conv_id").orderBy("turn")
    label = F.when(F.col("role") == "user", "[USER] ").otherwise("[Agent] ")
    kept = (
        turns.withColumn("rn", F.row_number().over(first))
        .filter(F.col("rn") <= PROMPT_MESSAGES)
        .filter(F.col("role").isin("user", "assistant"))
        .withColumn("c", tx.truncate(F.col("text"), CONTEXT_CHARS))
        .filter("c <> ''")
        .withColumn("line", F.concat(label, "c"))
    )
    return kept.groupBy("conv_id").agg(
        F.concat(F.lit("<history>\n"), _lines("line", "\n"), F.lit("\n</history>")).alias("prompt"),
        F.count(F.lit(1)).alias("messages"),
    )


def outline(turns: DataFrame, max_items: int = 20, max_length: int = 34) -> DataFrame:
    """Numbered user questions; long conversations are sampled evenly, both ends kept."""
    asked = turns.filter("role = 'user'").select("conv_id", "turn", tx.compact(F.col("text")).alias("c"))
    numbered = dense_position(
        asked, ["conv_id"], F.floor(F.col("turn") / 4096), [F.col("turn")], "idx"
    )
    sizes = asked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    picks = F.transform(
        F.sequence(F.lit(0), F.lit(max_items - 1)),
        lambda i: F.floor(i * (F.col("n") - 1) / F.lit(float(max_items - 1)) + 0.5),
    )
    short = (
        F.when(F.col("c") == "", "空问题")
        .when(
            F.length("c") > max_length,
            F.concat(F.substring("c", 1, max_length - 3), F.lit("...")),
        )
        .otherwise(F.col("c"))
    )
    return (
        numbered.join(sizes, "conv_id")
        .filter((F.col("n") <= max_items) | F.array_contains(picks, F.col("idx") - 1))
        .select("conv_id", "turn", "idx", short.alias("summary"))
    )
