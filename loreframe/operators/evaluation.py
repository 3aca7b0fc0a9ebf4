"""Retrieval evaluation: metrics, diagnoses, batch summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loreframe.functions import text as tx
from loreframe.functions.constants import EVAL_CONTRACT, EVAL_STRATEGIES
from loreframe.scale import latest_per_key


def valid_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(
        F.col("strategy").isin(EVAL_STRATEGIES) & (F.col("contract_version") == EVAL_CONTRACT)
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """Latest valid run per case and strategy; never another strategy's."""
    return latest_per_key(valid_runs(runs), ["case_id", "strategy"], [F.col("created_at"), F.col("id")])


def first_hit_rank(retrieved: Column, expected: Column) -> Column:
    """1-based rank of the first expected id, null when none is retrieved."""
    at = F.filter(
        F.transform(retrieved, lambda x, i: F.when(F.array_contains(expected, x), i + 1)),
        lambda r: r.isNotNull(),
    )
    return F.array_min(at).cast("long")


def case_metrics(rank: Column) -> list[Column]:
    return [
        F.when(rank.isNotNull(), 1.0).otherwise(0.0).alias("recall_at_k"),
        F.coalesce(1.0 / rank, F.lit(0.0)).alias("mrr"),
        F.when(rank == 1, 1.0).otherwise(0.0).alias("hit_rate_at_1"),
    ]


def metrics(results: DataFrame, by: list[str], k: int) -> DataFrame:
    """Hit rate within k, MRR and hit@1; unlabelled cases stay in the denominator."""
    rank = first_hit_rank(F.slice("retrieved_ids", 1, k), F.col("expected_ids"))
    scored = results.select(*by, *case_metrics(rank))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("case_count"),
        *[F.avg(c).alias(c) for c in ("recall_at_k", "mrr", "hit_rate_at_1")],
    )


def diagnose(cases: DataFrame, runs: DataFrame, strategy: str) -> DataFrame:
    """One reason per active case for one strategy.

    ``cases``: id, expected_chunk_ids, expected_source_ids, status; ``runs``: case_id, strategy,
    items (array of struct<id, source_id>).
    """
    run = latest_runs(runs).filter(F.col("strategy") == strategy).select(
        F.col("case_id").alias("id"), "items", F.lit(True).alias("has_run")
    )
    chunks, sources = F.col("expected_chunk_ids"), F.col("expected_source_ids")
    level = F.when(F.size(chunks) > 0, "chunk").when(F.size(sources) > 0, "source").otherwise("none")
    ids = F.transform("items", lambda x: x["id"])
    from_sources = F.transform("items", lambda x: x["source_id"])
    rank = F.when(F.size(chunks) > 0, first_hit_rank(ids, chunks)).otherwise(first_hit_rank(from_sources, sources))
    mismatch = (F.size(chunks) > 0) & F.arrays_overlap(from_sources, sources)
    joined = cases.filter("status = 'active'").join(run, "id", "left").withColumn("level", level).withColumn("rank", rank)
    reason = (
        F.when(F.col("level") == "none", "missing_expected")
        .when(F.col("has_run").isNull(), "not_run")
        .when(F.size("items") == 0, "empty_candidates")
        .when(F.col("rank") == 1, "hit")
        .when(F.col("rank") > 1, "low_rank")
        .when(mismatch, "granularity_mismatch")
        .otherwise("missed")
    )
    labelled_run = (F.col("level") != "none") & F.col("has_run").isNotNull()
    return joined.select(
        "id",
        "level",
        reason.alias("reason"),
        F.when(labelled_run, F.col("rank")).alias("rank"),
        *[F.when(labelled_run, c).alias(n) for c, n in zip(case_metrics(F.col("rank")), ("recall", "mrr", "top1"))],
    )


REASONS = ["hit", "low_rank", "missed", "granularity_mismatch", "empty_candidates", "not_run", "missing_expected"]


def summary(diagnoses: DataFrame) -> DataFrame:
    """Counts by reason and averages over labelled cases that have a run."""
    return diagnoses.agg(
        F.count(F.lit(1)).alias("active_cases"),
        F.count_if(F.col("level") != "none").alias("labelled_cases"),
        *[F.count_if(F.col("reason") == r).alias(f"{r}_count") for r in REASONS],
        F.avg("recall").alias("average_recall"),
        F.avg("mrr").alias("average_mrr"),
        F.avg("top1").alias("top1_rate"),
    )


def without_graph_ids(cases: DataFrame, graph_ids: DataFrame) -> DataFrame:
    """Expected ids that point at graph rows are removed, the order of the others is kept."""
    entries = cases.select("id", F.posexplode("expected_source_ids").alias("pos", "value"))
    kept = entries.join(graph_ids.select(F.col("id").alias("value")), "value", "left_anti")
    cleaned = kept.groupBy("id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("cleaned")
    )
    return cases.join(cleaned, "id", "left").withColumn(
        "expected_source_ids", F.coalesce("cleaned", F.array().cast("array<string>"))
    ).drop("cleaned")
