"""Merges and state propagation as batch jobs over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loreframe.scale import latest_per_key


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Latest update per key replaces the base row and keeps its creation time."""
    newest = latest_per_key(updates, keys, order)
    kept = base.join(newest.select(*keys), list(keys), "left_anti")
    created = base.select(*keys, F.col("created_at").alias("__created"))
    merged = (
        newest.join(created, list(keys), "left")
        .withColumn("created_at", F.coalesce("__created", "created_at"))
        .drop("__created")
    )
    return kept.unionByName(merged.select(*base.columns))


def insert_if_absent(base: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    new = updates.dropDuplicates(list(keys)).join(base.select(*keys), list(keys), "left_anti")
    return base.unionByName(new.select(*base.columns))


def anti_drift(base: DataFrame, expected: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Base rows where any compared column differs null-safely from the expected row."""
    other = expected.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    differs = None
    for c in columns:
        d = ~F.col(c).eqNullSafe(F.col(f"__{c}"))
        differs = d if differs is None else (differs | d)
    return base.join(other, list(keys)).filter(differs)


def latest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest row per key by creation time, then id."""
    return latest_per_key(df, keys, [F.col("created_at"), F.col("id")])


def apply_status(base: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, new_status) applied; ``changed`` marks rows whose status really moved."""
    joined = base.join(changes.select("id", "new_status"), "id", "left")
    new = F.coalesce("new_status", "status")
    return joined.withColumn("changed", ~new.eqNullSafe(F.col("status"))).withColumn("status", new).drop(
        "new_status"
    )
