"""Helpers that keep a hot group from landing in one task.

A plain window over ``partitionBy(file)`` sorts a whole file in one task. When the order key is a
number or a time, the same result comes from two levels: a local window inside a bounded bucket of
the order key, plus a prefix over the (small) per-bucket summaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

BUCKET = "__bucket"
HOT_PARTS = 1 << 16  # hashes of groups that are counted
HOT_ROWS = 1 << 20  # more rows of a hash are dealt over several tasks


def _with_offsets(
    local: DataFrame, keyed: DataFrame, group: Sequence[str], total: Column, out: str
) -> DataFrame:
    per_bucket = keyed.groupBy(*group, BUCKET).agg(total.alias("__n"))
    before = W.partitionBy(*group).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col(BUCKET).alias("__b"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
    )
    match = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    match.append(F.col(BUCKET).eqNullSafe(F.col("__b")))
    joined = local.join(offsets, match, "inner")
    return joined.withColumn(out, F.col(out) + F.col("__offset")).drop(
        *[f"__g{i}" for i in range(len(group))], "__b", "__offset", BUCKET
    )


def dense_position(
    df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column], out: str
) -> DataFrame:
    """1-based position inside ``group`` by ``order``; ``bucket`` must grow with the order."""
    keyed = df.withColumn(BUCKET, bucket)
    local = keyed.withColumn(
        out, F.row_number().over(W.partitionBy(*group, BUCKET).orderBy(*order)).cast("long")
    )
    return _with_offsets(local, keyed, group, F.count(F.lit(1)), out)


def split_hot(df: DataFrame, group: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups that one task can take whole, and the others, if there are any.

    Rows are counted by a hash of the group, which moves a bounded number of counts whatever the groups. A group that
    shares its hash with a hot one counts as hot.
    """
    part = F.pmod(F.xxhash64(*group), F.lit(HOT_PARTS))
    sizes = df.select(part.alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    hot = [r["p"] for r in sizes.filter(F.col("n") > HOT_ROWS).collect()]
    if not hot:
        return df, None
    return df.filter(~part.isin(hot)), df.filter(part.isin(hot))


def position_in_group(
    df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column], out: str
) -> DataFrame:
    """``dense_position`` that moves the rows of all but hot groups once."""
    plain, hot = split_hot(df, group)
    placed = plain.withColumn(out, F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long"))
    return placed if hot is None else placed.unionByName(dense_position(hot, group, bucket, order, out))


def running_sum(
    df: DataFrame,
    group: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    value: Column,
    out: str,
) -> DataFrame:
    """Running sum of ``value`` inside ``group`` by ``order`` (inclusive)."""
    keyed = df.withColumn(BUCKET, bucket).withColumn("__v", value.cast("long"))
    frame = (
        W.partitionBy(*group, BUCKET).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    local = keyed.withColumn(out, F.sum("__v").over(frame))
    return _with_offsets(local, keyed, group, F.sum("__v"), out).drop("__v")


def previous_value(
    df: DataFrame,
    group: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    value: Column,
    out: str,
) -> DataFrame:
    """``lag(value)`` inside ``group`` by ``order``; a bucket's first row looks at earlier buckets."""
    keyed = df.withColumn(BUCKET, bucket).withColumn("__v", value)
    local = keyed.withColumn(
        out, F.lag("__v").over(W.partitionBy(*group, BUCKET).orderBy(*order))
    ).withColumn("__first", F.row_number().over(W.partitionBy(*group, BUCKET).orderBy(*order)) == 1)
    tails = keyed.groupBy(*group, BUCKET).agg(F.max_by("__v", F.struct(*order)).alias("__tail"))
    carried = tails.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col(BUCKET).alias("__b"),
        F.lag("__tail").over(W.partitionBy(*group).orderBy(BUCKET)).alias("__carried"),
    )
    match = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    match.append(F.col(BUCKET).eqNullSafe(F.col("__b")))
    return (
        local.join(carried, match, "inner")
        .withColumn(out, F.when(F.col("__first"), F.col("__carried")).otherwise(F.col(out)))
        .drop(*[f"__g{i}" for i in range(len(group))], "__b", "__carried", "__first", "__v", BUCKET)
    )


def position_and_previous(
    df: DataFrame,
    group: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    value: Column,
    position: str,
    previous: str,
) -> DataFrame:
    """``dense_position`` and ``previous_value`` with one sort of the rows and one join."""
    keyed = df.withColumn(BUCKET, bucket).withColumn("__v", value)
    here = W.partitionBy(*group, BUCKET).orderBy(*order)
    local = keyed.withColumn("__at", F.row_number().over(here).cast("long")).withColumn(previous, F.lag("__v").over(here))
    per_bucket = keyed.groupBy(*group, BUCKET).agg(
        F.count(F.lit(1)).alias("__n"), F.max_by("__v", F.struct(*order)).alias("__tail")
    )
    buckets = W.partitionBy(*group).orderBy(BUCKET)
    carried = per_bucket.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col(BUCKET).alias("__b"),
        F.coalesce(F.sum("__n").over(buckets.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__offset"),
        F.lag("__tail").over(buckets).alias("__carried"),
    )
    match = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    match.append(F.col(BUCKET).eqNullSafe(F.col("__b")))
    return (
        local.join(carried, match, "inner")
        .withColumn(previous, F.when(F.col("__at") == 1, F.col("__carried")).otherwise(F.col(previous)))
        .withColumn(position, F.col("__at") + F.col("__offset"))
        .drop(*[f"__g{i}" for i in range(len(group))], "__b", "__offset", "__carried", "__at", "__v", BUCKET)
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Row with the greatest ``order`` per key, by a combinable aggregate instead of a window."""
    row = F.struct(*[F.col(c) for c in df.columns])
    picked = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(
        F.max_by(row, F.struct(*order)).alias("__row")
    )
    return picked.select("__row.*")
