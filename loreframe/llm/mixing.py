"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; target / size is the expected number of copies of each of its
documents. The whole part is certain, the fraction is rounded: two documents at a time, probability mass
counted in words moves from one to the other until one of them has 0 or 1, at random such that each
keeps its expected value. The words of the pair stay the same, so a source comes out at its target but
for one last document.

The pairing is a reduction tree: leaves are bounded buckets of a source's documents by id hash, the one
undecided document of each leaf goes up to the next level with those of other leaves, until one per
source is left, which is decided by itself. A document's random numbers come from its own id, so a rerun
gives the same copies however the table is laid out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from loreframe.session import written


LEAF = 4096  # documents of a leaf, on average
FAN = 256  # leaves that meet in a node of the next level

SPACES = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of runs of other bytes than 0x20 and 0x09-0x0D; 0 for null."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, "[\\x20\\x09-\\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, docs, target) from ``sizes(source, size)``.

    Sources by code point, null last, take the weights in turn. ``share`` of all sizes is dealt out by
    weight; a source stops at ``most`` times its size and what is left over goes to the others: with the
    sources by size / weight, the first ones are full, the rest get one rate per weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    # these windows run over one row for each source
    ranked = by_source.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.withColumn("weight", F.get(turn, (F.col("rank") % len(weights)).cast("int")))
    full = most * F.col("source_size")
    order = W.orderBy(full / F.col("weight"), "rank")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    later = order.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rate = (
        F.least(F.lit(share), F.lit(most)) * F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(earlier), F.lit(0.0))
    ) / F.sum("weight").over(later)
    rated = weighed.withColumn("rate", rate).withColumn("is_full", F.col("rate") * F.col("weight") >= full)
    # full sources come first in this order; the first other one has the rate of all others
    common = F.min(F.when(~F.col("is_full"), F.struct(full / F.col("weight"), F.col("rank"), F.col("rate")))).over(everything)
    target = F.when(F.col("is_full"), full).otherwise(F.least(full, common["rate"] * F.col("weight")))
    return rated.select("source", "source_size", "docs", target.cast("double").alias("target"))


def _pivotal(last: bool):
    """Rounds the fractions of one group; at most one document stays undecided (none if ``last``)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("key", "ascending"), ("luck", "ascending")])
        size = table.column("size").to_pylist()
        part = table.column("part").to_pylist()
        luck = table.column("luck").to_pylist()
        extra: list[int | None] = [None] * len(size)
        left = list(part)
        held = -1
        for i, p in enumerate(part):
            if p <= 0 or size[i] <= 0:
                extra[i] = 0
                continue
            if held < 0:
                held = i
                continue
            j, a, b = held, size[held], size[i]
            q = left[j]
            # mass in words: up moves it from i to j, down from j to i
            up = min((1 - q) * a, p * b)
            down = min(q * a, (1 - p) * b)
            if luck[i] * (up + down) < down:
                q, p = q + up / a, p - up / b
            else:
                q, p = q - down / a, p + down / b
            settled = []
            for k, value in ((j, q), (i, p)):
                left[k] = value
                if value < 1e-9 or value > 1 - 1e-9:
                    extra[k] = int(value > 0.5)
                    settled.append(k)
            held = -1 if len(settled) == 2 else (i if settled == [j] else j)
        if last and held >= 0:
            extra[held] = int(luck[held] < left[held])
        out = table.drop_columns(["part"]).append_column("part", pa.array(left, pa.float64()))
        return out.append_column("extra", pa.array(extra, pa.int64())).select(
            ["row", "source", "bucket", "size", "key", "luck", "part", "extra"]
        )

    return run


_SCHEMA = "row long, source string, bucket long, size long, key long, luck double, part double, extra long"


def copies(
    sized: DataFrame, targets: DataFrame, seed: int = 0
) -> DataFrame:
    """(row, copies) for ``sized(row, source, size, key)`` with unique ``row``; ``key`` draws the luck."""
    joined = sized.join(
        targets.select(F.col("source").alias("__s"), "source_size", "target", "docs"), F.col("source").eqNullSafe(F.col("__s"))
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    hashed = F.xxhash64("key", F.lit(seed))
    buckets = F.ceil(F.col("docs") / LEAF)
    leaf = written(
        joined.select(
            "row",
            "source",
            F.pmod(F.xxhash64("key", F.lit(seed + 1)), buckets).alias("bucket"),
            "size",
            F.xxhash64("key").alias("key"),
            (F.pmod(hashed, F.lit(1 << 52)) / float(1 << 52)).alias("luck"),
            # a ratio within rounding of a whole number is that number
            F.when(F.abs(ratio - F.round(ratio)) < 1e-9, F.round(ratio)).otherwise(ratio).alias("ratio"),
        ).selectExpr("row", "source", "bucket", "size", "key", "luck", "ratio - floor(ratio) part", "cast(floor(ratio) as long) whole"),
        "parts",
    )
    level = leaf.drop("whole")
    done = None
    while True:
        most = level.agg(F.max("bucket")).first()[0]
        if most is None:
            break
        last = most == 0
        rounded = written(level.groupBy("source", "bucket").applyInArrow(_pivotal(last), _SCHEMA), "rounded")
        settled = rounded.where("extra is not null").select("row", "extra")
        done = settled if done is None else done.union(settled)
        if last:
            break
        level = rounded.where("extra is null").drop("extra").withColumn("bucket", F.floor(F.col("bucket") / FAN))
    if done is None:
        return leaf.select("row", F.lit(0).cast("long").alias("copies"))
    return leaf.join(done, "row").select("row", (F.col("whole") + F.col("extra")).alias("copies"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """Every row of ``docs(doc_id, text, source, ...)`` with size, source_size, target and copies.

    ``size`` is the number of words. A null text has none; rows of size 0 get 0 copies above the whole part
    of their source's rate. A null source is a source of its own, the last one. Repeated rows are rounded
    each for itself: the copies of a repeated doc_id are told apart by a running number. ``most`` bounds the
    copies. An empty table gives no rows. Columns of ``docs`` stay, except those of the names added here.
    """
    added = {"size", "source_size", "target", "copies", "docs", "row"}
    kept = docs.drop(*[c for c in docs.columns if c in added])
    # the table is written with row numbers, so the join back is by the very same rows
    rows = written(kept.withColumn("row", F.monotonically_increasing_id()).withColumn("size", word_count(F.col("text"))), "sized")
    return _with_copies(rows, weights, share, most, seed).drop("row")


def _with_copies(rows: DataFrame, weights, share: float, most: float, seed: int) -> DataFrame:
    light = rows.select("row", "doc_id", "source", "size")
    twin = F.row_number().over(W.partitionBy("doc_id", "source", "size").orderBy("row"))
    keyed = light.withColumn("key", F.concat_ws("/", F.col("doc_id").cast("string"), twin.cast("string"))).drop("doc_id")
    targets = written(source_targets(light.select("source", "size"), weights, share, most), "targets")
    counted = copies(keyed, targets, seed)
    sources = targets.select(F.col("source").alias("__s"), "source_size", "target")
    return rows.join(counted, "row").join(sources, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")


def mix_sizes(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """As ``mix_sources`` but with doc_id and numbers only, so no text is written or moved."""
    rows = written(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("row", F.monotonically_increasing_id()),
        "sized",
    )
    return _with_copies(rows, weights, share, most, seed).drop("row")
