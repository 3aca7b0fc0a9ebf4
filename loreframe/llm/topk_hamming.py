"""Exact top-k by Hamming distance with incremental multi-index hashing.

A binary code is cut into segments, and each segment is an index key. Two codes at distance at most
``m (r + 1) - 1`` differ by at most ``r`` bits in one of the ``m`` segments. So a query looks up, for
r = 0, 1, 2, ..., all segment values at distance r of its own, checks the full distance of what it finds,
and stops once its k-th distance is at most ``m (r + 1) - 1``: nothing unseen can be nearer. What is farther
than the k-th distance so far is left aside where it is found.

Equal codes are one entry of the index with its k smallest ids: no result can use more of them, so the
result is whole. A pair is taken only at its first nearest segment, hence once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loreframe.llm.tables import empty_like
from loreframe.session import written

SEGMENT = 16  # bits


def sign_code(vector: str, dimensions: int) -> Column:
    """Segments of the sign bits (1 for values above 0) of an array column; null for a null array.

    Missing and null values count as 0, values beyond ``dimensions`` are ignored.
    """
    segments = -(-dimensions // SEGMENT)
    return F.expr(
        f"if(`{vector}` is null, null, transform(sequence(0, {segments - 1}), s -> aggregate(sequence(0, {SEGMENT - 1}), 0,"
        f" (b, i) -> b + if(s * {SEGMENT} + i < {dimensions} and coalesce(get(`{vector}`, s * {SEGMENT} + i) > 0, false),"
        f" shiftleft(1, i), 0))))"
    )


def top_k(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, distance) of the k nearest of ``codes(id, code)`` to ``queries(query_id, code)``.

    Equal distances go by id. Rows with a null id or code are left out; a repeated (id, code) counts once.
    With fewer than k codes all are returned. Empty inputs give no rows; other columns are ignored.
    """
    spark = codes.sparkSession
    known = codes.select("id", "code").where("id is not null and code is not null").distinct()
    first = W.partitionBy("code").orderBy("id")
    ids = written(known.withColumn("i", F.row_number().over(first)).where(F.col("i") <= k), "codes")
    index = ids.where("i = 1").select("code", F.col("id").alias("least"))
    index = written(index.select("code", "least", F.posexplode("code").alias("segment", "value")), "index")
    asked = written(queries.select("query_id", F.col("code").alias("q")).where("query_id is not null and q is not null").distinct(), "asked")
    far = F.lit((1 << 31) - 1)
    active = asked.select("q", far.alias("kth")).distinct()
    segments = ids.select(F.size("code")).first()
    wanted = min(k, ids.limit(k).count())
    result = empty_like(spark, "q array<int>, id long, distance int, code array<int>")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = 0
    while segments is not None and r <= SEGMENT and not active.isEmpty():
        masks = F.expr(f"filter(sequence(0, {(1 << SEGMENT) - 1}), x -> bit_count(x) = {r})")
        # a fixed number of partitions: the rows are small before the masks multiply them, so they would be put in one
        dealt = active.select("q", "kth", F.posexplode("q").alias("at", "own")).repartition(tasks, "q", "at")
        probes = dealt.withColumn("mask", F.explode(masks))
        probes = probes.select("q", "kth", "at", F.col("own").bitwiseXOR(F.col("mask")).alias("asked"))
        apart = F.zip_with("q", "code", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
        distance = F.aggregate(apart, F.lit(0), lambda a, b: a + b)
        # probes are many more than the planner takes them for, so it must not broadcast them
        found = probes.join(
            index.hint("merge"),
            (F.col("at") == F.col("segment"))
            & (F.col("asked") == F.col("value"))
            & (distance <= F.col("kth"))
            & (F.array_min(apart) == r)
            & (F.array_position(apart, r) == F.col("segment") + 1),
        ).select("q", "code", "least", distance.alias("distance"))
        # a result has its code among the k first codes by (distance, least id)
        near = W.partitionBy("q").orderBy("distance", "least")
        found = found.withColumn("i", F.row_number().over(near)).where(F.col("i") <= k)
        found = found.select("q", "code", "distance").join(ids.select("code", "id"), "code").select("q", "id", "distance", "code")
        best = W.partitionBy("q").orderBy("distance", "id")
        both = result.union(found).withColumn("i", F.row_number().over(best)).where(F.col("i") <= k).drop("i")
        result = written(both, "nearest")
        covered = segments[0] * (r + 1) - 1
        nearest = result.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("last"))
        kth = F.when(F.col("n") >= wanted, F.col("last")).otherwise(far)
        seen = active.select("q").join(nearest, "q", "left").select("q", kth.alias("kth"))
        active = written(seen.where(F.col("kth") > covered), "active")
        r += 1
    rank = F.row_number().over(W.partitionBy("query_id", "q").orderBy("distance", "id"))
    return asked.join(result, "q").select("query_id", rank.alias("rank"), "id", "distance")
