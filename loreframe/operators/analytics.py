"""Traffic reports over query events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loreframe.functions import text as tx


def normalise_events(events: DataFrame) -> DataFrame:
    """Defaults and cleaned id lists of an appended event row."""
    empty = F.array().cast("array<string>")
    return events.select(
        "id",
        "created_at",
        F.coalesce("query", F.lit("")).alias("query"),
        "intent",
        F.filter(F.coalesce("retrieved_chunk_ids", empty), lambda x: x != "").alias(
            "retrieved_chunk_ids"
        ),
        "top_score",
        F.coalesce(F.col("hit_count").cast("long"), F.lit(0)).alias("hit_count"),
        F.coalesce("rerank_used", F.lit(False)).alias("rerank_used"),
        "latency_ms",
        F.coalesce(F.nullif("requester_type", F.lit("")), F.lit("unknown")).alias("requester_type"),
        F.coalesce(tx.none_if_blank(F.col("requester_id")), F.lit("anonymous")).alias("requester_id"),
    )


def query_key(query: Column) -> Column:
    return F.lower(F.trim(query))


def top_queries_agg(events: DataFrame) -> DataFrame:
    return events.groupBy(query_key(F.col("query")).alias("query")).agg(
        F.count(F.lit(1)).alias("count"),
        F.max("created_at").alias("last_seen"),
        F.avg(F.when(F.col("hit_count") > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
    )


def top_queries(events: DataFrame, since: Column, limit: int = 20) -> DataFrame:
    ranked = top_queries_agg(events.filter(F.col("created_at") >= since))
    return ranked.orderBy(F.desc("count"), F.desc("last_seen"), F.asc("query")).limit(limit)


def zero_hit_queries(events: DataFrame, since: Column, limit: int = 50) -> DataFrame:
    return (
        events.filter((F.col("hit_count") == 0) & (F.col("created_at") >= since))
        .select("id", "created_at", "query", "intent", "requester_type", "requester_id")
        .orderBy(F.desc("created_at"), F.asc("id"))
        .limit(limit)
    )


def low_score_queries(
    events: DataFrame, since: Column, threshold: float = 0.35, limit: int = 50
) -> DataFrame:
    return (
        events.filter(
            (F.col("hit_count") > 0)
            & F.col("top_score").isNotNull()
            & (F.col("top_score") < threshold)
            & (F.col("created_at") >= since)
        )
        .select("id", "created_at", "query", "intent", "top_score", "hit_count", "requester_type")
        .orderBy(F.desc("created_at"), F.asc("id"))
        .limit(limit)
    )


def hit_rate_daily(events: DataFrame, since: Column) -> DataFrame:
    return (
        events.filter(F.col("created_at") >= since)
        .groupBy(F.to_date("created_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("hit_count") > 0).alias("hits"))
        .withColumn("hit_rate", F.col("hits") / F.col("total"))
    )


def overview(events: DataFrame, windows: dict[str, Column]) -> DataFrame:
    """All windows in one pass over the events."""
    recent, hit = F.col("created_at"), F.col("hit_count")
    oldest = F.least(*windows.values()) if len(windows) > 1 else next(iter(windows.values()))
    aggs = []
    for name, since in windows.items():
        aggs += [
            F.count_if(recent >= since).alias(f"{name}_total"),
            F.count_if((recent >= since) & (hit > 0)).alias(f"{name}_hits"),
            F.count_if((recent >= since) & (hit == 0)).alias(f"{name}_zero"),
        ]
    one = events.filter(recent >= oldest).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("period"),
                F.col(f"{n}_total").alias("total"),
                F.when(F.col(f"{n}_total") > 0, F.col(f"{n}_hits") / F.col(f"{n}_total"))
                .otherwise(F.lit(0.0))
                .alias("hit_rate"),
                F.col(f"{n}_zero").alias("zero_hit"),
            )
            for n in windows
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def top_chunks_agg(events: DataFrame) -> DataFrame:
    return (
        events.select(F.explode("retrieved_chunk_ids").alias("chunk_id"))
        .filter("chunk_id is not null and chunk_id <> ''")
        .groupBy("chunk_id")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def top_chunks(events: DataFrame, since: Column, limit: int = 20) -> DataFrame:
    ranked = top_chunks_agg(events.filter(F.col("created_at") >= since))
    return ranked.orderBy(F.desc("count"), F.asc("chunk_id")).limit(limit)


def zero_hit_clusters(
    events: DataFrame, since: Column, max_clusters: int = 10, samples: int = 5
) -> DataFrame:
    """Themes of zero-hit queries: character n-gram TF-IDF and bisecting k-means, seeded.

    The model is fitted on distinct query texts weighted into the cluster sizes afterwards, so a
    query asked a billion times is one training row.
    """
    from loreframe.operators.retrieval import ngrams
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    distinct = (
        events.filter((F.col("hit_count") == 0) & (F.col("created_at") >= since))
        .groupBy(query_key(F.col("query")).alias("query"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("query <> ''")
    )
    # a blank on each side, so that a query of one character has a trigram as well
    grams = ngrams(F.concat(F.lit(" "), "query", F.lit(" ")), 3)
    rows = distinct.withColumn("grams", grams)
    model = Pipeline(
        stages=[
            HashingTF(inputCol="grams", outputCol="tf", numFeatures=4096),
            IDF(inputCol="tf", outputCol="idf"),
            Normalizer(inputCol="idf", outputCol="features"),
            BisectingKMeans(k=max_clusters, seed=42, featuresCol="features", predictionCol="cluster"),
        ]
    ).fit(rows)
    placed = model.transform(rows).select("query", "n", "cluster", "grams")
    labels = (
        placed.select("cluster", F.col("n"), F.explode(F.array_distinct("grams")).alias("gram"))
        .groupBy("cluster", "gram")
        .agg(F.sum("n").alias("w"))
        .groupBy("cluster")
        .agg(F.max_by("gram", F.struct("w", "gram")).alias("cluster_label"))
    )
    from pyspark.sql import Window as W

    best = W.partitionBy("cluster").orderBy(F.desc("n"), F.asc("query"))
    sample = (
        placed.withColumn("rn", F.row_number().over(best))
        .filter(F.col("rn") <= samples)
        .groupBy("cluster")
        .agg(F.sort_array(F.collect_list(F.struct("rn", "query"))).alias("s"))
        .select("cluster", F.transform("s", lambda x: x["query"]).alias("sample_queries"))
    )
    sizes = placed.groupBy("cluster").agg(F.sum("n").alias("event_count"))
    return sizes.join(labels, "cluster").join(sample, "cluster").select(
        "cluster_label", "event_count", "sample_queries"
    )
