"""Streaming queries; each must equal its batch form on a finished input."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loreframe.plans.ingest_state import JOB_STATES
from loreframe.plans.registry import query
from loreframe.plans.traffic import SQL_STAMP, STAMP
from loreframe.session import new_work_path
from loreframe.sources.tables import Tables
from loreframe.streaming import jobs


def staged(t: Tables) -> str:
    return jobs.stage_events(t.spark, t.raw("events"))


def stream(t: Tables, files_per_trigger: int | None = 12) -> DataFrame:
    return jobs.event_stream(t.spark, staged(t), files_per_trigger).drop("arrival")


@query(
    "stream_ingest",
    f"""SELECT id, strftime(created_at, {SQL_STAMP}) AS created_at, query, hit_count, requester_type,
    coalesce(nullif(trim(requester_id), ''), 'anonymous') AS requester_id FROM query_events""",
)
def stream_ingest(t: Tables) -> DataFrame:
    return jobs.ingest(stream(t)).select(
        "id", F.date_format("created_at", STAMP).alias("created_at"), "query", "hit_count", "requester_type", "requester_id"
    )


@query(
    "stream_hit_rate",
    """SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (hit_count > 0) AS hits,
    round(count(*) FILTER (hit_count > 0) / count(*), 6) AS hit_rate FROM query_events GROUP BY 1""",
)
def stream_hit_rate(t: Tables) -> DataFrame:
    return jobs.hit_rate(stream(t)).withColumn("hit_rate", F.round("hit_rate", 6))


@query(
    "stream_overview",
    """SELECT d AS days, strftime(e, '%Y-%m-%d') AS period_end, count(*) AS total, round(count(*) FILTER (hit_count > 0) / count(*), 6) AS hit_rate,
    count(*) FILTER (hit_count = 0) AS zero_hit FROM query_events q, (SELECT unnest([1, 7, 30]) AS d) w,
    LATERAL (SELECT unnest(generate_series(date_trunc('day', q.created_at) + INTERVAL 1 DAY, date_trunc('day', q.created_at) + to_days(CAST(w.d AS INT)), INTERVAL 1 DAY)) AS e) x
    GROUP BY d, e""",
)
def stream_overview(t: Tables) -> DataFrame:
    folder = staged(t)
    out = None
    for days in (1, 7, 30):
        one = jobs.overview(jobs.event_stream(t.spark, folder, 12), days)
        out = one if out is None else out.unionByName(one)
    return out.withColumn("hit_rate", F.round("hit_rate", 6))


@query("stream_dedupe", "SELECT event_id AS message_id, user_id, event_type FROM events")
def stream_dedupe(t: Tables) -> DataFrame:
    """Every message is delivered twice; each id must come out once."""
    folder = staged(t)
    doubled = jobs.event_stream(t.spark, folder, 12).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    messages = doubled.select(F.col("event_id").alias("message_id"), "user_id", "event_type", "ts")
    return jobs.dedupe(messages, "message_id", "ts").select("message_id", "user_id", "event_type")


@query(
    "stream_sessions",
    f"""WITH g AS (SELECT user_id AS channel, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 600 MINUTE THEN 0 ELSE 1 END AS n FROM events),
    s AS (SELECT *, sum(n) OVER (PARTITION BY channel ORDER BY ts) AS k FROM g)
    SELECT channel, strftime(min(ts), {SQL_STAMP}) AS start_at, strftime(max(ts), {SQL_STAMP}) AS end_at, count(*) AS message_count FROM s GROUP BY channel, k""",
)
def stream_sessions(t: Tables) -> DataFrame:
    """A sentinel far in the future closes the last sessions; it is dropped from the result.

    ``session_window`` also splits at exactly the gap, the batch rule only beyond it, so the gap
    gets one more microsecond.
    """
    folder = staged(t)
    last = (
        t.raw("events").agg(F.max("ts").alias("m"))
        .select(
            F.lit(-1).cast("long").alias("event_id"),
            (F.col("m") + F.expr("interval 60 days")).alias("ts"),
            F.lit(-1).cast("long").alias("user_id"),
            F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"),
        )
    )
    last.write.parquet(f"{folder}/arrival=9999-12-31")
    messages = jobs.event_stream(t.spark, folder, 12).select(F.col("user_id").alias("channel"), F.col("ts").alias("sent_at"))
    closed = jobs.sessions(messages, "36000.000001 seconds")
    return closed.filter("channel >= 0").withColumns(
        {c: F.date_format(c, STAMP) for c in ("start_at", "end_at")}
    )


FILE_BYTES = 32 << 20  # of staged values, uncompressed


def staged_rows(t: Tables, df: DataFrame, label: str, files: int = 4, file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """``df`` as files of bounded size, at least ``files``, and a stream that takes half of them at a time."""
    path = new_work_path(t.spark, label)
    width = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.simpleString() == "string" else F.lit(8) for f in df.schema), F.lit(0))
    total = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    files = max(files, -(-total // file_bytes))
    df.repartition(files).write.parquet(path)
    return path, t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(path)


@query("stream_latest_job", "SELECT file_id, id, status FROM latest_parse")
def stream_latest_job(t: Tables) -> DataFrame:
    rows = t.parse_jobs.select("id", "file_id", "status", "created_at")
    _, changes = staged_rows(t, rows, "parse-jobs")
    return jobs.latest_state(changes, ["file_id"], [F.col("created_at"), F.col("id")]).select("file_id", "id", "status")


@query("stream_index", "SELECT 'chunk_' || doc_id AS id, 64 AS embedding_dimensions FROM documents")
def stream_index(t: Tables) -> DataFrame:
    rows = t.import_chunks.select("id", F.col("source_text").alias("text"), F.col("chunk_index").alias("updated_at"))
    twice = rows.unionByName(rows.withColumn("updated_at", F.col("updated_at") + 1))
    _, changes = staged_rows(t, twice, "chunk-changes")
    return jobs.index_rows(changes, "text").select("id", "embedding_dimensions")


@query(
    "stream_top",
    """SELECT 'query' AS kind, lower(trim(query)) AS key, count(*) AS count FROM query_events GROUP BY 2
    UNION ALL SELECT 'chunk', c, count(*) FROM (SELECT unnest(retrieved_chunk_ids) AS c FROM query_events) WHERE c <> '' GROUP BY 2""",
)
def stream_top(t: Tables) -> DataFrame:
    texts, chunks = jobs.top_counts(stream(t))
    return texts.select(F.lit("query").alias("kind"), F.col("query").alias("key"), "count").unionByName(
        chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), "count")
    )


@query(
    "stream_job_counts",
    "SELECT job_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}_count" for s in JOB_STATES) + " FROM job_items GROUP BY job_id",
)
def stream_job_counts(t: Tables) -> DataFrame:
    """Items change from queued to their final state; the counts follow the newest change."""
    first = t.job_items.withColumn("status", F.lit("queued")).withColumn("changed_at", F.lit(0))
    last = t.job_items.withColumn("changed_at", F.lit(1))
    _, changes = staged_rows(t, first.unionByName(last), "item-changes")
    return jobs.job_counts(changes, JOB_STATES)
