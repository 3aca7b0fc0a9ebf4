"""Dashboards and simple lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loreframe.functions import text as tx
from loreframe.functions.constants import EVAL_CONTRACT
from loreframe.operators import analytics as an
from loreframe.plans.registry import query
from loreframe.sources.tables import Tables, now

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SQL_STAMP = "'%Y-%m-%d %H:%M:%S.%f'"
SINCE_SQL = "created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL {} DAY"


def since(days: int):
    return now() - F.expr(f"interval {days} days")


def stamp(name: str):
    return F.date_format(name, STAMP).alias(name)


def sstamp(name: str) -> str:
    return f"strftime({name}, {SQL_STAMP}) AS {name}"


@query(
    "event_normalise",
    f"""SELECT id, {sstamp('created_at')}, query, intent,
    array_to_string(list_filter(retrieved_chunk_ids, lambda x: x <> ''), '|') AS retrieved_chunk_ids,
    top_score, hit_count, rerank_used, latency_ms, requester_type,
    coalesce(nullif(trim(requester_id), ''), 'anonymous') AS requester_id FROM query_events""",
)
def event_normalise(t: Tables) -> DataFrame:
    return an.normalise_events(t.query_events).withColumns(
        {
            "retrieved_chunk_ids": F.array_join("retrieved_chunk_ids", "|"),
            "created_at": F.date_format("created_at", STAMP),
        }
    )


@query(
    "top_queries",
    f"""SELECT lower(trim(query)) AS query, count(*) AS count,
    strftime(max(created_at), {SQL_STAMP}) AS last_seen,
    round(avg(CASE WHEN hit_count > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate
    FROM query_events WHERE {SINCE_SQL.format(7)} GROUP BY 1
    ORDER BY count(*) DESC, max(created_at) DESC, 1 LIMIT 20""",
)
def top_queries(t: Tables) -> DataFrame:
    return an.top_queries(t.query_events, since(7)).withColumns(
        {"last_seen": F.date_format("last_seen", STAMP), "hit_rate": F.round("hit_rate", 6)}
    )


@query(
    "zero_hit_queries",
    f"""SELECT id, {sstamp('created_at')}, query, intent, requester_type, requester_id
    FROM query_events q WHERE hit_count = 0 AND {SINCE_SQL.format(7)}
    ORDER BY q.created_at DESC, id LIMIT 50""",
)
def zero_hit_queries(t: Tables) -> DataFrame:
    return an.zero_hit_queries(t.query_events, since(7)).withColumn(
        "created_at", F.date_format("created_at", STAMP)
    )


@query(
    "low_score_queries",
    f"""SELECT id, {sstamp('created_at')}, query, intent, top_score, hit_count, requester_type
    FROM query_events q WHERE hit_count > 0 AND top_score < 0.35 AND {SINCE_SQL.format(7)}
    ORDER BY q.created_at DESC, id LIMIT 50""",
)
def low_score_queries(t: Tables) -> DataFrame:
    return an.low_score_queries(t.query_events, since(7)).withColumn(
        "created_at", F.date_format("created_at", STAMP)
    )


@query(
    "hit_rate_daily",
    f"""SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS total,
    count(*) FILTER (hit_count > 0) AS hits,
    round(count(*) FILTER (hit_count > 0) / count(*), 6) AS hit_rate
    FROM query_events WHERE {SINCE_SQL.format(30)} GROUP BY 1""",
)
def hit_rate_daily(t: Tables) -> DataFrame:
    return an.hit_rate_daily(t.query_events, since(30)).withColumns(
        {"day": F.date_format("day", "yyyy-MM-dd"), "hit_rate": F.round("hit_rate", 6)}
    )


@query(
    "analytics_overview",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS period, count(*) AS total,
        CASE WHEN count(*) > 0 THEN round(count(*) FILTER (hit_count > 0) / count(*), 6) ELSE 0 END AS hit_rate,
        count(*) FILTER (hit_count = 0) AS zero_hit FROM query_events WHERE {SINCE_SQL.format(days)}"""
        for name, days in (("today", 1), ("last_7d", 7), ("last_30d", 30))
    ),
)
def analytics_overview(t: Tables) -> DataFrame:
    windows = {"today": since(1), "last_7d": since(7), "last_30d": since(30)}
    return an.overview(t.query_events, windows).withColumn("hit_rate", F.round("hit_rate", 6))


@query(
    "top_chunks",
    f"""SELECT chunk_id, count(*) AS count FROM (SELECT unnest(retrieved_chunk_ids) AS chunk_id
    FROM query_events WHERE {SINCE_SQL.format(7)}) WHERE chunk_id <> '' GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 20""",
)
def top_chunks(t: Tables) -> DataFrame:
    return an.top_chunks(t.query_events, since(7))


@query("zero_hit_clusters")
def zero_hit_clusters(t: Tables) -> DataFrame:
    return an.zero_hit_clusters(t.query_events, since(7))


@query(
    "zero_hit_cluster_total",
    f"""SELECT CAST(count(*) AS BIGINT) AS event_count FROM query_events
    WHERE hit_count = 0 AND trim(query) <> '' AND {SINCE_SQL.format(7)}""",
)
def zero_hit_cluster_total(t: Tables) -> DataFrame:
    """Events of all clusters together: every zero-hit event of the window is in one."""
    return an.zero_hit_clusters(t.query_events, since(7)).agg(F.sum("event_count").alias("event_count"))


@query("cluster_summaries")
def cluster_summaries(t: Tables) -> DataFrame:
    """Newest stored cluster summaries; here one clustering of 30 days of zero-hit traffic."""
    found = an.zero_hit_clusters(t.query_events, since(30))
    stored = found.withColumn("period_end", now()).withColumn("period_start", since(30))
    return stored.orderBy(F.desc("period_end"), F.desc("event_count"), F.asc("cluster_label")).limit(20)


@query(
    "alias_list",
    """SELECT id, canonical, array_to_string(aliases, '|') AS aliases,
    row_number() OVER (ORDER BY updated_at DESC, id) AS position
    FROM retrieval_aliases WHERE status = 'active' ORDER BY position LIMIT 100""",
)
def alias_list(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    page = (
        t.retrieval_aliases.filter("status = 'active'")
        .orderBy(F.desc("updated_at"), F.asc("id"))
        .limit(100)
    )
    # the page is bounded by its limit, so numbering it in one place is fine
    position = F.row_number().over(W.orderBy(F.desc("updated_at"), F.asc("id"))).cast("long")
    return page.select(
        "id", "canonical", F.array_join("aliases", "|").alias("aliases"), position.alias("position")
    )


FAQ_WHERE = """(question ILIKE '%the%' OR answer ILIKE '%the%' OR coalesce(category, '') ILIKE '%the%')
  AND status = 'usable'"""


@query(
    "faq_list",
    f"""SELECT id, question, answer, category, status, embedding_status FROM faq_documents
    WHERE {FAQ_WHERE} ORDER BY updated_at DESC, id LIMIT 20 OFFSET 5""",
)
def faq_list(t: Tables) -> DataFrame:
    text = (
        F.col("question").ilike("%the%")
        | F.col("answer").ilike("%the%")
        | F.coalesce("category", F.lit("")).ilike("%the%")
    )
    return (
        t.faq_documents.filter(text & (F.col("status") == "usable"))
        .orderBy(F.desc("updated_at"), F.asc("id"))
        .offset(5)
        .limit(20)
        .select("id", "question", "answer", "category", "status", "embedding_status")
    )


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per value of each column over the unfiltered table, in one scan."""
    sets = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
        ).alias("x")
    )
    return sets.groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "faq_facets",
    """SELECT 'status' AS facet, status AS value, count(*) AS n FROM faq_documents GROUP BY ALL
    UNION ALL SELECT 'embedding_status', embedding_status, count(*) FROM faq_documents GROUP BY ALL""",
)
def faq_facets(t: Tables) -> DataFrame:
    return facets(t.faq_documents, ["status", "embedding_status"])


@query(
    "embedding_backlog",
    f"""SELECT id, embedding_status, {sstamp('updated_at')} FROM faq_documents f
    WHERE embedding_status IN ('pending', 'stale', 'failed') ORDER BY f.updated_at, id LIMIT 20""",
)
def embedding_backlog(t: Tables) -> DataFrame:
    return (
        t.faq_documents.filter(F.col("embedding_status").isin("pending", "stale", "failed"))
        .orderBy("updated_at", "id")
        .limit(20)
        .select("id", "embedding_status", stamp("updated_at"))
    )


@query(
    "conversation_prompt",
    """WITH m AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g')) AS c,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
    k AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN '[USER] ' ELSE '[Agent] ' END ||
        CASE WHEN length(c) > 1200 THEN regexp_replace(substr(c, 1, 1197), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+$', '') || '...' ELSE c END AS line
      FROM m WHERE rn <= 12 AND role IN ('user', 'assistant') AND c <> '')
    SELECT conv_id, '<history>' || chr(10) || string_agg(line, chr(10) ORDER BY turn) || chr(10) || '</history>' AS prompt, count(*) AS messages
    FROM k GROUP BY conv_id""",
)
def conversation_prompt(t: Tables) -> DataFrame:
    from loreframe.operators.conversation import clean_context

    return clean_context(t.raw("conversations"))


@query(
    "conversation_context",
    """WITH m AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g')) AS c
        FROM conversations WHERE role IN ('user', 'assistant')),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM m WHERE c <> ''),
    p AS (SELECT conv_id, turn, rn, role, CASE role WHEN 'user' THEN '用户：' ELSE '助手：' END AS who,
      CASE WHEN length(c) > 1200 THEN regexp_replace(substr(c, 1, 1197), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+$', '') || '...' ELSE c END AS long,
      CASE WHEN length(c) > 120 THEN regexp_replace(substr(c, 1, 117), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+$', '') || '...' ELSE c END AS short FROM r),
    a AS (SELECT conv_id, count(*) FILTER (rn <= 10) AS recent_count,
      string_agg(role || ': ' || long, chr(10) ORDER BY turn) FILTER (rn <= 10) AS recent,
      coalesce(string_agg(who || short, '；' ORDER BY turn) FILTER (rn > 10), '') AS s FROM p GROUP BY conv_id)
    SELECT conv_id, recent_count, recent, CASE WHEN length(s) > 1200
      THEN regexp_replace(substr(s, 1, 1197), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+$', '') || '...' ELSE s END AS summary FROM a""",
)
def conversation_context(t: Tables) -> DataFrame:
    from loreframe.operators.conversation import compact_context

    return compact_context(t.raw("conversations"))


@query(
    "conversation_outline",
    """WITH m AS (SELECT conv_id, turn, trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g')) AS c
        FROM conversations WHERE role = 'user'),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx,
        count(*) OVER (PARTITION BY conv_id) AS n FROM m)
    SELECT conv_id, turn, idx, CASE WHEN c = '' THEN '空问题' WHEN length(c) > 34 THEN substr(c, 1, 31) || '...' ELSE c END AS summary
    FROM r WHERE n <= 20 OR list_contains(list_transform(range(0, 20),
      lambda i: CAST(floor(i * (n - 1) / 19.0 + 0.5) AS BIGINT)), idx - 1)""",
)
def conversation_outline(t: Tables) -> DataFrame:
    from loreframe.operators.conversation import outline

    return outline(t.raw("conversations"))
