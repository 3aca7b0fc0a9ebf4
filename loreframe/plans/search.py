"""Gates, terms, channels, fusion and the flagship hybrid query."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loreframe.functions import text as tx
from loreframe.functions.constants import MIN_SCORE, TOP_K
from loreframe.operators import gates, retrieval as rt
from loreframe.plans.bindings_sql import compact, register, strip
from loreframe.plans.registry import query
from loreframe.session import written
from loreframe.sources.tables import Tables

LIMIT = rt.candidate_limit(TOP_K)

DOMAIN_SQL = (
    "['团体报告','测评报告','报告','生成','导出','下载','登录','密码','账号','账户','订单','退款',"
    "'发票','上传','配置','审核','失败','报错','无法','权限','微信','后台','状态','进度']"
)

register(
    "live_rows",
    """SELECT kc.* FROM knowledge_chunks kc
    LEFT JOIN import_files f ON kc.source_type = 'document' AND f.id = kc.source_id
    LEFT JOIN import_chunks c ON kc.source_type = 'document' AND c.id = kc.source_chunk_id
      AND c.file_id = kc.source_id
    LEFT JOIN faq_documents q ON kc.source_type = 'faq' AND q.id = kc.source_id
    WHERE kc.embedding_status = 'ready' AND (
      (kc.source_type = 'faq' AND q.status = 'usable' AND q.embedding_status = 'ready')
      OR (kc.source_type = 'document' AND kc.status = 'usable' AND kc.chunk_level = 'child'
          AND f.id IS NOT NULL AND c.id IS NOT NULL AND NOT f.is_disabled AND NOT c.is_disabled))""",
)
register("query_text", f"SELECT query_id, query, {compact('query')} AS text FROM queries")
register(
    "alias_hits",
    f"""SELECT t.query_id, a.id AS alias_id, a.updated_at, {strip('a.canonical')} AS canonical,
      list_filter(a.aliases, lambda x: x <> '' AND contains(t.text, x)) AS matched, a.aliases
    FROM query_text t JOIN retrieval_aliases a ON a.status = 'active' AND (
      (a.canonical <> '' AND contains(t.text, a.canonical))
      OR len(list_filter(a.aliases, lambda x: x <> '' AND contains(t.text, x))) > 0)""",
)
register(
    "alias_terms_of",
    """SELECT query_id, flatten(list(list_filter(matched || [canonical] || aliases, lambda x: x <> '')
        ORDER BY updated_at DESC, alias_id DESC)) AS names
    FROM alias_hits GROUP BY query_id""",
)
register(
    "keyword_term_rows",
    f"""SELECT query_id, query, list_slice(list_reduce(
        list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_-]{{1,}}'), lambda w: [w]),
        lambda acc, x: CASE WHEN list_contains(acc, upper(x[1])) OR list_contains(acc, x[1]) THEN acc
                            ELSE acc || x END, prior), 1, 20) AS terms
    FROM (SELECT query_id, query, text, list_transform(list_filter(list_transform(range(1, len(p) + 1),
            lambda i: {{'i': i, 'w': p[i]}}), lambda z: list_position(p, z.w) = z.i), lambda z: z.w) AS prior
      FROM (SELECT t.query_id, t.query, t.text,
          list_transform(regexp_extract_all(t.text,
            '\\b[A-Za-z]+[-_]?[0-9]{{2,}}[A-Za-z0-9_-]*\\b'), lambda c: upper(c))
          || coalesce(a.names, CAST([] AS VARCHAR[]))
          || list_filter({DOMAIN_SQL}, lambda w: contains(t.text, w)) AS p
        FROM query_text t LEFT JOIN alias_terms_of a USING (query_id)))""",
)
register(
    "vector_hits",
    f"""SELECT query_id, id, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
        SELECT q.query_id, r.id, round(list_cosine_similarity(CAST(q.query_embedding AS DOUBLE[]),
          CAST(r.embedding AS DOUBLE[])), 9) AS score FROM queries q CROSS JOIN live_rows r)
      WHERE score >= 0.35) WHERE rank <= {LIMIT}""",
)


def lexical_sql(rows: str, limit: int) -> str:
    """Phrase and term weights; plain patterns by contains, patterns with wildcards by LIKE."""
    def hit(field):
        return (
            f"CASE WHEN (plain AND contains(r.{field}, p)) OR "
            f"(NOT plain AND r.{field} LIKE '%' || p || '%' ESCAPE '\\') THEN"
        )

    return f"""SELECT query_id, id, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, updated_at DESC, id) AS rank
      FROM (SELECT query_id, id, updated_at, round(sum(s), 9) AS score FROM (
          SELECT q.query_id, r.id, r.updated_at, {hit('source_title')} wt ELSE 0 END
            + {hit('search_text')} ws ELSE 0 END + {hit('content')} wc ELSE 0 END AS s
          FROM (SELECT *, p NOT LIKE '%\\%%' ESCAPE '\\' AND NOT contains(p, '_')
                  AND NOT contains(p, '\\') AS plain FROM (
                SELECT query_id, lower({strip('query')}) AS p, 0.45::DOUBLE AS wt,
                  0.35::DOUBLE AS ws, 0.2::DOUBLE AS wc FROM keyword_term_rows WHERE {strip('query')} <> ''
                UNION ALL
                SELECT query_id, lower(unnest(CASE WHEN len(terms) > 0 THEN terms
                  ELSE [{strip('query')}] END)), 0.18::DOUBLE, 0.12::DOUBLE, 0.06::DOUBLE
                FROM keyword_term_rows WHERE {strip('query')} <> '')) q
          CROSS JOIN (SELECT id, updated_at, lower(source_title) AS source_title,
            lower(search_text) AS search_text, lower(content) AS content FROM {rows}) r)
        GROUP BY query_id, id, updated_at) WHERE score > 0) WHERE rank <= {limit}"""


register("keyword_hits", lexical_sql("live_rows", LIMIT))
register(
    "fused_rows",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC,
        coalesce(vector_score, -1) DESC, coalesce(keyword_score, -1) DESC, first_seen) AS rank FROM (
      SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused_score,
        max(CASE WHEN ord = 0 THEN score END) AS vector_score,
        max(CASE WHEN ord = 1 THEN score END) AS keyword_score,
        string_agg(CASE ord WHEN 0 THEN 'vector' ELSE 'keyword' END, ',' ORDER BY ord) AS channels,
        min(ord * 1000 + rank) AS first_seen
      FROM (SELECT *, 0 AS ord FROM vector_hits UNION ALL SELECT *, 1 FROM keyword_hits)
      GROUP BY query_id, id)) WHERE rank <= {LIMIT}""",
)


def live(t: Tables) -> DataFrame:
    return gates.live_chunks(t.knowledge_chunks, t.import_files, t.import_chunks, t.faq_documents)


def fused(t: Tables) -> DataFrame:
    _, vector, keyword = rt.hybrid_channels(t.queries, t.retrieval_aliases, live(t))
    return rt.fuse([rt.channel(vector, "vector", 0), rt.channel(keyword, "keyword", 1)], LIMIT)


HYBRID_COLUMNS = ["query_id", "rank", "id", "fused_score", "vector_score", "keyword_score", "channels"]


@query("live_chunks", "SELECT id, source_type, source_id, content FROM live_rows")
def live_chunks(t: Tables) -> DataFrame:
    return live(t).select("id", "source_type", "source_id", "content")


@query(
    "alias_expand",
    """SELECT query_id, alias_id, array_to_string(matched, '|') AS matched_aliases,
       array_to_string(list_filter(matched || [canonical] || aliases, lambda x: x <> ''), '|') AS names
       FROM alias_hits""",
)
def alias_expand(t: Tables) -> DataFrame:
    return rt.alias_matches(t.queries, t.retrieval_aliases).select(
        "query_id",
        "alias_id",
        F.array_join("matched_aliases", "|").alias("matched_aliases"),
        F.array_join("names", "|").alias("names"),
    )


@query(
    "keyword_terms",
    "SELECT query_id, query, array_to_string(terms, '|') AS terms FROM keyword_term_rows",
)
def keyword_terms(t: Tables) -> DataFrame:
    return rt.keyword_terms(t.queries, t.retrieval_aliases).withColumn(
        "terms", F.array_join("terms", "|")
    )


@query("vector_topk", "SELECT query_id, id, round(score, 6) AS score, rank FROM vector_hits")
def vector_topk(t: Tables) -> DataFrame:
    return rt.vector_topk(t.queries, live(t), LIMIT).withColumn("score", F.round("score", 6))


@query("vector_topk_lsh")
def vector_topk_lsh(t: Tables) -> DataFrame:
    return rt.vector_topk_lsh(t.queries, live(t), LIMIT)


@query("vector_topk_coded")
def vector_topk_coded(t: Tables) -> DataFrame:
    return rt.vector_topk_coded(t.queries, live(t), LIMIT)


@query(
    "vector_coded_recall",
    """SELECT count(*) AS exact_hits, true AS recall_at_least_90_percent, true AS candidates_at_most_5_percent FROM vector_hits""",
)
def vector_coded_recall(t: Tables) -> DataFrame:
    """The coded search measured against the exact one, over all queries and rows."""
    queries, rows = t.queries, rt._vector_rows(live(t))
    exact = written(rt.vectorcells.exact_topk(queries, rows, LIMIT, MIN_SCORE).select("query_id", "id"), "exact")
    candidates = written(rt.vectorcells.coded_candidates(queries, rows, LIMIT, MIN_SCORE), "candidates")
    approximate = rt.vectorcells.rescored(candidates, queries, rows, LIMIT, MIN_SCORE).select("query_id", "id")
    found = exact.join(approximate, ["query_id", "id"], "left_semi").agg(F.count(F.lit(1)).alias("found"))
    wanted = exact.agg(F.count(F.lit(1)).alias("exact_hits"))
    offered = candidates.agg(F.count(F.lit(1)).alias("offered"))
    pairs = queries.agg(F.count(F.lit(1)).alias("q")).crossJoin(rows.agg(F.count(F.lit(1)).alias("r")))
    one = wanted.crossJoin(found).crossJoin(offered).crossJoin(pairs)  # one row of totals each
    return one.select(
        "exact_hits",
        (F.col("found") >= 0.9 * F.col("exact_hits")).alias("recall_at_least_90_percent"),
        (F.col("offered") <= 0.05 * F.col("q") * F.col("r")).alias("candidates_at_most_5_percent"),
    )


@query("vector_ring_visits")
def vector_ring_visits(t: Tables) -> DataFrame:
    """Rings and rows that the exact search reads for each query."""
    return rt.vectorcells.ring_visits(t.queries, rt._vector_rows(live(t)), LIMIT, MIN_SCORE)


@query("keyword_topk", "SELECT query_id, id, round(score, 6) AS score, rank FROM keyword_hits")
def keyword_topk(t: Tables) -> DataFrame:
    terms = rt.keyword_terms(t.queries, t.retrieval_aliases)
    return rt.keyword_topk(terms, live(t), LIMIT).withColumn("score", F.round("score", 6))


@query("keyword_topk_indexed", "SELECT query_id, id, round(score, 6) AS score, rank FROM keyword_hits")
def keyword_topk_indexed(t: Tables) -> DataFrame:
    terms = rt.keyword_terms(t.queries, t.retrieval_aliases)
    return rt.keyword_topk_indexed(terms, live(t), LIMIT).withColumn("score", F.round("score", 6))


_HYBRID_SQL = f"""SELECT query_id, rank, id, fused_score, round(vector_score, 6) AS vector_score,
  round(keyword_score, 6) AS keyword_score, channels FROM fused_rows"""


@query("hybrid_topk", f"{_HYBRID_SQL} WHERE rank <= {TOP_K}")
def hybrid_topk(t: Tables) -> DataFrame:
    return _rounded(rt.hybrid_topk(t.queries, t.retrieval_aliases, live(t)))


@query("rrf_fusion", _HYBRID_SQL)
def rrf_fusion(t: Tables) -> DataFrame:
    return _rounded(fused(t))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*HYBRID_COLUMNS).withColumns(
        {c: F.round(c, 6) for c in ("vector_score", "keyword_score")}
    )


def provider_positions(candidates: DataFrame) -> DataFrame:
    """A stand-in rerank answer: a fixed permutation with some invalid indexes."""
    index = F.col("rank") - 1
    return candidates.select(
        "query_id",
        ((index * 7 + F.col("query_id")) % 11).alias("position"),
        F.when(index % 4 == 3, F.lit(99)).otherwise(index).cast("long").alias("index"),
    )


register(
    "provider_rows",
    """SELECT query_id, ((rank - 1) * 7 + query_id) % 11 AS position,
    CASE WHEN (rank - 1) % 4 = 3 THEN 99 ELSE rank - 1 END AS index FROM fused_rows""",
)


@query(
    "rerank_merge",
    f"""WITH sized AS (SELECT query_id, id, rank, count(*) OVER (PARTITION BY query_id) AS n FROM fused_rows),
    p AS (SELECT query_id, index, min(position) AS position FROM provider_rows GROUP BY ALL),
    j AS (SELECT s.query_id, s.id, s.rank, CASE WHEN s.n > {TOP_K} THEN p.position END AS pp
      FROM sized s LEFT JOIN p ON p.query_id = s.query_id AND p.index = s.rank - 1),
    o AS (SELECT query_id, id, rank AS fused_rank, max(pp IS NOT NULL) OVER (PARTITION BY query_id) AS rerank_used,
      row_number() OVER (PARTITION BY query_id ORDER BY pp NULLS LAST, rank) AS final_rank FROM j)
    SELECT * FROM o WHERE final_rank <= {TOP_K}""",
)
def rerank_merge(t: Tables) -> DataFrame:
    candidates = fused(t).select("query_id", "id", "rank")
    merged = rt.rerank_merge(candidates, provider_positions(candidates), TOP_K)
    return merged.withColumnRenamed("rank", "fused_rank")


@query(
    "query_result_summary",
    f"""SELECT q.query_id, CAST(count(f.id) AS BIGINT) AS hit_count,
      arg_min(f.fused_score, f.rank) AS top_score, count(f.id) > 0 AS has_context
      FROM queries q LEFT JOIN fused_rows f ON f.query_id = q.query_id AND f.rank <= {TOP_K}
      GROUP BY q.query_id""",
)
def query_result_summary(t: Tables) -> DataFrame:
    hits = rt.hybrid_topk(t.queries, t.retrieval_aliases, live(t))
    found = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("hit_count"), F.min_by("fused_score", "rank").alias("top_score")
    )
    return t.queries.select("query_id").join(found, "query_id", "left").select(
        "query_id",
        F.coalesce("hit_count", F.lit(0)).alias("hit_count"),
        "top_score",
        (F.coalesce("hit_count", F.lit(0)) > 0).alias("has_context"),
    )


@query(
    "retrieval_trace",
    f"""SELECT k.query_id, array_to_string(k.terms, '|') AS terms,
      (SELECT count(*) FROM vector_hits v WHERE v.query_id = k.query_id) AS vector_count,
      (SELECT count(*) FROM keyword_hits v WHERE v.query_id = k.query_id) AS keyword_count,
      (SELECT count(*) FROM fused_rows v WHERE v.query_id = k.query_id) AS fused_count,
      CAST(0 AS BIGINT) AS fact_count, {LIMIT} AS candidate_limit, false AS rerank_used
      FROM keyword_term_rows k""",
)
def retrieval_trace(t: Tables) -> DataFrame:
    terms, vector, keyword = rt.hybrid_channels(t.queries, t.retrieval_aliases, live(t))
    ranked = rt.fuse([rt.channel(vector, "vector", 0), rt.channel(keyword, "keyword", 1)], LIMIT)
    steps = (
        vector.select("query_id", F.lit("vector").alias("step"))
        .unionByName(keyword.select("query_id", F.lit("keyword").alias("step")))
        .unionByName(ranked.select("query_id", F.lit("fused").alias("step")))
        .groupBy("query_id")
        .agg(
            *[
                F.count_if(F.col("step") == s).alias(f"{s}_count")
                for s in ("vector", "keyword", "fused")
            ]
        )
    )
    zero = F.lit(0).cast("long")
    return terms.join(steps, "query_id", "left").select(
        "query_id",
        F.array_join("terms", "|").alias("terms"),
        *[F.coalesce(f"{s}_count", zero).alias(f"{s}_count") for s in ("vector", "keyword", "fused")],
        zero.alias("fact_count"),
        F.lit(LIMIT).alias("candidate_limit"),
        F.lit(False).alias("rerank_used"),
    )
