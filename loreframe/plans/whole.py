"""A whole retrieval run for the questions of the graph: three channels, rerank, parents, and its trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loreframe.functions.constants import TOP_K
from loreframe.operators import retrieval as rt
from loreframe.plans.bindings_sql import register
from loreframe.plans.graphs import expanded, kg_terms
from loreframe.plans.ingest_state import stored_rows
from loreframe.plans.registry import query
from loreframe.plans.search import LIMIT, live, provider_positions
from loreframe.sources.tables import Tables

register("kg_questions", "SELECT k.*, e.embedding AS query_embedding FROM kg_queries k LEFT JOIN embeddings e ON e.vec_id = k.query_id")
register(
    "kg_vector_hits",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
      SELECT q.query_id, r.id, round(list_cosine_similarity(CAST(q.query_embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 9) AS score
      FROM kg_questions q CROSS JOIN live_rows r) WHERE score >= 0.35) WHERE rank <= {LIMIT}""",
)
register(
    "whole_fused",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, coalesce(vector_score, -1) DESC,
        coalesce(keyword_score, -1) DESC, first_seen, id) AS rank FROM (
      SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS fused_score, max(CASE WHEN ord = 0 THEN s END) AS vector_score,
        max(CASE WHEN ord = 1 THEN s END) AS keyword_score, max(CASE WHEN ord = 2 THEN s END) AS kg_score,
        string_agg(CASE ord WHEN 0 THEN 'vector' WHEN 1 THEN 'keyword' ELSE 'kg' END, ',' ORDER BY ord) AS channels,
        min(ord * 1000 + r) AS first_seen FROM (
          SELECT query_id, id, 0 AS ord, rank AS r, score AS s FROM kg_vector_hits
          UNION ALL SELECT query_id, id, 1, rank, score FROM kg_keyword_hits
          UNION ALL SELECT query_id, id, 2, min(fact_rank), arg_min(fact_score, (fact_rank, -fact_score)) FROM expanded GROUP BY query_id, id)
      GROUP BY query_id, id)) WHERE rank <= {LIMIT}""",
)
register(
    "whole_result",
    f"""WITH sized AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM whole_fused),
    answer AS (SELECT query_id, CASE WHEN (rank - 1) % 4 = 3 THEN 99 ELSE rank - 1 END AS index, min(((rank - 1) * 7 + query_id) % 11) AS place
      FROM whole_fused GROUP BY ALL),
    j AS (SELECT s.*, CASE WHEN s.n > {TOP_K} THEN a.place END AS place FROM sized s LEFT JOIN answer a ON a.query_id = s.query_id AND a.index = s.rank - 1)
    SELECT query_id, id, fused_score, vector_score, keyword_score, kg_score, channels, rank AS fused_rank, used AS rerank_used, final AS rank
    FROM (SELECT *, max(place IS NOT NULL) OVER (PARTITION BY query_id) AS used,
      row_number() OVER (PARTITION BY query_id ORDER BY place NULLS LAST, rank) AS final FROM j) WHERE final <= {TOP_K}""",
)
register(
    "whole_parents",
    """SELECT DISTINCT r.query_id, p.id FROM whole_result r JOIN knowledge_chunks c ON c.id = r.id
    JOIN stored_rows p ON p.id = 'kc_document_' || c.source_chunk_id AND p.source_id = c.source_id AND p.source_chunk_id = c.source_chunk_id
    JOIN import_files f ON f.id = p.source_id AND NOT f.is_disabled
    JOIN import_chunks k ON k.id = p.source_chunk_id AND k.file_id = p.source_id AND NOT k.is_disabled
    WHERE c.source_type = 'document' AND p.chunk_level = 'parent' AND p.status = 'usable' AND p.embedding_status = 'ready'
      AND NOT EXISTS (SELECT 1 FROM whole_result x WHERE x.query_id = r.query_id AND x.id = p.id)""",
)

SCORES = ("vector_score", "keyword_score", "kg_score")


def questions(t: Tables) -> DataFrame:
    vectors = t.raw("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return kg_terms(t).select("query_id", "query").join(vectors, "query_id", "left")


def parent_rows(t: Tables) -> DataFrame:
    """Searchable rows with the parent row of their chunk, and the parent rows."""
    columns = ["id", "source_type", "source_id", "source_chunk_id", "chunk_level", "parent_chunk_id", "status", "embedding_status", "content"]
    above = F.when(F.col("source_type") == "document", F.concat(F.lit("kc_document_"), "source_chunk_id"))
    searched = t.knowledge_chunks.withColumn("parent_chunk_id", above).select(*columns)
    return searched.unionByName(stored_rows(t).filter("chunk_level = 'parent'").select(*columns))


def whole_run(t: Tables) -> tuple[dict[str, DataFrame], DataFrame]:
    """The steps of the run, and the parents of its result."""
    found = expanded(t).select("query_id", "id", F.col("fact_rank").alias("rank"), F.col("fact_score").alias("score"))
    run = rt.hybrid_run(questions(t), kg_terms(t), live(t), found, TOP_K, provider_positions)
    parents = rt.parent_context(run["result"], parent_rows(t), t.import_files, t.import_chunks)
    return run, parents


@query(
    "hybrid_whole",
    """SELECT query_id, 'hit' AS role, id, rank, fused_rank, fused_score, round(vector_score, 6) AS vector_score, round(keyword_score, 6) AS keyword_score,
      round(kg_score, 6) AS kg_score, channels, rerank_used FROM whole_result
    UNION ALL SELECT query_id, 'parent', id, NULL, NULL, 1.0, NULL, NULL, NULL, NULL, NULL FROM whole_parents""",
)
def hybrid_whole(t: Tables) -> DataFrame:
    """Vector, keyword and fact channels fused, reranked, with the parents of the hits as context."""
    run, parents = whole_run(t)
    hits = run["result"].select(
        "query_id", F.lit("hit").alias("role"), "id", "rank", "fused_rank", "fused_score",
        *[F.round(c, 6).alias(c) for c in SCORES], "channels", "rerank_used",
    )
    context = parents.select("query_id", F.lit("parent").alias("role"), "id", F.col("score").alias("fused_score"))
    return hits.unionByName(context, allowMissingColumns=True)


@query(
    "hybrid_whole_trace",
    f"""SELECT q.query_id, q.query, (SELECT count(*) FROM kg_vector_hits v WHERE v.query_id = q.query_id) AS vector_count,
      (SELECT count(*) FROM kg_keyword_hits v WHERE v.query_id = q.query_id) AS keyword_count,
      (SELECT count(DISTINCT v.id) FROM expanded v WHERE v.query_id = q.query_id) AS kg_count,
      (SELECT count(*) FROM whole_fused v WHERE v.query_id = q.query_id) AS fused_count,
      (SELECT count(*) FROM whole_result v WHERE v.query_id = q.query_id) AS result_count,
      (SELECT count(*) FROM whole_parents v WHERE v.query_id = q.query_id) AS parent_count,
      (SELECT count(*) FROM whole_fused v WHERE v.query_id = q.query_id) > {TOP_K} AS rerank_used FROM kg_queries q""",
)
def hybrid_whole_trace(t: Tables) -> DataFrame:
    """What each step of the whole run brought each question."""
    run, parents = whole_run(t)
    return rt.hybrid_trace(kg_terms(t), run, parents)
