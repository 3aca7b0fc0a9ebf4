"""Graph evidence, review, search and construction queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loreframe.functions import text as tx
from loreframe.operators import gates, graph as kg, lifecycle as lc, retrieval as rt
from loreframe.plans.bindings_sql import NOW, compact, register, strip
from loreframe.plans.ingest_state import FAQ_CONTENT  # noqa: F401  (shared bindings)
from loreframe.plans.registry import query
from loreframe.plans.search import LIMIT, lexical_sql
from loreframe.plans.textual import _sql_entity_id
from loreframe.scale import dense_position, position_in_group
from loreframe.session import written
from loreframe.sources.tables import Tables

register(
    "live_ev",
    """SELECT e.* FROM kg_evidence e
    LEFT JOIN faq_documents q ON e.source_type = 'faq' AND q.id = e.source_id
    LEFT JOIN import_files f ON e.source_type = 'document' AND f.id = e.source_id
    LEFT JOIN import_chunks c ON e.source_type = 'document' AND c.id = e.source_chunk_id AND c.file_id = f.id
    WHERE (e.source_type = 'faq' AND q.status = 'usable') OR (e.source_type = 'document' AND f.id IS NOT NULL
      AND c.id IS NOT NULL AND NOT f.is_disabled AND NOT c.is_disabled)""",
)


def live(t: Tables) -> DataFrame:
    return gates.live_evidence(t.kg_evidence, t.import_files, t.import_chunks, t.faq_documents)


def cited(t: Tables) -> DataFrame:
    """All live evidence for queries that move its rows."""
    return gates.often_cited_evidence(t.kg_evidence, t.import_files, t.import_chunks, t.faq_documents)


def owners(t: Tables) -> DataFrame:
    return t.kg_entities.select("id").unionByName(t.kg_relations.select("id"))


@query("live_evidence", "SELECT id, entity_id, relation_id, source_type, source_id, source_chunk_id FROM live_ev")
def live_evidence(t: Tables) -> DataFrame:
    return live(t).select("id", "entity_id", "relation_id", "source_type", "source_id", "source_chunk_id")


register("owner_ids", "SELECT id FROM kg_entities UNION ALL SELECT id FROM kg_relations")


@query(
    "owner_has_evidence",
    """SELECT id FROM owner_ids o WHERE EXISTS (SELECT 1 FROM live_ev e WHERE e.entity_id = o.id)
    OR EXISTS (SELECT 1 FROM live_ev e WHERE e.relation_id = o.id)""",
)
def owner_has_evidence(t: Tables) -> DataFrame:
    return owners(t).join(live(t).select(kg.owner_id().alias("id")), "id", "left_semi")


@query(
    "owner_evidence_count",
    """SELECT o.id, count(DISTINCT e.id) AS evidence_count FROM owner_ids o
    LEFT JOIN live_ev e ON coalesce(e.entity_id, e.relation_id) = o.id GROUP BY o.id""",
)
def owner_evidence_count(t: Tables) -> DataFrame:
    ev = live(t)
    counts = kg.evidence_counts(ev, "entity_id").unionByName(kg.evidence_counts(ev, "relation_id"))
    return kg.with_count(owners(t), counts, "evidence_count")


@query(
    "kg_entity_source_count",
    """SELECT n.id, count(DISTINCT (e.source_type, e.source_id, coalesce(e.source_chunk_id, ''))) FILTER (e.id IS NOT NULL) AS source_count
    FROM kg_entities n LEFT JOIN live_ev e ON e.entity_id = n.id GROUP BY n.id""",
)
def kg_entity_source_count(t: Tables) -> DataFrame:
    return kg.entity_source_counts(t.kg_entities.select("id"), live(t))


@query(
    "kg_relation_evidence_count",
    """SELECT r.id, count(e.id) AS evidence_count FROM kg_relations r LEFT JOIN live_ev e ON e.relation_id = r.id GROUP BY r.id""",
)
def kg_relation_evidence_count(t: Tables) -> DataFrame:
    return kg.with_count(t.kg_relations.select("id"), kg.evidence_counts(live(t), "relation_id"), "evidence_count")


@query(
    "kg_entity_list",
    """WITH page AS (SELECT * FROM kg_entities WHERE status = 'needs_review' AND entity_type = 'feature_ui_action'
      ORDER BY updated_at DESC, id LIMIT 50)
    SELECT p.id, p.name, p.entity_type, p.status, (SELECT count(*) FROM kg_evidence e WHERE e.entity_id = p.id) AS evidence_rows,
      (SELECT count(*) FROM live_ev e WHERE e.entity_id = p.id) > 0 AS has_valid_evidence,
      (SELECT count(*) FROM kg_entities WHERE status = 'needs_review' AND entity_type = 'feature_ui_action') AS total FROM page p""",
)
def kg_entity_list(t: Tables) -> DataFrame:
    matching = t.kg_entities.filter("status = 'needs_review' and entity_type = 'feature_ui_action'")
    page = matching.orderBy(F.desc("updated_at"), F.asc("id")).limit(50).select("id", "name", "entity_type", "status")
    ev = t.kg_evidence.filter("entity_id is not null").join(
        page.select(F.col("id").alias("entity_id")), "entity_id", "left_semi"
    )
    flagged = gates.with_validity(ev, t.import_files, t.import_chunks, t.faq_documents)
    counts = flagged.groupBy(F.col("entity_id").alias("id")).agg(
        F.count(F.lit(1)).alias("evidence_rows"), F.bool_or("is_valid").alias("has_valid_evidence")
    )
    total = matching.agg(F.count(F.lit(1)).alias("total"))
    return (
        kg.with_count(page, counts, "evidence_rows")
        .withColumn("has_valid_evidence", F.coalesce("has_valid_evidence", F.lit(False)))
        .join(total, F.lit(True))
    )


@query(
    "kg_relation_list",
    """WITH page AS (SELECT r.*, h.name AS head_name, h.status AS head_status, t.name AS tail_name, t.status AS tail_status
      FROM kg_relations r JOIN kg_entities h ON h.id = r.head_entity_id JOIN kg_entities t ON t.id = r.tail_entity_id
      WHERE r.status = 'needs_review' ORDER BY r.updated_at DESC, r.id LIMIT 50)
    SELECT p.id, p.head_name, p.relation_type, p.tail_name, p.head_status, p.tail_status,
      (SELECT count(DISTINCT e.id) FROM live_ev e WHERE e.relation_id = p.id) AS evidence_count FROM page p""",
)
def kg_relation_list(t: Tables) -> DataFrame:
    names = t.kg_entities.select("id", "name", "status")
    page = (
        t.kg_relations.filter("status = 'needs_review'")
        .join(names.toDF("head_entity_id", "head_name", "head_status"), "head_entity_id")
        .join(names.toDF("tail_entity_id", "tail_name", "tail_status"), "tail_entity_id")
        .orderBy(F.desc("updated_at"), F.asc("id"))
        .limit(50)
    )
    ev = t.kg_evidence.join(page.select(F.col("id").alias("relation_id")), "relation_id", "left_semi")
    ok = gates.live_evidence(ev, t.import_files, t.import_chunks, t.faq_documents)
    return kg.with_count(page, kg.evidence_counts(ok, "relation_id"), "evidence_count").select(
        "id", "head_name", "relation_type", "tail_name", "head_status", "tail_status", "evidence_count"
    )


@query(
    "kg_text_filter",
    """SELECT id, name FROM kg_entities WHERE contains(lower(concat_ws(' ', name, entity_type, status, description,
      array_to_string(aliases, ' '))), 'ring')""",
)
def kg_text_filter(t: Tables) -> DataFrame:
    joined = F.concat_ws(" ", "name", "entity_type", "status", "description", F.array_join("aliases", " "))
    return t.kg_entities.filter(F.lower(joined).contains("ring")).select("id", "name")


@query(
    "kg_evidence_list",
    f"""SELECT coalesce(entity_id, relation_id) AS owner_id, id, excerpt, char_start, char_end,
    row_number() OVER (PARTITION BY coalesce(entity_id, relation_id) ORDER BY created_at, id) AS position FROM live_ev""",
)
def kg_evidence_list(t: Tables) -> DataFrame:
    rows = cited(t).select(kg.owner_id().alias("owner_id"), "id", "excerpt", "char_start", "char_end", "created_at")
    placed = position_in_group(
        rows, ["owner_id"], F.to_date("created_at"), [F.col("created_at"), F.col("id")], "position"
    )
    return placed.select("owner_id", "id", "excerpt", "char_start", "char_end", "position")


@query(
    "evidence_target",
    """SELECT id, CASE WHEN source_type = 'faq' THEN 'faq' WHEN source_chunk_id IS NOT NULL THEN 'document' END AS target,
    source_id AS target_id, CASE WHEN source_type = 'document' THEN source_chunk_id END AS target_chunk FROM kg_evidence""",
)
def evidence_target(t: Tables) -> DataFrame:
    doc = F.col("source_type") == "document"
    return t.kg_evidence.select(
        "id",
        F.when(F.col("source_type") == "faq", "faq").when(F.col("source_chunk_id").isNotNull(), "document").alias("target"),
        F.col("source_id").alias("target_id"),
        F.when(doc, F.col("source_chunk_id")).alias("target_chunk"),
    )


_BLOCKED = """SELECT r.id, CASE WHEN NOT EXISTS (SELECT 1 FROM live_ev e WHERE e.relation_id = r.id) THEN 'no_live_evidence'
  WHEN h.status <> 'usable' OR t.status <> 'usable' THEN 'endpoint_not_usable' END AS blocked_reason, r.review_revision, r.status
  FROM kg_relations r JOIN kg_entities h ON h.id = r.head_entity_id JOIN kg_entities t ON t.id = r.tail_entity_id
  UNION ALL SELECT n.id, CASE WHEN NOT EXISTS (SELECT 1 FROM live_ev e WHERE e.entity_id = n.id) THEN 'no_live_evidence' END,
    n.review_revision, n.status FROM kg_entities n"""
register("confirmable", _BLOCKED)


def confirmable(t: Tables) -> DataFrame:
    has = live(t).select(kg.owner_id().alias("id")).distinct().withColumn("ok", F.lit(True))
    status = t.kg_entities.select("id", "status")
    rel = (
        t.kg_relations.join(status.toDF("head_entity_id", "hs"), "head_entity_id")
        .join(status.toDF("tail_entity_id", "ts"), "tail_entity_id")
        .select("id", "review_revision", "status", ((F.col("hs") == "usable") & (F.col("ts") == "usable")).alias("ends"))
    )
    ent = t.kg_entities.select("id", "review_revision", "status", F.lit(True).alias("ends"))
    reason = F.when(F.col("ok").isNull(), "no_live_evidence").when(~F.col("ends"), "endpoint_not_usable")
    return rel.unionByName(ent).join(has, "id", "left").select(
        "id", reason.alias("blocked_reason"), "review_revision", "status"
    )


@query("kg_confirmable", "SELECT id, blocked_reason FROM confirmable")
def kg_confirmable(t: Tables) -> DataFrame:
    return confirmable(t).select("id", "blocked_reason")


@query(
    "kg_confirm",
    """SELECT id, coalesce(CASE WHEN review_revision = 2 THEN 'revision_conflict' END, blocked_reason, 'confirmed') AS outcome,
    CASE WHEN review_revision <> 2 AND blocked_reason IS NULL THEN 'usable' ELSE status END AS status
    FROM confirmable WHERE status = 'needs_review'""",
)
def kg_confirm(t: Tables) -> DataFrame:
    """Decisions carry the revision the reviewer saw; here at most 1, so revision 2 conflicts."""
    state = confirmable(t)
    decisions = state.filter("status = 'needs_review'").select(
        "id", F.least("review_revision", F.lit(1)).alias("seen_revision")
    )
    joined = decisions.join(state, "id")
    outcome = F.coalesce(
        F.when(F.col("seen_revision") != F.col("review_revision"), "revision_conflict"),
        "blocked_reason",
        F.lit("confirmed"),
    )
    return joined.select("id", outcome.alias("outcome"), "status").withColumn(
        "status", F.when(F.col("outcome") == "confirmed", "usable").otherwise(F.col("status"))
    )


@query(
    "kg_status_cascade",
    """SELECT r.id, 'needs_review' AS status FROM kg_relations r WHERE r.status = 'usable' AND (
      r.head_entity_id IN (SELECT id FROM kg_entities WHERE key % 17 = 3) OR r.tail_entity_id IN (SELECT id FROM kg_entities WHERE key % 17 = 3))""",
)
def kg_status_cascade(t: Tables) -> DataFrame:
    off = t.kg_entities.filter("key % 17 = 3").select(F.col("id").alias("e"))
    usable = t.kg_relations.filter("status = 'usable'").select("id", "head_entity_id", "tail_entity_id")
    hit = usable.join(off, F.col("head_entity_id") == F.col("e"), "left_semi").select("id").unionByName(
        usable.join(off, F.col("tail_entity_id") == F.col("e"), "left_semi").select("id")
    )
    return hit.distinct().select("id", F.lit("needs_review").alias("status"))


register("changed_sources", "SELECT 'document' AS source_type, id AS source_id FROM import_files WHERE id LIKE '%3' UNION ALL SELECT 'faq', id FROM faq_documents WHERE status <> 'usable'")
register(
    "affected",
    """SELECT DISTINCT 'entity' AS kind, e.entity_id AS id FROM kg_evidence e JOIN changed_sources s USING (source_type, source_id) WHERE e.entity_id IS NOT NULL
    UNION SELECT 'relation', e.relation_id FROM kg_evidence e JOIN changed_sources s USING (source_type, source_id) WHERE e.relation_id IS NOT NULL
    UNION SELECT 'relation', r.id FROM kg_relations r WHERE r.head_entity_id IN (SELECT e.entity_id FROM kg_evidence e JOIN changed_sources s USING (source_type, source_id) WHERE e.entity_id IS NOT NULL)
      OR r.tail_entity_id IN (SELECT e.entity_id FROM kg_evidence e JOIN changed_sources s USING (source_type, source_id) WHERE e.entity_id IS NOT NULL)""",
)


def changed_sources(t: Tables) -> DataFrame:
    files = t.import_files.filter("id like '%3'").select(F.lit("document").alias("source_type"), F.col("id").alias("source_id"))
    return files.unionByName(
        t.faq_documents.filter("status <> 'usable'").select(F.lit("faq").alias("source_type"), F.col("id").alias("source_id"))
    )


def affected(t: Tables) -> DataFrame:
    return kg.affected_owners(t.kg_evidence, t.kg_relations, changed_sources(t))


@query("kg_affected_owners", "SELECT kind, id FROM affected")
def kg_affected_owners(t: Tables) -> DataFrame:
    return affected(t)


@query(
    "kg_reconcile",
    """SELECT kind, id, live_count, CASE WHEN live_count = 0 THEN 'disabled' ELSE 'needs_review' END AS status, review_revision + 1 AS review_revision FROM (
      SELECT a.kind, n.id, n.review_revision, count(DISTINCT (e.source_type, e.source_id, coalesce(e.source_chunk_id, ''))) FILTER (e.id IS NOT NULL) AS live_count
      FROM affected a JOIN kg_entities n ON a.kind = 'entity' AND n.id = a.id LEFT JOIN live_ev e ON e.entity_id = n.id GROUP BY ALL
      UNION ALL SELECT a.kind, r.id, r.review_revision, count(DISTINCT e.id) FROM affected a JOIN kg_relations r ON a.kind = 'relation' AND r.id = a.id
      LEFT JOIN live_ev e ON e.relation_id = r.id GROUP BY ALL)""",
)
def kg_reconcile(t: Tables) -> DataFrame:
    touched, ev = affected(t), live(t)
    entities = kg.entity_source_counts(t.kg_entities.select("id", "review_revision"), ev)
    relations = kg.with_count(
        t.kg_relations.select("id", "review_revision"), kg.evidence_counts(ev, "relation_id"), "evidence_count"
    )
    return (
        kg.reconcile(entities, touched.filter("kind = 'entity'"), "source_count")
        .select(F.lit("entity").alias("kind"), "*")
        .unionByName(
            kg.reconcile(relations, touched.filter("kind = 'relation'"), "evidence_count").select(
                F.lit("relation").alias("kind"), "*"
            )
        )
    )


@query(
    "kg_snapshot",
    """SELECT id, relation_id, entity_id, 'kept' AS state FROM kg_evidence WHERE NOT (source_type = 'document' AND source_id LIKE '%3')
    UNION ALL SELECT 'new_' || id, relation_id, entity_id, 'new' FROM kg_evidence WHERE source_type = 'document' AND source_id LIKE '%3' AND char_start % 2 = 0""",
)
def kg_snapshot(t: Tables) -> DataFrame:
    """The changed files' evidence is replaced as a whole by the new extraction's."""
    base = t.kg_evidence.select("id", "relation_id", "entity_id", "source_type", "source_id", "char_start")
    scope = t.import_files.filter("id like '%3'").select(F.lit("document").alias("source_type"), F.col("id").alias("source_id"))
    new = base.filter("source_type = 'document' and source_id like '%3' and char_start % 2 = 0")
    kept = base.join(scope, ["source_type", "source_id"], "left_anti")
    return kept.select("id", "relation_id", "entity_id", F.lit("kept").alias("state")).unionByName(
        new.select(F.concat(F.lit("new_"), "id").alias("id"), "relation_id", "entity_id", F.lit("new").alias("state"))
    )


@query(
    "kg_snapshot_counts",
    """SELECT job_id, CAST(sum(e) AS BIGINT) AS entities, CAST(sum(r) AS BIGINT) AS relations, CAST(sum(v) AS BIGINT) AS evidence FROM (
      SELECT job_id, count(DISTINCT (name, entity_type)) AS e, 0 AS r, count(*) AS v FROM map_entities GROUP BY job_id
      UNION ALL SELECT job_id, 0, count(DISTINCT (head_name, relation_type, tail_name)), 0 FROM map_relations GROUP BY job_id) GROUP BY job_id""",
)
def kg_snapshot_counts(t: Tables) -> DataFrame:
    mentions = t.map_entities.groupBy("job_id", "name", "entity_type").agg(F.count(F.lit(1)).alias("v"))
    facts = t.map_relations.select("job_id", "head_name", "relation_type", "tail_name").distinct()
    zero = F.lit(0).cast("long")
    return (
        mentions.groupBy("job_id").agg(F.count(F.lit(1)).alias("entities"), F.sum("v").alias("evidence"))
        .join(facts.groupBy("job_id").agg(F.count(F.lit(1)).alias("relations")), "job_id", "full")
        .select("job_id", *[F.coalesce(c, zero).alias(c) for c in ("entities", "relations", "evidence")])
    )


# --- fact search ----------------------------------------------------------------------------------

register("excerpts", """SELECT id, string_agg(excerpt, chr(10) ORDER BY c, ev) AS evidence_text FROM (
  SELECT coalesce(entity_id, relation_id) AS id, excerpt, min(created_at) AS c, min_by(id, (created_at, id)) AS ev FROM live_ev GROUP BY ALL) GROUP BY id""".replace("min_by(id, (created_at, id))", "arg_min(id, (created_at, id))"))
register(
    "fact_rows",
    """SELECT 'kc_kg_entity_' || n.id AS id, 'kg_entity' AS source_type, n.id AS source_id, n.name AS source_title,
      concat_ws(chr(10), '实体：' || n.name, '类型：' || n.entity_type, '别名：' || nullif(array_to_string(n.aliases, '，'), ''),
        '描述：' || nullif(n.description, '')) AS content,
      concat_ws(chr(10), n.name, array_to_string(n.aliases, chr(10)), n.entity_type, nullif(n.description, ''), x.evidence_text) AS search_text,
      n.status, n.updated_at FROM kg_entities n LEFT JOIN excerpts x ON x.id = n.id
    UNION ALL SELECT 'kc_kg_relation_' || r.id, 'kg_relation', r.id, h.name || ' ' || r.relation_type || ' ' || t.name,
      concat_ws(chr(10), '关系：' || r.relation_type, '头实体：' || h.name, '尾实体：' || t.name, '描述：' || nullif(r.description, '')),
      concat_ws(chr(10), h.name, t.name, r.relation_type, r.description, x.evidence_text), r.status, r.updated_at
    FROM kg_relations r JOIN kg_entities h ON h.id = r.head_entity_id JOIN kg_entities t ON t.id = r.tail_entity_id
    LEFT JOIN excerpts x ON x.id = r.id""",
)
register("usable_facts", "SELECT * FROM fact_rows WHERE status = 'usable'")
register("kg_queries", "SELECT min(p_partkey) AS query_id, p_name AS query FROM part GROUP BY p_name")
register(
    "kg_terms",
    """SELECT query_id, query, list_reduce(list_transform(regexp_extract_all(query, '[A-Za-z0-9][A-Za-z0-9_-]{1,}'), lambda w: [w]),
      lambda acc, x: CASE WHEN list_contains(acc, upper(x[1])) OR list_contains(acc, x[1]) THEN acc ELSE acc || x END,
      CAST([] AS VARCHAR[])) AS terms FROM kg_queries""",
)
register("fact_hits", lexical_sql("usable_facts", LIMIT).replace("keyword_term_rows", "kg_terms"))
register(
    "fact_links",
    """SELECT h.query_id, h.id AS fact_chunk_id, n.id AS fact_id, h.rank AS fact_rank, h.score AS fact_score, e.source_type, e.source_id, e.source_chunk_id
    FROM fact_hits h JOIN kg_entities n ON h.id = 'kc_kg_entity_' || n.id AND n.status = 'usable' JOIN kg_evidence e ON e.entity_id = n.id
    UNION ALL SELECT h.query_id, h.id, r.id, h.rank, h.score, e.source_type, e.source_id, e.source_chunk_id
    FROM fact_hits h JOIN kg_relations r ON h.id = 'kc_kg_relation_' || r.id AND r.status = 'usable'
    JOIN kg_entities a ON a.id = r.head_entity_id AND a.status = 'usable' JOIN kg_entities b ON b.id = r.tail_entity_id AND b.status = 'usable'
    JOIN kg_evidence e ON e.relation_id = r.id""",
)
register(
    "expanded",
    """SELECT DISTINCT l.query_id, k.id, l.fact_chunk_id, l.fact_id, l.fact_rank, l.fact_score FROM fact_links l
      JOIN faq_documents q ON q.id = l.source_id AND q.status = 'usable' AND q.embedding_status = 'ready'
      JOIN knowledge_chunks k ON k.source_type = 'faq' AND k.source_id = l.source_id AND k.status = 'usable' AND k.embedding_status = 'ready'
      WHERE l.source_type = 'faq'
    UNION SELECT DISTINCT l.query_id, k.id, l.fact_chunk_id, l.fact_id, l.fact_rank, l.fact_score FROM fact_links l
      JOIN import_files f ON f.id = l.source_id AND NOT f.is_disabled
      JOIN import_chunks c ON c.id = l.source_chunk_id AND c.file_id = l.source_id AND NOT c.is_disabled
      JOIN knowledge_chunks k ON k.source_type = 'document' AND k.source_id = l.source_id AND k.source_chunk_id = l.source_chunk_id
        AND k.chunk_level = 'child' AND k.status = 'usable' AND k.embedding_status = 'ready' WHERE l.source_type = 'document'""",
)


def facts(t: Tables) -> DataFrame:
    return kg.fact_rows(t.kg_entities, t.kg_relations, kg.evidence_excerpts(cited(t)))


def kg_terms(t: Tables) -> DataFrame:
    asked = t.raw("part").groupBy(F.col("p_name").alias("query")).agg(F.min("p_partkey").alias("query_id"))
    no = F.array().cast("array<string>")
    return asked.select(
        "query_id", "query", tx.append_tokens(no, tx.latin_tokens(tx.compact(F.col("query")))).alias("terms")
    )


def fact_hits(t: Tables) -> DataFrame:
    hits = rt.keyword_topk(kg_terms(t), facts(t).filter("status = 'usable'"), LIMIT)
    kind = F.when(F.col("id").startswith("kc_kg_entity_"), "kg_entity").otherwise("kg_relation")
    return hits.withColumn("source_type", kind).withColumn(
        "source_id", F.regexp_replace("id", "^kc_kg_(entity|relation)_", "")
    )


def expanded(t: Tables, hits: DataFrame | None = None) -> DataFrame:
    """The original rows behind the fact hits; the hits are read for entities and for relations, so written once."""
    return kg.expand_facts(
        written(fact_hits(t), "fact-hits") if hits is None else hits, t.kg_entities, t.kg_relations, t.kg_evidence, t.knowledge_chunks,
        t.import_files, t.import_chunks, t.faq_documents,
    )


@query("kg_projection", "SELECT id, source_type, source_id, source_title, content, search_text, status FROM fact_rows")
def kg_projection(t: Tables) -> DataFrame:
    return facts(t).select("id", "source_type", "source_id", "source_title", "content", "search_text", "status")


@query("kg_fact_topk", "SELECT query_id, id, score, rank FROM fact_hits")
def kg_fact_topk(t: Tables) -> DataFrame:
    return fact_hits(t).select("query_id", "id", "score", "rank")


@query("kg_expand", "SELECT query_id, id, fact_chunk_id, fact_id, fact_rank, fact_score FROM expanded")
def kg_expand(t: Tables) -> DataFrame:
    return expanded(t).select("query_id", "id", "fact_chunk_id", "fact_id", "fact_rank", "fact_score")


@query(
    "kg_fact_diagnostics",
    """SELECT h.query_id, h.id AS fact_chunk_id, h.rank AS fact_rank, h.score AS fact_score, x.id AS expanded_id
    FROM fact_hits h LEFT JOIN expanded x ON x.query_id = h.query_id AND x.fact_chunk_id = h.id""",
)
def kg_fact_diagnostics(t: Tables) -> DataFrame:
    """Every fact hit with the rows it expands to; a fact without any keeps one empty row."""
    hits = written(fact_hits(t), "fact-hits")
    found = expanded(t, hits).select("query_id", "fact_chunk_id", F.col("id").alias("expanded_id"))
    return hits.select(
        "query_id", F.col("id").alias("fact_chunk_id"), F.col("rank").alias("fact_rank"), F.col("score").alias("fact_score")
    ).join(found, ["query_id", "fact_chunk_id"], "left")


register("kg_keyword_hits", lexical_sql("live_rows", LIMIT).replace("keyword_term_rows", "kg_terms"))


@query(
    "kg_fusion",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, coalesce(keyword_score, -1) DESC, first_seen, id) AS rank,
      coalesce((SELECT string_agg(concat_ws(' ', x.r, x.fact_chunk_id, x.fact_id, CASE WHEN x.fact_chunk_id LIKE 'kc_kg_entity_%' THEN 'kg_entity' ELSE 'kg_relation' END,
        CAST(round(x.s * 100) AS BIGINT)), ',' ORDER BY x.r, x.fact_chunk_id) FROM (
          SELECT query_id, id, fact_chunk_id, fact_id, min(fact_rank) AS r, arg_min(fact_score, (fact_rank, -fact_score)) AS s FROM expanded GROUP BY ALL) x
        WHERE x.query_id = v.query_id AND x.id = v.id), '') AS kg_matches FROM (
      SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS fused_score, max(CASE WHEN ord = 1 THEN s END) AS keyword_score,
        max(CASE WHEN ord = 2 THEN s END) AS kg_score, string_agg(CASE ord WHEN 1 THEN 'keyword' ELSE 'kg' END, ',' ORDER BY ord) AS channels,
        min(ord * 1000 + r) AS first_seen FROM (
          SELECT query_id, id, 1 AS ord, rank AS r, score AS s FROM kg_keyword_hits
          UNION ALL SELECT query_id, id, 2, min(fact_rank), arg_min(fact_score, (fact_rank, -fact_score)) FROM expanded GROUP BY query_id, id)
      GROUP BY query_id, id) v) WHERE rank <= {LIMIT}""",
)
def kg_fusion(t: Tables) -> DataFrame:
    """Keyword hits and the rows behind the fact hits as one ranking; each row keeps all facts that lead to it."""
    from loreframe.plans.search import live as live_rows

    keyword = rt.keyword_topk(kg_terms(t), live_rows(t), LIMIT)
    both = rt.fuse(
        [rt.channel(keyword, "keyword", 1), rt.fact_channel(expanded(t), 2)], LIMIT, keep_first_seen=True, keep_matches=True
    )
    first = F.col("first_seen.ord") * 1000 + F.col("first_seen.r")
    shown = F.transform(
        "kg_matches", lambda m: F.concat_ws(" ", *[m[c] for c in rt.FACT[:-1]], F.round(m["fact_score"] * 100).cast("long"))
    )
    return both.select(
        "query_id", "id", "fused_score", "keyword_score", "kg_score", "channels", first.alias("first_seen"), "rank",
        F.array_join(shown, ",").alias("kg_matches"),
    )


_SUBGRAPH = """WITH u AS (SELECT id FROM kg_entities WHERE status = 'usable'),
  e AS (SELECT r.* FROM kg_relations r JOIN u h ON h.id = r.head_entity_id JOIN u t ON t.id = r.tail_entity_id WHERE r.status = 'usable'),
  s AS (SELECT head_entity_id AS a, tail_entity_id AS b, id FROM e UNION ALL SELECT tail_entity_id, head_entity_id, id FROM e),
  c AS (SELECT id AS center_id FROM kg_entities WHERE status = 'usable' AND entity_type <> 'feature_ui_action'),
  d AS (SELECT center_id, center_id AS a FROM c UNION SELECT c.center_id, s.b FROM c JOIN s ON s.a = c.center_id),
  g AS (SELECT DISTINCT d.center_id, s.id FROM d JOIN s ON s.a = d.a),
  l AS (SELECT * FROM (SELECT g.center_id, e.*, row_number() OVER (PARTITION BY g.center_id ORDER BY e.updated_at DESC, e.id) AS rn
    FROM g JOIN e ON e.id = g.id) WHERE rn <= 200),
  n AS (SELECT relation_id, count(DISTINCT id) AS k FROM live_ev GROUP BY relation_id)
  SELECT c.center_id, l.id AS relation_id, l.relation_type, l.head_entity_id, l.tail_entity_id,
    CASE WHEN l.id IS NOT NULL THEN coalesce(n.k, 0) END AS evidence_count
  FROM c LEFT JOIN l ON l.center_id = c.center_id LEFT JOIN n ON n.relation_id = l.id"""


@query("kg_subgraph", _SUBGRAPH)
def kg_subgraph(t: Tables) -> DataFrame:
    centers = t.kg_entities.filter("entity_type <> 'feature_ui_action'").select("id")
    return kg.subgraph(centers, t.kg_entities, t.kg_relations, live(t), hops=2, limit=200)


# --- construction ---------------------------------------------------------------------------------


@query(
    "evidence_offsets",
    "SELECT job_id, chunk_order, excerpt, char_start, char_end FROM map_entities",
)
def evidence_offsets(t: Tables) -> DataFrame:
    return t.map_entities.select("job_id", "chunk_order", "excerpt", "char_start", "char_end")


@query(
    "kg_faq_source",
    f"""SELECT id, concat_ws(chr(10), '问题：' || question, '答案：' || answer, '分类：' || category,
    '标签：' || nullif(array_to_string(list_filter(list_transform(tags, lambda x: {strip('x')}), lambda x: x <> ''), '，'), '')) AS source_text FROM faq_documents""",
)
def kg_faq_source(t: Tables) -> DataFrame:
    return t.faq_documents.select("id", faq_source().alias("source_text"))


def faq_source():
    return F.concat_ws(
        "\n", F.concat(F.lit("问题："), "question"), F.concat(F.lit("答案："), "answer"),
        tx.labelled("分类：", F.col("category")), tx.labelled("标签：", F.array_join(tx.clean_items("tags"), "，")),
    )


GUARD = "sha256(concat_ws('|', 'document', file_id, id, file_id || '.md', array_to_string(section_path, ','), coalesce(CAST(page_start AS VARCHAR), ''), coalesce(CAST(page_end AS VARCHAR), ''), source_text))"


def guard():
    p = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("page_start", "page_end")]
    return F.sha2(
        F.concat_ws(
            "|", F.lit("document"), "file_id", "id", F.concat("file_id", F.lit(".md")), F.array_join("section_path", ","),
            *p, "source_text",
        ),
        256,
    )


@query(
    "kg_source_guard",
    f"SELECT 'document' AS source_type, file_id AS source_id, id AS source_chunk_id, file_id || '.md' AS source_title, {GUARD} AS fingerprint FROM import_chunks",
)
def kg_source_guard(t: Tables) -> DataFrame:
    return t.import_chunks.select(
        F.lit("document").alias("source_type"), F.col("file_id").alias("source_id"), F.col("id").alias("source_chunk_id"),
        F.concat("file_id", F.lit(".md")).alias("source_title"), guard().alias("fingerprint"),
    )


register(
    "manifest",
    """SELECT c.file_id, c.id AS chunk_id, row_number() OVER (PARTITION BY c.file_id ORDER BY c.chunk_index, c.id) - 1 AS item_order,
      sha256(c.source_text) AS item_fingerprint, c.section_path FROM import_chunks c JOIN import_files f ON f.id = c.file_id
    WHERE NOT c.is_disabled AND NOT f.is_disabled""",
)


def manifest(t: Tables) -> DataFrame:
    """Enabled chunks of enabled files in dense order; order buckets keep a big file spread out."""
    rows = t.import_chunks.filter(~F.col("is_disabled")).join(
        gates.enabled_files(t.import_files), F.col("file_id") == F.col("__file"), "left_semi"
    )
    placed = dense_position(
        rows.select("file_id", F.col("id").alias("chunk_id"), "chunk_index", F.sha2("source_text", 256).alias("item_fingerprint"), "section_path"),
        ["file_id"], F.floor(F.col("chunk_index") / 65536), [F.col("chunk_index"), F.col("chunk_id")], "item_order",
    )
    return placed.withColumn("item_order", F.col("item_order") - 1)


@query(
    "kg_manifest",
    """SELECT m.file_id, m.chunk_id, m.item_order, m.item_fingerprint, sha256(x.s) AS file_fingerprint FROM manifest m JOIN (
      SELECT file_id, count(*) || ':' || CAST(sum(CAST('0x' || substr(sha256(item_order || '|' || chunk_id || '|' || item_fingerprint), 1, 12) AS BIGINT)) AS VARCHAR) AS s
      FROM manifest GROUP BY file_id) x USING (file_id)""",
)
def kg_manifest(t: Tables) -> DataFrame:
    """Items plus a file fingerprint that is a combinable sum of positional item hashes."""
    items = manifest(t)
    h = F.sha2(F.concat_ws("|", F.col("item_order").cast("string"), "chunk_id", "item_fingerprint"), 256)
    part = F.conv(F.substring(h, 1, 12), 16, 10).cast("decimal(20,0)")
    per_file = items.groupBy("file_id").agg(
        F.sha2(
            F.concat(F.count(F.lit(1)).cast("string"), F.lit(":"), F.sum(part).cast("string")), 256
        ).alias("file_fingerprint")
    )
    return items.join(per_file, "file_id").select("file_id", "chunk_id", "item_order", "item_fingerprint", "file_fingerprint")


@query(
    "manifest_diff",
    """SELECT coalesce(m.file_id, s.file_id) AS file_id, coalesce(m.chunk_id, s.chunk_id) AS chunk_id,
    CASE WHEN s.chunk_id IS NULL THEN 'missing_item' WHEN m.chunk_id IS NULL THEN 'stale_item'
      WHEN m.item_fingerprint <> s.source_fingerprint THEN 'text_changed' WHEN m.section_path <> s.section_path THEN 'locator_changed' END AS mismatch
    FROM manifest m FULL JOIN kg_job_items s ON s.file_id = m.file_id AND s.chunk_id = m.chunk_id
    WHERE s.chunk_id IS NULL OR m.chunk_id IS NULL OR m.item_fingerprint <> s.source_fingerprint OR m.section_path <> s.section_path""",
)
def manifest_diff(t: Tables) -> DataFrame:
    rows = t.import_chunks.filter(~F.col("is_disabled")).join(
        gates.enabled_files(t.import_files), F.col("file_id") == F.col("__file"), "left_semi"
    ).select("file_id", F.col("id").alias("chunk_id"), F.sha2("source_text", 256).alias("h"), F.col("section_path").alias("path"))
    stored = t.kg_job_items.select("file_id", "chunk_id", "source_fingerprint", "section_path")
    mismatch = (
        F.when(F.col("source_fingerprint").isNull(), "missing_item")
        .when(F.col("h").isNull(), "stale_item")
        .when(F.col("h") != F.col("source_fingerprint"), "text_changed")
        .when(F.col("path") != F.col("section_path"), "locator_changed")
    )
    return (
        rows.join(stored, ["file_id", "chunk_id"], "full")
        .select("file_id", "chunk_id", mismatch.alias("mismatch"))
        .filter("mismatch is not null")
    )


@query(
    "kg_items_valid",
    """SELECT i.job_id, i.chunk_id, i.chunk_order, CASE WHEN c.id IS NULL THEN 'source_missing' WHEN c.is_disabled OR f.is_disabled THEN 'source_disabled'
      WHEN sha256(c.source_text) <> i.source_fingerprint THEN 'text_changed' WHEN c.section_path <> i.section_path THEN 'locator_changed' END AS problem,
      j.ready FROM kg_job_items i LEFT JOIN import_chunks c ON c.id = i.chunk_id AND c.file_id = i.file_id
    LEFT JOIN import_files f ON f.id = i.file_id JOIN (SELECT job_id, bool_and(status = 'mapped') AS ready FROM kg_job_items GROUP BY job_id) j USING (job_id)""",
)
def kg_items_valid(t: Tables) -> DataFrame:
    chunks = t.import_chunks.select(
        F.col("id").alias("chunk_id"), "file_id", F.sha2("source_text", 256).alias("h"),
        F.col("section_path").alias("path"), F.col("is_disabled").alias("off"),
    )
    files = t.import_files.select(F.col("id").alias("file_id"), F.col("is_disabled").alias("file_off"))
    jobs = t.kg_job_items.groupBy("job_id").agg(F.bool_and(F.col("status") == "mapped").alias("ready"))
    problem = (
        F.when(F.col("h").isNull(), "source_missing")
        .when(F.col("off") | F.col("file_off"), "source_disabled")
        .when(F.col("h") != F.col("source_fingerprint"), "text_changed")
        .when(F.col("path") != F.col("section_path"), "locator_changed")
    )
    return (
        t.kg_job_items.join(chunks, ["chunk_id", "file_id"], "left").join(files, "file_id", "left").join(jobs, "job_id")
        .select("job_id", "chunk_id", "chunk_order", problem.alias("problem"), "ready")
    )


@query(
    "kg_job_phase",
    """SELECT job_id, count(*) AS total, count(*) FILTER (status = 'mapped') AS mapped,
    CASE WHEN count(*) FILTER (status = 'mapped') = count(*) THEN 'resolving' ELSE 'mapping' END AS phase FROM kg_job_items GROUP BY job_id""",
)
def kg_job_phase(t: Tables) -> DataFrame:
    done = F.count_if(F.col("status") == "mapped")
    return t.kg_job_items.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"), done.alias("mapped"),
        F.when(done == F.count(F.lit(1)), "resolving").otherwise("mapping").alias("phase"),
    )


@query(
    "kg_extraction_plan",
    """WITH act AS (SELECT DISTINCT source_id FROM (SELECT source_id, arg_max(status, (created_at, id)) AS s FROM kg_jobs GROUP BY source_id) WHERE s IN ('queued', 'processing'))
    SELECT 'document' AS source_type, file_id AS source_id, chunk_id, item_order FROM manifest WHERE file_id NOT IN (SELECT source_id FROM act)
    UNION ALL SELECT 'faq', id, NULL, 0 FROM faq_documents WHERE status = 'usable'""",
)
def kg_extraction_plan(t: Tables) -> DataFrame:
    active = (
        lc.latest(t.kg_jobs, ["source_id"]).filter(F.col("status").isin("queued", "processing"))
        .select(F.col("source_id").alias("file_id"))
    )
    documents = manifest(t).join(active, "file_id", "left_anti").select(
        F.lit("document").alias("source_type"), F.col("file_id").alias("source_id"), "chunk_id", "item_order"
    )
    faqs = t.faq_documents.filter((F.col("status") == "usable") & ~tx.blank(faq_source())).select(
        F.lit("faq").alias("source_type"), F.col("id").alias("source_id"), F.lit(None).cast("string").alias("chunk_id"),
        F.lit(0).cast("long").alias("item_order"),
    )
    return documents.unionByName(faqs)


# Lines of the request texts.
EXTRACT_LINE = "请从以下来源文本抽取知识图谱候选。"
RESOLVE_LINES = [
    "请只把代表同一现实对象、且 entity_type 完全相同的 local_entity_id 分组。",
    "未列出的 ID 保持独立；每个 group 至少两个 ID。",
    "候选实体：",
]


@query(
    "kg_prompts",
    f"""SELECT id, concat_ws(chr(10), '{EXTRACT_LINE}', '来源标题：' || file_id || '.md', '章节：' || nullif(array_to_string(section_path, ' > '), ''),
      CASE WHEN page_start IS NOT NULL OR page_end IS NOT NULL THEN
        rtrim('页码：' || coalesce(CAST(page_start AS VARCHAR), '') || '-' || coalesce(CAST(page_end AS VARCHAR), ''), '-') END,
      '', '来源文本：', source_text) AS prompt FROM import_chunks WHERE NOT is_disabled""",
)
def kg_prompts(t: Tables) -> DataFrame:
    """Extraction request text per enabled chunk."""
    chunks = t.import_chunks.filter(~F.col("is_disabled")).withColumn("title", F.concat("file_id", F.lit(".md")))
    return chunks.select("id", kg.extraction_request(EXTRACT_LINE).alias("prompt"))


register(
    "local_entities",
    f"""SELECT *, 'local_' || substr(sha256(job_id || '|' || chunk_order || '|' || canonical_id), 1, 16) AS local_id, lower({compact('name')}) AS name_key FROM (
      SELECT *, {_sql_entity_id('name', 'entity_type')} AS canonical_id FROM map_entities)""",
)
register(
    "local_relations",
    f"""SELECT m.*, h.local_id AS head_id, t.local_id AS tail_id FROM map_relations m
    LEFT JOIN local_entities h ON h.job_id = m.job_id AND h.chunk_order = m.chunk_order AND h.canonical_id = {_sql_entity_id('m.head_name', 'm.head_type')}
    LEFT JOIN local_entities t ON t.job_id = m.job_id AND t.chunk_order = m.chunk_order AND t.canonical_id = {_sql_entity_id('m.tail_name', 'm.tail_type')}""",
)
register(
    "pre_entities",
    """SELECT job_id, name_key, entity_type, arg_min(local_id, (chunk_order, char_start, local_id)) AS entity_id,
      arg_min(name, (chunk_order, char_start, local_id)) AS name, min(chunk_order) AS first_chunk,
      arg_min(char_start, (chunk_order, char_start, local_id)) AS first_offset, count(*) AS support, max(confidence) AS confidence
    FROM local_entities GROUP BY job_id, name_key, entity_type""",
)
register(
    "pre_relations",
    """SELECT r.job_id, a.entity_id AS head_entity_id, r.relation_type, b.entity_id AS tail_entity_id, count(*) AS support,
      min(r.chunk_order) AS first_chunk, max(r.confidence) AS confidence FROM local_relations r
    JOIN pre_entities a ON a.job_id = r.job_id AND a.name_key = lower(r.head_name) AND a.entity_type = r.head_type
    JOIN pre_entities b ON b.job_id = r.job_id AND b.name_key = lower(r.tail_name) AND b.entity_type = r.tail_type GROUP BY ALL""",
)
register(
    "res_groups",
    """SELECT job_id, entity_type || ':' || substr(name_key, 1, 4) AS group_id, CASE WHEN length(name_key) % 11 = 0 THEN 'unknown_' || entity_id ELSE entity_id END AS member_id
      FROM pre_entities WHERE length(name_key) >= 4
    UNION ALL SELECT job_id, 'x:' || substr(name_key, 1, 6), entity_id FROM pre_entities WHERE length(name_key) = 10""",
)
register(
    "res_checked",
    """SELECT g.job_id, g.group_id, CASE WHEN count(*) FILTER (p.entity_type IS NULL) > 0 THEN 'unknown_id' WHEN count(*) < 2 THEN 'too_few_members'
      WHEN min(p.entity_type) <> max(p.entity_type) THEN 'mixed_types' WHEN max(u.uses) > 1 THEN 'repeated_id' END AS reason
    FROM res_groups g LEFT JOIN pre_entities p ON p.job_id = g.job_id AND p.entity_id = g.member_id
    JOIN (SELECT job_id, member_id, count(*) AS uses FROM res_groups GROUP BY ALL) u ON u.job_id = g.job_id AND u.member_id = g.member_id
    GROUP BY g.job_id, g.group_id""",
)
register(
    "ent_classes",
    """SELECT p.*, coalesce(v.class_id, p.entity_id) AS class_id FROM pre_entities p LEFT JOIN (
      SELECT g.job_id, g.member_id, min(g.member_id) OVER (PARTITION BY g.job_id, g.group_id) AS class_id FROM res_groups g
      JOIN res_checked c ON c.job_id = g.job_id AND c.group_id = g.group_id AND c.reason IS NULL) v
    ON v.job_id = p.job_id AND v.member_id = p.entity_id""",
)


def local(t: Tables) -> DataFrame:
    return kg.localise_entities(t.map_entities)


def pre(t: Tables) -> DataFrame:
    return kg.premerge_entities(local(t))


def local_and_pre(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Local entities, cut to what the merges read, and their representatives, each written once."""
    mentions = written(
        local(t).select(
            "job_id", "chunk_order", "name", "entity_type", "canonical_id", "local_id", "char_start", "confidence"
        ),
        "local",
    )
    return mentions, written(kg.premerge_entities(mentions), "premerged")


def pre_rel(t: Tables, mentions: DataFrame, p: DataFrame) -> DataFrame:
    return kg.premerge_relations(kg.localise_relations(t.map_relations, mentions), mentions, p)


def res_groups(p: DataFrame) -> DataFrame:
    """Resolution answers: same type and same four first letters; some of them broken."""
    n = F.length("name_key")
    by_prefix = p.filter(n >= 4).select(
        "job_id", F.concat("entity_type", F.lit(":"), F.substring("name_key", 1, 4)).alias("group_id"),
        F.when(n % 11 == 0, F.concat(F.lit("unknown_"), "entity_id")).otherwise(F.col("entity_id")).alias("member_id"),
    )
    repeated = p.filter(n == 10).select(
        "job_id", F.concat(F.lit("x:"), F.substring("name_key", 1, 6)).alias("group_id"), F.col("entity_id").alias("member_id")
    )
    return by_prefix.unionByName(repeated)


def classes(p: DataFrame) -> DataFrame:
    g = res_groups(p)
    return kg.entity_classes(g, kg.check_resolution(g, p), p)


@query(
    "kg_localise",
    "SELECT job_id, chunk_order, relation_type, head_id, tail_id, head_id IS NULL OR tail_id IS NULL AS orphan FROM local_relations",
)
def kg_localise(t: Tables) -> DataFrame:
    return kg.localise_relations(t.map_relations, t.map_entities).select(
        "job_id", "chunk_order", "relation_type", "head_id", "tail_id", "orphan"
    )


@query(
    "kg_resolution_prompts",
    f"""SELECT job_id, chunk_order, '{chr(10).join(RESOLVE_LINES)}' || chr(10) || CAST(to_json(list({{'aliases': aliases, 'description': description,
      'entity_type': entity_type, 'local_entity_id': local_id, 'name': name}} ORDER BY local_id)) AS VARCHAR) AS prompt
    FROM local_entities GROUP BY job_id, chunk_order""",
)
def kg_resolution_prompts(t: Tables) -> DataFrame:
    """Resolution request per document: five fields of each of its entities."""
    return kg.resolution_requests(kg.localise_entities(t.map_entities), RESOLVE_LINES)


@query("kg_premerge_entities", "SELECT job_id, name_key, entity_type, entity_id, name, first_chunk, first_offset, support, confidence FROM pre_entities")
def kg_premerge_entities(t: Tables) -> DataFrame:
    return pre(t)


@query("kg_premerge_relations", "SELECT * FROM pre_relations")
def kg_premerge_relations(t: Tables) -> DataFrame:
    return pre_rel(t, *local_and_pre(t))


@query("kg_resolution_check", "SELECT job_id, group_id, reason FROM res_checked")
def kg_resolution_check(t: Tables) -> DataFrame:
    p = written(pre(t), "premerged")
    return kg.check_resolution(res_groups(p), p)


@query(
    "kg_reduce_entities",
    """SELECT job_id, class_id, arg_min(name, (first_chunk, first_offset, entity_id)) AS name, arg_min(entity_type, (first_chunk, first_offset, entity_id)) AS entity_type,
    CAST(sum(support) AS BIGINT) AS support, max(confidence) AS confidence, count(*) AS members FROM ent_classes GROUP BY job_id, class_id""",
)
def kg_reduce_entities(t: Tables) -> DataFrame:
    return kg.reduce_entities(classes(written(pre(t), "premerged")))


@query(
    "kg_reduce_relations",
    """SELECT r.job_id, a.class_id AS head_class, r.relation_type, b.class_id AS tail_class, CAST(sum(r.support) AS BIGINT) AS support, max(r.confidence) AS confidence
    FROM pre_relations r JOIN ent_classes a ON a.job_id = r.job_id AND a.entity_id = r.head_entity_id
    JOIN ent_classes b ON b.job_id = r.job_id AND b.entity_id = r.tail_entity_id GROUP BY ALL""",
)
def kg_reduce_relations(t: Tables) -> DataFrame:
    mentions, p = local_and_pre(t)
    return kg.reduce_relations(pre_rel(t, mentions, p), classes(p))


@query(
    "kg_merge_rules",
    """WITH c AS (SELECT job_id, name_key, entity_type, arg_min(name, (chunk_order, char_start, local_id)) AS canonical,
        arg_min(description, (-confidence, -length(description), description)) AS description, max(confidence) AS confidence,
        count(DISTINCT (chunk_order, char_start, char_end, excerpt)) AS evidence FROM local_entities GROUP BY ALL),
    a AS (SELECT job_id, name_key, entity_type, alias, min((chunk_order, char_start, local_id, p)) AS o FROM (
        SELECT job_id, name_key, entity_type, chunk_order, char_start, local_id, unnest(aliases) AS alias, unnest([0, 1]) AS p FROM local_entities) GROUP BY ALL)
    SELECT c.job_id, c.name_key, c.entity_type, c.canonical, c.description, c.confidence, c.evidence,
      (SELECT string_agg(a.alias, '|' ORDER BY a.o) FROM a WHERE a.job_id = c.job_id AND a.name_key = c.name_key AND a.entity_type = c.entity_type
        AND a.alias <> c.canonical) AS aliases FROM c""",
)
def kg_merge_rules(t: Tables) -> DataFrame:
    return kg.merge_fields(local(t))


@query(
    "kg_evidence_check",
    """SELECT e.job_id, e.chunk_order, e.name, CASE WHEN c.id IS NULL THEN 'source_missing' WHEN substr(CASE WHEN c.chunk_index % 7 = 0 THEN 'x ' ELSE '' END || c.source_text,
      e.char_start + 1, e.char_end - e.char_start) <> e.excerpt THEN 'excerpt_moved' END AS reject
    FROM map_entities e LEFT JOIN import_chunks c ON c.id = 'chunk_' || e.chunk_order AND 'kgjob_' || c.file_id = e.job_id AND NOT c.is_disabled""",
)
def kg_evidence_check(t: Tables) -> DataFrame:
    """Evidence against the current text: same place, same excerpt."""
    current = t.import_chunks.filter(~F.col("is_disabled")).select(
        F.col("chunk_index").alias("chunk_order"), F.concat(F.lit("kgjob_"), "file_id").alias("job_id"),
        F.concat(F.when(F.col("chunk_index") % 7 == 0, "x ").otherwise(""), "source_text").alias("now_text"),
    )
    at = F.substring(F.col("now_text"), (F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int"))
    reject = F.when(F.col("now_text").isNull(), "source_missing").when(at != F.col("excerpt"), "excerpt_moved")
    return t.map_entities.join(current, ["job_id", "chunk_order"], "left").select(
        "job_id", "chunk_order", "name", reject.alias("reject")
    )
