"""Queries that replace what came from some sources: a new extraction, a new parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loreframe.operators import gates, replacement as rp
from loreframe.plans.bindings_sql import register
from loreframe.plans.registry import query
from loreframe.session import written
from loreframe.sources.tables import Tables, now

# The files whose id ends in 3 are extracted anew. Of their evidence every second piece is found again, its
# relations and their ends with a new text, and every file is an entity of its own.
register("again_old", "SELECT * FROM kg_evidence WHERE source_type = 'document' AND source_id IN (SELECT id FROM import_files WHERE id LIKE '%3')")
register(
    "again_evidence",
    """SELECT id, entity_id, relation_id, source_type, source_id, source_chunk_id FROM kg_evidence
      WHERE id NOT IN (SELECT id FROM again_old)
    UNION ALL SELECT 'new_' || id, NULL, relation_id, source_type, source_id, source_chunk_id FROM again_old WHERE char_start % 2 = 0
    UNION ALL SELECT 'kg_ev_file_' || source_id, 'kg_ent_file_' || source_id, NULL, 'document', source_id, min(source_chunk_id)
      FROM again_old GROUP BY source_id""",
)
_LIVE_SQL = """SELECT e.* FROM {evidence} e WHERE
      EXISTS (SELECT 1 FROM faq_documents q WHERE e.source_type = 'faq' AND q.id = e.source_id AND q.status = 'usable')
      OR EXISTS (SELECT 1 FROM {chunks} c JOIN import_files f ON f.id = c.file_id
        WHERE e.source_type = 'document' AND c.id = e.source_chunk_id AND f.id = e.source_id AND NOT f.is_disabled AND NOT c.is_disabled)"""
register("again_live", _LIVE_SQL.format(evidence="again_evidence", chunks="import_chunks"))
register("again_relations", "SELECT id, head_entity_id, tail_entity_id FROM kg_relations WHERE id IN (SELECT relation_id FROM again_old WHERE char_start % 2 = 0)")
register(
    "again_entities",
    """SELECT head_entity_id AS id FROM again_relations UNION SELECT tail_entity_id FROM again_relations
    UNION SELECT 'kg_ent_file_' || source_id FROM again_old""",
)


def live(t: Tables, evidence: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    return gates.live_evidence(evidence, t.import_files, t.import_chunks if chunks is None else chunks, t.faq_documents)


def snapshot(t: Tables) -> rp.Graph:
    old = rp.Graph(t.kg_entities, t.kg_relations, t.kg_evidence)
    scope = t.import_files.where("id like '%3'").select(F.lit("document").alias("source_type"), F.col("id").alias("source_id"))
    scoped = t.kg_evidence.join(scope, ["source_type", "source_id"], "left_semi")
    none = F.lit(None).cast("string")
    again = scoped.where("char_start % 2 = 0").withColumn("id", F.concat(F.lit("new_"), "id"))
    per_file = scoped.groupBy("source_type", "source_id").agg(F.min("source_chunk_id").alias("source_chunk_id"))
    of_files = per_file.select(
        F.concat(F.lit("kg_ev_file_"), "source_id").alias("id"), F.concat(F.lit("kg_ent_file_"), "source_id").alias("entity_id"),
        none.alias("relation_id"), "source_type", "source_id", "source_chunk_id",
    )
    relations = t.kg_relations.join(again.select(F.col("relation_id").alias("id")), "id", "left_semi")
    relations = relations.withColumns({"description": F.lit("again"), "status": F.lit("needs_review"), "confidence": F.lit(0.25)})
    relations = written(relations, "found_relations")
    ends = relations.select(F.explode(F.array("head_entity_id", "tail_entity_id")).alias("id"))
    review = {"description": F.lit("again"), "status": F.lit("needs_review"), "confidence": F.lit(0.25)}
    known = t.kg_entities.join(ends, "id", "left_semi").withColumns(review).select("id", *rp.ENTITY_FIELDS)
    files = of_files.select(
        F.col("entity_id").alias("id"), F.col("source_id").alias("name"), F.lit("process_task_object").alias("entity_type"),
        F.array().cast("array<string>").alias("aliases"), *[c.alias(n) for n, c in review.items()],
    )
    found = rp.Graph(known.unionByName(files), relations, again.unionByName(of_files, allowMissingColumns=True))
    return rp.replace_snapshot(old, scope, found, lambda e: live(t, e), now())


def owner_rows(graph: rp.Graph) -> DataFrame:
    columns = ["id", "description", "status", "confidence", "review_revision", "live_count"]
    entities = graph.entities.select(F.lit("entity").alias("kind"), "name", *columns)
    relations = graph.relations.select(F.lit("relation").alias("kind"), F.lit(None).cast("string").alias("name"), *columns)
    return entities.unionByName(relations)


_OWNER_SQL = """SELECT '{kind}' AS kind, {name} AS name, coalesce(o.id, n.id) AS id,
      CASE WHEN n.id IS NOT NULL THEN 'again' ELSE o.description END AS description,
      CASE WHEN t.id IS NULL THEN o.status WHEN coalesce(c.n, 0) = 0 THEN 'disabled' ELSE 'needs_review' END AS status,
      CASE WHEN n.id IS NOT NULL THEN 0.25::DOUBLE ELSE CAST(o.confidence AS DOUBLE) END AS confidence,
      CASE WHEN o.id IS NULL THEN 1 ELSE o.review_revision + CASE WHEN t.id IS NULL THEN 0 ELSE 1 END END AS review_revision,
      CASE WHEN t.id IS NOT NULL THEN coalesce(c.n, 0) END AS live_count
    FROM {owners} o FULL JOIN {found} n ON n.id = o.id LEFT JOIN ({touched}) t ON t.id = coalesce(o.id, n.id)
    LEFT JOIN (SELECT {owner} AS id, count(DISTINCT {what}) AS n FROM again_live GROUP BY 1) c ON c.id = t.id"""
_ENTITIES_SQL = _OWNER_SQL.format(
    kind="entity", name="coalesce(o.name, replace(n.id, 'kg_ent_file_', ''))", owners="kg_entities", found="again_entities",
    owner="entity_id", what="(source_type, source_id, coalesce(source_chunk_id, ''))",
    touched="SELECT entity_id AS id FROM again_old WHERE entity_id IS NOT NULL UNION SELECT id FROM again_entities",
)
_RELATIONS_SQL = _OWNER_SQL.format(
    kind="relation", name="CAST(NULL AS VARCHAR)", owners="kg_relations", found="again_relations", owner="relation_id", what="again_live.id",
    touched="""SELECT relation_id AS id FROM again_old WHERE relation_id IS NOT NULL UNION SELECT id FROM again_relations
      UNION SELECT id FROM kg_relations WHERE head_entity_id IN (SELECT id FROM again_entities) OR tail_entity_id IN (SELECT id FROM again_entities)""",
)


@query("kg_snapshot_owners", f"{_ENTITIES_SQL} UNION ALL {_RELATIONS_SQL}")
def kg_snapshot_owners(t: Tables) -> DataFrame:
    """Every entity and relation after the extraction of some files was replaced."""
    return owner_rows(snapshot(t))


@query("kg_snapshot_evidence", "SELECT * FROM again_evidence")
def kg_snapshot_evidence(t: Tables) -> DataFrame:
    """All evidence after the extraction of some files was replaced."""
    return snapshot(t).evidence.select("id", "entity_id", "relation_id", "source_type", "source_id", "source_chunk_id")


# The files whose id ends in 4 are parsed anew: two of three chunks come back, those of odd number under their old id.
register(
    "parsed_again",
    """SELECT CASE WHEN chunk_index % 2 = 1 THEN id ELSE 'new_' || id END AS id, file_id, is_disabled FROM import_chunks
    WHERE file_id LIKE '%4' AND chunk_index % 3 <> 0""",
)
register("chunks_after", "SELECT id, file_id, is_disabled FROM import_chunks WHERE file_id NOT LIKE '%4' UNION ALL SELECT * FROM parsed_again")
register("evidence_after", "SELECT * FROM kg_evidence WHERE NOT (source_type = 'document' AND source_id LIKE '%4' AND source_id IN (SELECT id FROM import_files))")
register("live_after", _LIVE_SQL.format(evidence="evidence_after", chunks="chunks_after"))


def parsed_again(t: Tables) -> rp.Parsed:
    files = t.import_files.where("id like '%4'")
    odd = F.col("chunk_index") % 2 == 1
    chunks = t.import_chunks.where("file_id like '%4' and chunk_index % 3 <> 0")
    chunks = chunks.withColumn("id", F.when(odd, F.col("id")).otherwise(F.concat(F.lit("new_"), "id")))
    graph = rp.Graph(t.kg_entities, t.kg_relations, t.kg_evidence)
    return rp.reparse(files, t.import_chunks, chunks, t.knowledge_chunks, graph, lambda e, c: live(t, e, c), now())


@query(
    "file_reparse_tables",
    """SELECT 'chunk' AS kind, id, file_id AS source_id, NULL AS status, NULL AS n FROM chunks_after
    UNION ALL SELECT 'row', id, source_id, status, NULL FROM knowledge_chunks WHERE NOT (source_type = 'document' AND source_id LIKE '%4')
    UNION ALL SELECT 'evidence', id, source_id, NULL, NULL FROM evidence_after
    UNION ALL SELECT 'file', f.id, f.id, 'needs_review', (SELECT count(*) FROM parsed_again p WHERE p.file_id = f.id)
      FROM import_files f WHERE f.id LIKE '%4'""",
)
def file_reparse_tables(t: Tables) -> DataFrame:
    """Chunks, knowledge rows, evidence and file states after some files were parsed anew."""
    after = parsed_again(t)
    text, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    chunks = after.chunks.select(F.lit("chunk").alias("kind"), "id", F.col("file_id").alias("source_id"), text.alias("status"), number.alias("n"))
    rows = after.rows.select(F.lit("row"), "id", "source_id", "status", number)
    evidence = after.graph.evidence.select(F.lit("evidence"), "id", "source_id", text, number)
    files = after.files.select(F.lit("file"), "id", "id", "status", "chunk_count")
    return chunks.union(rows).union(evidence).union(files)


@query(
    "file_reparse_owners",
    """SELECT r.id, CASE WHEN count(e.id) = 0 THEN 'disabled' ELSE 'needs_review' END AS status, count(e.id) AS live_count,
      any_value(r.review_revision) + 1 AS review_revision
    FROM kg_relations r LEFT JOIN live_after e ON e.relation_id = r.id
    WHERE r.id IN (SELECT relation_id FROM kg_evidence WHERE id NOT IN (SELECT id FROM evidence_after)) GROUP BY r.id""",
)
def file_reparse_owners(t: Tables) -> DataFrame:
    """Owners counted anew after some files were parsed anew."""
    return owner_rows(parsed_again(t).graph).where("live_count is not null").select("id", "status", "live_count", "review_revision")
