"""Replacing what came from some sources: a new extraction of the graph, a new parse of files.

Both merge by key over whole tables. Owners whose evidence changed are counted anew from live evidence;
all other rows pass through the same joins untouched.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from loreframe.session import written

ENTITY_FIELDS = ["name", "entity_type", "aliases", "description", "status", "confidence"]
RELATION_KEYS = ["head_entity_id", "relation_type", "tail_entity_id"]
RELATION_FIELDS = ["description", "status", "confidence"]

Live = Callable[[DataFrame], DataFrame]


class Graph(NamedTuple):
    entities: DataFrame
    relations: DataFrame
    evidence: DataFrame


def replace_snapshot(old: Graph, scope: DataFrame, found: Graph, live: Live, at: Column) -> Graph:
    """The graph after ``scope`` was extracted anew with the result ``found``.

    ``scope`` holds source_type and source_id, and source_chunk_id where only some chunks were read. All
    evidence of the scope goes, found evidence comes in unless its id is taken. Found owners overwrite the
    owner of their id (relations keep their ends) or are inserted with revision 1. Owners are touched when
    found, when they had evidence in the scope, and relations also when an end is found or had such evidence.
    Touched owners get ``live_count`` (sources of an entity, evidence of a relation; null elsewhere), are
    disabled without live evidence and back in review with it, and their revision rises by one.

    ``live`` keeps the live rows of an evidence table. Null scope keys match nothing; of found rows with one
    id the smallest is taken; columns of the old tables that found rows lack are null in inserted rows.

    The merged evidence and the ids of touched owners are written once, as each is read several times.
    """
    keys = scope.columns
    scoped = old.evidence.join(scope.distinct(), keys, "left_semi")
    kept = old.evidence.join(scope.distinct(), keys, "left_anti")
    pieces = found.evidence.groupBy("id").agg(F.min(F.struct(*[c for c in found.evidence.columns if c != "id"])).alias("__one"))
    new = pieces.select("id", "__one.*").join(kept.select("id"), "id", "left_anti")
    evidence = kept.unionByName(new, allowMissingColumns=True).select(*old.evidence.columns)
    evidence = written(evidence, "snapshot_evidence")

    had = scoped.select(F.col("entity_id").alias("id")).where("id is not null")
    entity_ids = written(had.union(found.entities.select("id")).distinct(), "touched_entities")
    ends = old.relations.select("id", F.explode(F.array("head_entity_id", "tail_entity_id")).alias("end"))
    incident = ends.join(entity_ids.withColumnRenamed("id", "end"), "end", "left_semi").select("id")
    direct = scoped.select(F.col("relation_id").alias("id")).where("id is not null")
    relation_ids = direct.union(incident).union(found.relations.select("id")).distinct()
    relation_ids = written(relation_ids, "touched_relations")

    source = F.struct("source_type", "source_id", F.coalesce("source_chunk_id", F.lit("")))
    entities = _merged(
        old.entities, found.entities, [], ENTITY_FIELDS, _counted(evidence, "entity_id", entity_ids, live, source), at
    )
    relations = _merged(
        old.relations, found.relations, RELATION_KEYS, RELATION_FIELDS,
        _counted(evidence, "relation_id", relation_ids, live, F.col("evidence_id")), at,
    )
    return Graph(entities, relations, evidence)


def _counted(evidence: DataFrame, owner: str, ids: DataFrame, live: Live, what: Column) -> DataFrame:
    """(id, live_count) of the owners ``ids``; only their evidence passes the gate."""
    theirs = evidence.join(ids.withColumnRenamed("id", owner), owner, "left_semi")
    rows = live(theirs).select(F.col(owner).alias("owner"), "source_type", "source_id", "source_chunk_id", F.col("id").alias("evidence_id"))
    counts = rows.select(F.col("owner").alias("id"), what.alias("one")).distinct().groupBy("id").agg(F.count("one").alias("n"))
    return ids.join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("live_count"))


def _merged(base: DataFrame, found: DataFrame, fixed: list[str], fields: list[str], touched: DataFrame, at: Column) -> DataFrame:
    """Found rows over base rows by id; ``fixed`` columns are taken from found rows for new ids only."""
    newest = found.groupBy("id").agg(F.min(F.struct(*fixed, *fields)).alias("__new"))
    rows = base.withColumn("__old", F.lit(True)).join(newest, "id", "full").join(touched, "id", "left")
    is_found, was_there = F.col("__new").isNotNull(), F.col("__old").isNotNull()
    is_touched = F.col("live_count").isNotNull()
    changed = {c: F.coalesce(c, F.col("__new")[c]) for c in fixed}
    changed |= {c: F.when(is_found, F.col("__new")[c]).otherwise(F.col(c)) for c in fields}
    changed["status"] = (
        F.when(F.col("live_count") == 0, "disabled").when(is_touched, "needs_review").otherwise(F.col("status"))
    )
    raised = F.col("review_revision") + F.when(is_touched, 1).otherwise(0)
    changed["review_revision"] = F.when(was_there, raised).otherwise(F.lit(1).cast("long"))
    changed["updated_at"] = F.when(is_touched, at).otherwise(F.col("updated_at"))
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in base.columns], "live_count")


class Parsed(NamedTuple):
    chunks: DataFrame
    rows: DataFrame
    graph: Graph
    files: DataFrame


def reparse(
    files: DataFrame, chunks: DataFrame, parsed: DataFrame, rows: DataFrame, graph: Graph,
    live: Callable[[DataFrame, DataFrame], DataFrame], at: Column,
) -> Parsed:
    """All tables after the files ``files(id)`` were parsed anew into the chunks ``parsed``.

    Their chunks are replaced as a whole, their knowledge rows and evidence go, and owners touched are counted
    anew; ``live(evidence, chunks)`` is asked with the chunks as they are afterwards. The last table holds the
    new state of the files: in review, with the number of their chunks (none where nothing was parsed). Parsed
    chunks of other files are left out; columns they lack are null.
    """
    ids = files.select("id").where("id is not null").distinct()
    of_files = ids.withColumnRenamed("id", "file_id")
    new = parsed.join(of_files, "file_id", "left_semi")
    after = chunks.join(of_files, "file_id", "left_anti").unionByName(new, allowMissingColumns=True).select(*chunks.columns)
    scope = ids.select(F.lit("document").alias("source_type"), F.col("id").alias("source_id"))
    kept_rows = rows.join(scope, ["source_type", "source_id"], "left_anti").select(*rows.columns)
    nothing = Graph(*[t.limit(0) for t in graph])
    replaced = replace_snapshot(graph, scope, nothing, lambda e: live(e, after), at)
    sizes = new.groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("chunk_count"))
    states = ids.join(sizes, "id", "left").select(
        "id", F.lit("needs_review").alias("status"), F.coalesce("chunk_count", F.lit(0).cast("long")).alias("chunk_count")
    )
    return Parsed(after, kept_rows, replaced, states)
