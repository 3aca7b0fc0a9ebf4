"""Evidence-backed graph: validity, neighbourhoods, fact search expansion, construction steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loreframe.functions import text as tx
from loreframe.scale import latest_per_key, split_hot
from loreframe.session import written


def owner_id() -> Column:
    return F.coalesce("entity_id", "relation_id")


def evidence_counts(live: DataFrame, owner: str) -> DataFrame:
    """Distinct live evidence per owner (``entity_id`` or ``relation_id``)."""
    return (
        live.filter(F.col(owner).isNotNull())
        .select(F.col(owner).alias("id"), F.col("id").alias("evidence_id"))
        .distinct()
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("evidence_count"))
    )


def with_count(owners: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    return owners.join(counts, "id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def entity_source_counts(entities: DataFrame, live: DataFrame) -> DataFrame:
    """Distinct live sources per entity; entities without any keep zero."""
    sources = (
        live.filter(F.col("entity_id").isNotNull())
        .select(
            F.col("entity_id").alias("id"), "source_type", "source_id",
            F.coalesce("source_chunk_id", F.lit("")).alias("chunk"),
        )
        .distinct()
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("source_count"))
    )
    return with_count(entities, sources, "source_count")


def affected_owners(evidence: DataFrame, relations: DataFrame, sources: DataFrame) -> DataFrame:
    """(kind, id) touched by a change of ``sources`` (source_type, source_id)."""
    touched = evidence.join(sources.distinct(), ["source_type", "source_id"], "left_semi")
    entities = touched.filter("entity_id is not null").select(F.col("entity_id").alias("id")).distinct()
    direct = touched.filter("relation_id is not null").select(F.col("relation_id").alias("id"))
    ends = relations.select("id", F.col("head_entity_id").alias("e")).unionByName(
        relations.select("id", F.col("tail_entity_id").alias("e"))
    )
    incident = ends.join(entities.select(F.col("id").alias("e")), "e", "left_semi").select("id")
    return entities.select(F.lit("entity").alias("kind"), "id").unionByName(
        direct.unionByName(incident).distinct().select(F.lit("relation").alias("kind"), "id")
    )


def reconcile(owners: DataFrame, affected: DataFrame, count: str) -> DataFrame:
    """State of affected owners from their live count; no live source disables."""
    return owners.join(affected.select("id"), "id", "left_semi").select(
        "id",
        F.col(count).alias("live_count"),
        F.when(F.col(count) == 0, "disabled").otherwise("needs_review").alias("status"),
        (F.col("review_revision") + 1).alias("review_revision"),
    )


def fact_rows(entities: DataFrame, relations: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Entities and relations as searchable rows. ``excerpts``: (id, evidence_text)."""
    e = entities.join(excerpts, "id", "left")
    aliases = tx.clean_items("aliases")
    evidence_text = F.coalesce("evidence_text", F.lit(""))
    entity_content = F.concat_ws(
        "\n",
        F.concat(F.lit("实体："), "name"),
        F.concat(F.lit("类型："), "entity_type"),
        tx.labelled("别名：", F.array_join(aliases, "，")),
        tx.labelled("描述：", F.col("description")),
    )
    as_entities = e.select(
        F.concat(F.lit("kc_kg_entity_"), "id").alias("id"),
        F.lit("kg_entity").alias("source_type"),
        F.col("id").alias("source_id"),
        F.col("name").alias("source_title"),
        entity_content.alias("content"),
        tx.join_parts(
            tx.one(F.col("name")), aliases, tx.one(F.col("entity_type")), tx.one(F.col("description")),
            tx.one(evidence_text),
        ).alias("search_text"),
        F.concat(F.array("entity_type"), aliases).alias("tags"),
        "status",
        "updated_at",
    )
    names = entities.select("id", "name", "entity_type")
    head = names.toDF("head_entity_id", "head_name", "head_type")
    tail = names.toDF("tail_entity_id", "tail_name", "tail_type")
    r = (
        relations.join(head, "head_entity_id").join(tail, "tail_entity_id").join(excerpts, "id", "left")
    )
    relation_content = F.concat_ws(
        "\n",
        F.concat(F.lit("关系："), "relation_type"),
        F.concat(F.lit("头实体："), "head_name"),
        F.concat(F.lit("尾实体："), "tail_name"),
        tx.labelled("描述：", F.col("description")),
    )
    as_relations = r.select(
        F.concat(F.lit("kc_kg_relation_"), "id").alias("id"),
        F.lit("kg_relation").alias("source_type"),
        F.col("id").alias("source_id"),
        F.concat_ws(" ", "head_name", "relation_type", "tail_name").alias("source_title"),
        relation_content.alias("content"),
        tx.join_parts(
            tx.one(F.col("head_name")), tx.one(F.col("tail_name")), tx.one(F.col("relation_type")),
            tx.one(F.col("description")), tx.one(evidence_text),
        ).alias("search_text"),
        F.array("relation_type", "head_type", "tail_type").alias("tags"),
        "status",
        "updated_at",
    )
    return as_entities.unionByName(as_relations)


def evidence_excerpts(live: DataFrame) -> DataFrame:
    """Distinct excerpts per owner in order of first appearance, as one text.

    The rows are moved to their owners once, except those of hot owners, which are made distinct first.
    """
    owned = live.select(owner_id().alias("id"), "excerpt", F.struct("created_at", F.col("id").alias("ev")).alias("o"))
    plain, hot = split_hot(owned, ["id"])
    texts = _excerpt_texts(plain.repartition("id"))
    return texts if hot is None else texts.unionByName(_excerpt_texts(hot))


def _excerpt_texts(owned: DataFrame) -> DataFrame:
    first = owned.groupBy("id", "excerpt").agg(F.min("o").alias("o"))
    rows = F.sort_array(F.collect_list(F.struct("o", "excerpt")))
    return first.groupBy("id").agg(
        F.array_join(F.transform(rows, lambda x: x["excerpt"]), "\n").alias("evidence_text")
    )


def expand_facts(
    hits: DataFrame,
    entities: DataFrame,
    relations: DataFrame,
    evidence: DataFrame,
    originals: DataFrame,
    files: DataFrame,
    chunks: DataFrame,
    faqs: DataFrame,
) -> DataFrame:
    """Fact hits to the original rows their live evidence points at, one row for each fact that leads to a row.

    ``hits``: query_id, id (fact row), source_type, source_id, rank, score. Fact hits are few (top-k
    per query), so they are reduced to usable owners first and evidence is semi-filtered by them.
    """
    from loreframe.operators.gates import live_documents

    usable = entities.filter("status = 'usable'").select("id")
    fact = hits.select(
        "query_id", F.col("id").alias("fact_chunk_id"), F.col("source_type").alias("fact_type"),
        F.col("source_id").alias("fact_id"), F.col("rank").alias("fact_rank"), F.col("score").alias("fact_score"),
    )
    entity_facts = fact.filter("fact_type = 'kg_entity'").join(
        usable.withColumnRenamed("id", "fact_id"), "fact_id", "left_semi"
    )
    good_relations = (
        relations.filter("status = 'usable'")
        .select(F.col("id").alias("fact_id"), "head_entity_id", "tail_entity_id")
        .join(usable.withColumnRenamed("id", "head_entity_id"), "head_entity_id", "left_semi")
        .join(usable.withColumnRenamed("id", "tail_entity_id"), "tail_entity_id", "left_semi")
    )
    relation_facts = fact.filter("fact_type = 'kg_relation'").join(good_relations, "fact_id", "left_semi")
    cols = ["source_type", "source_id", "source_chunk_id"]
    link = entity_facts.join(
        evidence.filter("entity_id is not null").select(F.col("entity_id").alias("fact_id"), *cols), "fact_id"
    ).unionByName(
        relation_facts.join(
            evidence.filter("relation_id is not null").select(F.col("relation_id").alias("fact_id"), *cols),
            "fact_id",
        )
    ).distinct()
    ready = originals.filter("status = 'usable' and embedding_status = 'ready'")
    good_faqs = faqs.filter("status = 'usable' and embedding_status = 'ready'").select(
        F.col("id").alias("source_id")
    )
    from_faq = (
        link.filter("source_type = 'faq' and source_chunk_id is null")
        .join(good_faqs, "source_id", "left_semi")
        .join(
            ready.filter("source_type = 'faq' and source_chunk_id is null and chunk_level = 'chunk'").select("source_id", "id"),
            "source_id",
        )
    )
    live = live_documents(
        ready.filter("source_type = 'document' and chunk_level = 'child'"), files, chunks
    ).select("source_id", "source_chunk_id", "id")
    from_document = link.filter("source_type = 'document'").join(live, ["source_id", "source_chunk_id"])
    keep = ["query_id", "id", "fact_chunk_id", "fact_id", "fact_type", "fact_rank", "fact_score"]
    return from_faq.select(*keep).unionByName(from_document.select(*keep)).distinct()


FIRST_PASS = 16  # ends of edges taken in the first pass for each edge wanted; steers cost only


def newest_first() -> list[Column]:
    return [F.desc("updated_at"), F.asc("id")]


def near_edges(reached: DataFrame, own: DataFrame, limit: int) -> DataFrame:
    """(center_id, id, updated_at): edges that may be among a centre's ``limit`` newest, all of those among them.

    ``reached(center_id, entity_id)``; ``own(entity_id, own)`` holds each entity's ``limit`` newest edges in order.
    A first pass takes only so many of the newest edges of each entity as should make ``limit`` different ones, an
    edge being met from both ends. The ``limit``-th of them is a lower bound, and no older edge is joined in the
    second pass. A centre where the first pass finds fewer has no bound and takes all.
    """
    take = F.ceil(F.lit(FIRST_PASS * limit) / F.count(F.lit(1))).cast("int")
    shares = reached.groupBy("center_id").agg(take.alias("take"))
    some = (
        reached.join(shares, "center_id").join(own, "entity_id")
        .select("center_id", F.explode(F.slice("own", F.lit(1), F.col("take"))).alias("e"))
        .select("center_id", "e.updated_at", "e.id")
    )
    last = some.withColumn("rn", F.dense_rank().over(W.partitionBy("center_id").orderBy(*newest_first()))).filter(F.col("rn") <= limit)
    bound = last.filter(F.col("rn") == limit).select(
        "center_id", F.struct("updated_at", "id").alias("bound")
    ).distinct()

    def not_older(e: Column) -> Column:
        at, b = e["updated_at"], F.col("bound")
        newer = F.coalesce(at > b["updated_at"], at.isNotNull() & b["updated_at"].isNull())
        return b.isNull() | newer | (at.eqNullSafe(b["updated_at"]) & (e["id"] <= b["id"]))

    return (
        reached.join(bound, "center_id", "left").join(own, "entity_id")
        .select("center_id", F.explode(F.filter("own", not_older)).alias("e"))
        .select("center_id", "e.updated_at", "e.id")
    )


def subgraph(
    centers: DataFrame,
    entities: DataFrame,
    relations: DataFrame,
    live: DataFrame,
    hops: int = 1,
    entity_types: list[str] | None = None,
    relation_types: list[str] | None = None,
    limit: int = 80,
) -> DataFrame:
    """Bounded neighbourhood edges of many centres at once; an isolated centre keeps one row."""
    hops, limit = max(1, min(hops, 2)), max(1, min(limit, 200))
    usable = entities.filter("status = 'usable'").select("id", "entity_type")
    edges = relations.filter("status = 'usable'")
    if relation_types:
        edges = edges.filter(F.col("relation_type").isin(relation_types))
    head = usable.toDF("head_entity_id", "head_type")
    tail = usable.toDF("tail_entity_id", "tail_type")
    edges = edges.select("id", "head_entity_id", "tail_entity_id", "relation_type", "updated_at")
    # read for the way, for the edges of each entity and for the result
    edges = written(edges.join(head, "head_entity_id").join(tail, "tail_entity_id"), "edges")
    sides = edges.select(
        F.col("head_entity_id").alias("entity_id"), F.col("tail_entity_id").alias("next_id"),
        "id", "updated_at", "head_type", "tail_type",
    ).unionByName(
        edges.select(
            F.col("tail_entity_id").alias("entity_id"), F.col("head_entity_id").alias("next_id"),
            "id", "updated_at", "head_type", "tail_type",
        )
    )
    center = centers.select(F.col("id").alias("center_id")).join(
        usable.select(F.col("id").alias("center_id")), "center_id", "left_semi"
    )
    reached = center.select("center_id", F.col("center_id").alias("entity_id"))
    for _ in range(hops - 1):
        step = reached.join(sides.select("entity_id", "next_id").distinct(), "entity_id").select(
            "center_id", F.col("next_id").alias("entity_id")
        )
        reached = reached.unionByName(step).distinct()
    shown = sides
    if entity_types:
        shown = shown.filter(F.col("head_type").isin(entity_types) | F.col("tail_type").isin(entity_types))
    # An edge's place does not depend on the centre, so each entity needs only its own best edges,
    # and equal edges reached twice share one dense rank: both limits cut before the shuffle.
    own = (
        shown.withColumn("rn", F.row_number().over(W.partitionBy("entity_id").orderBy(*newest_first())))
        .filter(F.col("rn") <= limit)
        .groupBy("entity_id")
        .agg(F.sort_array(F.collect_list(F.struct("rn", "updated_at", "id"))).alias("own"))
    )
    ranked = near_edges(written(reached, "reached"), written(own, "own-edges"), limit)
    top = (
        ranked.withColumn("rn", F.dense_rank().over(W.partitionBy("center_id").orderBy(*newest_first())))
        .filter(F.col("rn") <= limit)
        .select("center_id", "id")
        .distinct()
    )
    top = written(top, "nearest").join(edges, "id")
    counts = evidence_counts(
        live.join(top.select(F.col("id").alias("relation_id")).distinct(), "relation_id", "left_semi"), "relation_id"
    )
    counted = with_count(top, counts, "evidence_count").withColumnRenamed("id", "relation_id")
    return center.join(
        counted.select(
            "center_id", "relation_id", "relation_type", "head_entity_id", "tail_entity_id", "evidence_count"
        ),
        "center_id",
        "left",
    )


# --- construction ------------------------------------------------------------------------------


def local_entity_id(job: Column, order: Column, canonical: Column) -> Column:
    return F.concat(
        F.lit("local_"),
        F.substring(F.sha2(F.concat_ws("|", job, order.cast("string"), canonical), 256), 1, 16),
    )


def extraction_request(first_line: str) -> Column:
    """Request text of a source with title, section_path, page_start, page_end and source_text."""
    def shown(page):
        return F.coalesce(F.col(page).cast("string"), F.lit(""))

    pages = F.rtrim(F.concat(F.lit("页码："), shown("page_start"), F.lit("-"), shown("page_end")), F.lit("-"))
    return F.concat_ws(
        "\n",
        F.lit(first_line),
        tx.labelled("来源标题：", tx.strip("title")),
        tx.labelled("章节：", F.array_join("section_path", " > ")),
        F.when(F.col("page_start").isNotNull() | F.col("page_end").isNotNull(), pages),
        F.lit(""),
        F.lit("来源文本："),
        F.coalesce("source_text", F.lit("")),
    )


def resolution_requests(entities: DataFrame, lines: list[str]) -> DataFrame:
    """(job_id, chunk_order, prompt): the document's entities by local id, five fields each, as JSON."""
    fields = F.struct("aliases", "description", "entity_type", F.col("local_id").alias("local_entity_id"), "name")
    listed = F.sort_array(F.collect_list(F.struct("local_id", fields.alias("e"))))
    gathered = entities.groupBy("job_id", "chunk_order").agg(F.transform(listed, lambda x: x["e"]).alias("entities"))
    return gathered.select("job_id", "chunk_order", F.concat_ws("\n", *[F.lit(x) for x in lines], F.to_json("entities")).alias("prompt"))


def localise_entities(mapped: DataFrame) -> DataFrame:
    canonical = tx.entity_id(F.col("name"), F.col("entity_type"))
    return mapped.withColumn("canonical_id", canonical).withColumn(
        "local_id", local_entity_id(F.col("job_id"), F.col("chunk_order"), F.col("canonical_id"))
    )


def localise_relations(mapped: DataFrame, entities: DataFrame) -> DataFrame:
    """Rewrite endpoints to the chunk's local ids; ``orphan`` marks relations that lack one.

    ``entities`` are mapped ones, or already localised.
    """
    localised = entities if "local_id" in entities.columns else localise_entities(entities)
    ids = localised.select("job_id", "chunk_order", "canonical_id", "local_id").distinct()
    head = ids.toDF("job_id", "chunk_order", "head_canonical", "head_id")
    tail = ids.toDF("job_id", "chunk_order", "tail_canonical", "tail_id")
    return (
        mapped.withColumn("head_canonical", tx.entity_id(F.col("head_name"), F.col("head_type")))
        .withColumn("tail_canonical", tx.entity_id(F.col("tail_name"), F.col("tail_type")))
        .join(head, ["job_id", "chunk_order", "head_canonical"], "left")
        .join(tail, ["job_id", "chunk_order", "tail_canonical"], "left")
        .withColumn("orphan", F.col("head_id").isNull() | F.col("tail_id").isNull())
    )


def premerge_entities(localised: DataFrame) -> DataFrame:
    """One representative per job, normalised name and type: smallest (chunk, offset, id)."""
    place = F.struct("chunk_order", "char_start", "local_id")
    return localised.groupBy("job_id", tx.name_key(F.col("name")).alias("name_key"), "entity_type").agg(
        F.min_by("local_id", place).alias("entity_id"),
        F.min_by("name", place).alias("name"),
        F.min("chunk_order").alias("first_chunk"),
        F.min_by("char_start", place).alias("first_offset"),
        F.count(F.lit(1)).alias("support"),
        F.max("confidence").alias("confidence"),
    )


def premerge_relations(relations: DataFrame, localised: DataFrame, premerged: DataFrame) -> DataFrame:
    """Relations on representatives, merged by (head, type, tail) within a job."""
    rep = localised.select(
        "job_id", "local_id", tx.name_key(F.col("name")).alias("name_key"), "entity_type"
    ).distinct().join(premerged.select("job_id", "name_key", "entity_type", "entity_id"), [
        "job_id", "name_key", "entity_type"
    ]).select("local_id", "entity_id")
    head, tail = rep.toDF("head_id", "head_entity_id"), rep.toDF("tail_id", "tail_entity_id")
    return (
        relations.filter(~F.col("orphan"))
        .join(head, "head_id")
        .join(tail, "tail_id")
        .groupBy("job_id", "head_entity_id", "relation_type", "tail_entity_id")
        .agg(
            F.count(F.lit(1)).alias("support"),
            F.min("chunk_order").alias("first_chunk"),
            F.max("confidence").alias("confidence"),
        )
    )


def check_resolution(groups: DataFrame, premerged: DataFrame) -> DataFrame:
    """(job_id, group_id, reason): unknown member, too few members, mixed types, repeated id."""
    known = premerged.select("job_id", F.col("entity_id").alias("member_id"), "entity_type")
    member = groups.join(known, ["job_id", "member_id"], "left")
    uses = groups.groupBy("job_id", "member_id").agg(F.count(F.lit(1)).alias("uses"))
    return (
        member.join(uses, ["job_id", "member_id"])
        .groupBy("job_id", "group_id")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.count_if(F.col("entity_type").isNull()).alias("unknown"),
            F.min("entity_type").alias("low"),
            F.max("entity_type").alias("high"),
            F.max("uses").alias("uses"),
        )
        .select(
            "job_id",
            "group_id",
            F.when(F.col("unknown") > 0, "unknown_id")
            .when(F.col("members") < 2, "too_few_members")
            .when(F.col("low") != F.col("high"), "mixed_types")
            .when(F.col("uses") > 1, "repeated_id")
            .alias("reason"),
        )
    )


def entity_classes(groups: DataFrame, checked: DataFrame, premerged: DataFrame) -> DataFrame:
    """Premerged entity -> class: the valid group's first member by id, or itself."""
    valid = groups.join(checked.filter("reason is null"), ["job_id", "group_id"], "left_semi")
    first = valid.groupBy("job_id", "group_id").agg(F.min("member_id").alias("class_id"))
    member = valid.join(first, ["job_id", "group_id"]).select(
        "job_id", F.col("member_id").alias("entity_id"), "class_id"
    )
    return premerged.join(member, ["job_id", "entity_id"], "left").withColumn(
        "class_id", F.coalesce("class_id", "entity_id")
    )


def reduce_entities(classes: DataFrame) -> DataFrame:
    place = F.struct("first_chunk", "first_offset", "entity_id")
    return classes.groupBy("job_id", "class_id").agg(
        F.min_by("name", place).alias("name"),
        F.min_by("entity_type", place).alias("entity_type"),
        F.sum("support").alias("support"),
        F.max("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("members"),
    )


def reduce_relations(relations: DataFrame, classes: DataFrame) -> DataFrame:
    ids = classes.select("job_id", "entity_id", "class_id")
    head = ids.toDF("job_id", "head_entity_id", "head_class")
    tail = ids.toDF("job_id", "tail_entity_id", "tail_class")
    return (
        relations.join(head, ["job_id", "head_entity_id"])
        .join(tail, ["job_id", "tail_entity_id"])
        .groupBy("job_id", "head_class", "relation_type", "tail_class")
        .agg(F.sum("support").alias("support"), F.max("confidence").alias("confidence"))
    )


def merge_fields(localised: DataFrame) -> DataFrame:
    """Merge rules per premerged entity: aliases, description, confidence, evidence count.

    Aliases and evidence are made distinct before they are gathered, so the size of a merged row
    follows the number of different values, not the number of mentions.
    """
    key = ["job_id", "name_key", "entity_type"]
    keyed = localised.withColumn("name_key", tx.name_key(F.col("name")))
    place = F.struct("chunk_order", "char_start", "local_id")
    canonical = keyed.groupBy(*key).agg(F.min_by("name", place).alias("canonical"))
    alias = (
        keyed.select(*key, "chunk_order", "char_start", "local_id", F.posexplode("aliases").alias("p", "alias"))
        .groupBy(*key, "alias")
        .agg(F.min(F.struct("chunk_order", "char_start", "local_id", "p")).alias("o"))
        .join(canonical, key)
        .filter("alias <> canonical")
        .groupBy(*key)
        .agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("o", "alias"))), lambda x: x["alias"]), "|"
            ).alias("aliases")
        )
    )
    best = keyed.groupBy(*key).agg(
        F.min_by(
            "description", F.struct(-F.col("confidence"), -F.length("description"), F.col("description"))
        ).alias("description"),
        F.max("confidence").alias("confidence"),
    )
    evidence = (
        keyed.select(*key, "chunk_order", "char_start", "char_end", "excerpt").distinct()
        .groupBy(*key).agg(F.count(F.lit(1)).alias("evidence"))
    )
    return canonical.join(best, key).join(evidence, key).join(alias, key, "left")
