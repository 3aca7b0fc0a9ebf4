"""Knowledge rows, embedding state, list views, lifecycle merges and data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loreframe.functions import text as tx
from loreframe.operators import knowledge as kn, lifecycle as lc
from loreframe.plans.bindings_sql import register, strip
from loreframe.plans.registry import query
from loreframe.plans.textual import DOC_TEXT, FAQ_TEXT, FINGERPRINT, ITEMS, PAGES, fingerprint
from loreframe.sources.tables import NOW, Tables, minus_seconds, now

STAMP = "yyyy-MM-dd HH:mm:ss"
SQL_STAMP = "'%Y-%m-%d %H:%M:%S'"

register(
    "child_lists",
    rf"""SELECT * EXCLUDE (pieces), CASE WHEN len(blocks) > 0 THEN list_transform(blocks, lambda b: {strip('b.text')})
      WHEN len(pieces) > 0 THEN pieces ELSE [source_text] END AS kids FROM (
      SELECT *, list_filter(source_blocks, lambda b: {strip('b.text')} <> '') AS blocks,
        CASE children_delimiter
          WHEN '\n' THEN list_filter(string_split(regexp_replace(source_text, '(\n)', '\1' || chr(1), 'g'), chr(1)),
            lambda x: {strip('x')} <> '')
          WHEN '`. `\n' THEN list_filter(string_split(regexp_replace(source_text, '(\n|\. )', '\1' || chr(1), 'g'), chr(1)),
            lambda x: {strip('x')} <> '' AND x <> '. ')
          ELSE [] END AS pieces FROM import_chunks)""",
)
register(
    "doc_rows",
    f"""SELECT CASE WHEN child_no > 0 THEN 'kc_document_' || id || '_child_' || child_no ELSE 'kc_document_' || id END AS id,
      'document' AS source_type, file_id AS source_id, id AS source_chunk_id,
      CASE WHEN child_no > 0 THEN 'kc_document_' || id END AS parent_chunk_id,
      CASE WHEN child_no > 0 THEN 'child' ELSE 'parent' END AS chunk_level, title AS source_title,
      CASE WHEN child_no > 0 THEN -((chunk_index + child_no) * (chunk_index + child_no + 1) // 2 + child_no + 1)
        ELSE chunk_index END AS chunk_index, child_no, chunk_index AS parent_index, body AS content,
      {DOC_TEXT} AS embedding_text,
      array_to_string({ITEMS.format(f"[title, array_to_string(section_path, ' > '), {PAGES}, block_type] || keywords || questions || [body]")}, chr(10)) AS search_text,
      'usable' AS status
      FROM (SELECT id, file_id, title, body, child_no, chunk_index, keywords, questions,
          CASE WHEN len(own_path) > 0 THEN own_path ELSE section_path END AS section_path,
          coalesce(b.page_number, page_start) AS page_start, coalesce(b.page_number, page_end) AS page_end,
          coalesce(b.block_type, block_type) AS block_type
        FROM (SELECT *, list_filter(list_transform(string_split(b.section_title, '>'), lambda x: trim(x)), lambda x: x <> '') AS own_path
          FROM (SELECT *, CASE WHEN child_no > 0 AND len(blocks) > 0 THEN blocks[child_no] END AS b
            FROM (SELECT * EXCLUDE (kids), file_id || '.md' AS title, unnest([source_text] || kids) AS body,
              unnest(range(0, len(kids) + 1)) AS child_no FROM child_lists))))""",
)
# Stored rows: the generated rows with some missing and with mixed embedding states.
register(
    "stored_rows",
    """SELECT *, CASE parent_index % 6 WHEN 1 THEN 'pending' WHEN 2 THEN
      CASE WHEN child_no % 3 = 0 THEN 'stale' ELSE 'ready' END WHEN 3 THEN 'failed' ELSE 'ready' END AS embedding_status
    FROM doc_rows WHERE NOT (parent_index % 6 = 5) AND NOT (parent_index % 6 = 4 AND child_no >= 2)""",
)


def doc_rows(t: Tables) -> DataFrame:
    return kn.document_knowledge_rows(t.import_chunks, t.import_files)


def stored_rows(t: Tables) -> DataFrame:
    n = F.regexp_extract("source_chunk_id", r"(\d+)$", 1).cast("long")
    m = n % 6
    status = (
        F.when(m == 1, "pending")
        .when(m == 2, F.when(F.col("child_no") % 3 == 0, "stale").otherwise("ready"))
        .when(m == 3, "failed")
        .otherwise("ready")
    )
    return (
        doc_rows(t)
        .filter((m != 5) & ~((m == 4) & (F.col("child_no") >= 2)))
        .withColumn("embedding_status", status)
    )


@query(
    "child_split",
    """SELECT id, CAST(pos AS BIGINT) AS pos, piece FROM (SELECT id, unnest(kids) AS piece,
    unnest(range(0, len(kids))) AS pos FROM child_lists)""",
)
def child_split(t: Tables) -> DataFrame:
    return t.import_chunks.select(
        "id", F.posexplode(kn.children()).alias("pos", "c")
    ).select("id", F.col("pos").cast("long").alias("pos"), F.col("c.text").alias("piece"))


@query("expected_rows", "SELECT id, len(kids) + 1 AS expected FROM child_lists")
def expected_rows(t: Tables) -> DataFrame:
    return t.import_chunks.select("id", kn.expected_rows().alias("expected"))


@query(
    "document_knowledge_rows",
    """SELECT id, source_type, source_id, source_chunk_id, parent_chunk_id, chunk_level, source_title, chunk_index,
    content, embedding_text, search_text, status, sha256(embedding_text) AS content_hash FROM doc_rows""",
)
def document_knowledge_rows(t: Tables) -> DataFrame:
    return doc_rows(t).select(
        "id", "source_type", "source_id", "source_chunk_id", "parent_chunk_id", "chunk_level", "source_title",
        "chunk_index", "content", "embedding_text", "search_text", "status", "content_hash",
    )


FAQ_CONTENT = f"""concat_ws(chr(10), '问题：' || {strip('question')},
  CASE WHEN len(question_variants) > 0 THEN '相似问法：' || array_to_string({ITEMS.format('question_variants')}, '；') END,
  '答案：' || {strip('answer')})"""
register(
    "faq_rows",
    f"""SELECT 'kc_faq_' || id AS id, id AS source_id, 0 AS chunk_index, {strip('question')} AS source_title,
    {FAQ_CONTENT} AS content, {FAQ_TEXT} AS embedding_text, confidence, status, sha256({FAQ_TEXT}) AS content_hash, item_id
    FROM faq_documents""",
)


@query(
    "faq_knowledge_rows",
    "SELECT id, source_id, chunk_index, source_title, content, embedding_text, confidence, status, content_hash FROM faq_rows",
)
def faq_knowledge_rows(t: Tables) -> DataFrame:
    return kn.faq_knowledge_rows(t.faq_documents).select(
        "id", "source_id", "chunk_index", "source_title", "content", "embedding_text", "confidence", "status",
        "content_hash",
    )


@query(
    "knowledge_row_defaults",
    f"""SELECT id, {strip('e')} AS embedding_text, {strip('title')} || chr(10) || {strip('body')} AS search_text,
    CASE WHEN n % 3 = 0 THEN 'needs_review' ELSE 'usable' END AS status, 'pending' AS embedding_status,
    sha256({strip('e')}) AS content_hash, '' AS tags FROM (SELECT 'kc_' || doc_id AS id, doc_id AS n, text AS body,
      source AS title, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'E ' || text END AS e FROM documents)""",
)
def knowledge_row_defaults(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    empty = F.lit(None).cast("string")
    rows = t.raw("documents").select(
        F.concat(F.lit("kc_"), n.cast("string")).alias("id"),
        F.col("source").alias("source_title"),
        F.col("text").alias("content"),
        F.when(n % 2 == 1, F.concat(F.lit("E "), "text")).otherwise("  ").alias("embedding_text"),
        empty.alias("search_text"),
        F.when(n % 3 != 0, "usable").alias("status"),
        empty.alias("embedding_status"),
        empty.alias("content_hash"),
        F.lit(None).cast("array<string>").alias("tags"),
    )
    return kn.with_row_defaults(rows).withColumn("tags", F.array_join("tags", ","))


# --- embedding state -----------------------------------------------------------------------------

COUNTS = """count(r.id) AS knowledge_count, count(r.id) FILTER (r.embedding_status = 'ready') AS ready_count,
  count(r.id) FILTER (r.embedding_status = 'stale') AS stale_count,
  count(r.id) FILTER (r.embedding_status = 'failed') AS failed_count,
  count(r.id) FILTER (r.embedding_status = 'pending') AS pending_count"""
register(
    "chunk_counts",
    f"""SELECT c.id, c.file_id, c.is_disabled, len(c.kids) + 1 AS expected, {COUNTS} FROM child_lists c
    LEFT JOIN stored_rows r ON r.source_chunk_id = c.id AND r.source_id = c.file_id GROUP BY ALL""",
)
register(
    "chunk_states",
    """SELECT *, CASE WHEN knowledge_count = 0 THEN 'pending' WHEN stale_count > 0 THEN 'stale'
    WHEN failed_count > 0 AND ready_count = 0 THEN 'failed'
    WHEN knowledge_count = expected AND ready_count = knowledge_count THEN 'ready'
    WHEN ready_count = 0 THEN 'pending' ELSE 'partial' END AS embedding_status FROM chunk_counts""",
)


@query(
    "chunk_embedding_counts",
    "SELECT id, file_id, knowledge_count, ready_count, stale_count, failed_count, pending_count FROM chunk_counts",
)
def chunk_embedding_counts(t: Tables) -> DataFrame:
    return kn.chunk_embedding_counts(t.import_chunks.select("id", "file_id"), stored_rows(t))


def states(t: Tables) -> DataFrame:
    return kn.chunk_embedding_status(t.import_chunks, stored_rows(t))


@query("chunk_embedding_status", "SELECT id, file_id, expected, knowledge_count, embedding_status FROM chunk_states")
def chunk_embedding_status(t: Tables) -> DataFrame:
    return states(t).select("id", "file_id", "expected", "knowledge_count", "embedding_status")


@query(
    "chunk_embedding_backlog",
    "SELECT id, file_id, embedding_status FROM chunk_states WHERE NOT is_disabled AND embedding_status <> 'ready'",
)
def chunk_embedding_backlog(t: Tables) -> DataFrame:
    return (
        states(t)
        .filter(~F.col("is_disabled") & (F.col("embedding_status") != "ready"))
        .select("id", "file_id", "embedding_status")
    )


@query(
    "chunk_status_counts",
    """SELECT file_id, embedding_status AS option, count(*) AS n FROM chunk_states WHERE NOT is_disabled GROUP BY ALL
    UNION ALL SELECT file_id, 'disabled', count(*) FROM chunk_states WHERE is_disabled GROUP BY ALL""",
)
def chunk_status_counts(t: Tables) -> DataFrame:
    option = F.when(F.col("is_disabled"), "disabled").otherwise(F.col("embedding_status"))
    return states(t).groupBy("file_id", option.alias("option")).agg(F.count(F.lit(1)).alias("n"))


register(
    "file_summaries",
    """SELECT *, CASE WHEN total_chunks = 0 THEN 'none' WHEN stale_count > 0 THEN 'stale'
    WHEN failed_count > 0 AND ready_count = 0 THEN 'failed' WHEN ready_count >= total_chunks THEN 'ready'
    WHEN ready_count = 0 THEN 'pending' ELSE 'partial' END AS status FROM (
      SELECT f.id AS file_id, CAST(coalesce(sum(greatest(expected, knowledge_count)), 0) AS BIGINT) AS total_chunks,
        CAST(coalesce(sum(knowledge_count), 0) AS BIGINT) AS knowledge_count,
        CAST(coalesce(sum(ready_count), 0) AS BIGINT) AS ready_count,
        CAST(coalesce(sum(stale_count), 0) AS BIGINT) AS stale_count,
        CAST(coalesce(sum(failed_count), 0) AS BIGINT) AS failed_count,
        CAST(coalesce(sum(pending_count + greatest(expected - knowledge_count, 0)), 0) AS BIGINT) AS pending_count,
        CAST(coalesce(sum(greatest(expected - knowledge_count, 0)), 0) AS BIGINT) AS missing_count
      FROM import_files f LEFT JOIN chunk_counts c ON c.file_id = f.id AND NOT c.is_disabled GROUP BY f.id)""",
)


def file_summary(t: Tables) -> DataFrame:
    return kn.file_embedding_summary(t.import_files, t.import_chunks, stored_rows(t))


@query("file_embedding_summary", "SELECT * FROM file_summaries")
def file_embedding_summary(t: Tables) -> DataFrame:
    return file_summary(t)


register(
    "latest_parse",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY created_at DESC, id DESC) AS rn
    FROM parse_jobs) WHERE rn = 1""",
)


@query(
    "latest_job_per_file",
    f"SELECT file_id, id, status, strftime(created_at, {SQL_STAMP}) AS created_at FROM latest_parse",
)
def latest_job_per_file(t: Tables) -> DataFrame:
    return lc.latest(t.parse_jobs, ["file_id"]).select(
        "file_id", "id", "status", F.date_format("created_at", STAMP).alias("created_at")
    )


@query(
    "latest_kg_job",
    f"""SELECT source_type, source_id, id, status FROM (SELECT *, row_number() OVER (
    PARTITION BY source_type, source_id ORDER BY created_at DESC, id DESC) AS rn FROM kg_jobs) WHERE rn = 1""",
)
def latest_kg_job(t: Tables) -> DataFrame:
    return lc.latest(t.kg_jobs, ["source_type", "source_id"]).select("source_type", "source_id", "id", "status")


@query(
    "file_list",
    """SELECT f.id, f.original_name, p.id AS latest_job_id, p.status AS latest_job_status, s.status AS embedding_status,
    s.total_chunks FROM import_files f LEFT JOIN latest_parse p ON p.file_id = f.id
    LEFT JOIN file_summaries s ON s.file_id = f.id WHERE f.original_name ILIKE '%src1%' AND f.status = 'needs_review'
    ORDER BY f.updated_at DESC, f.id LIMIT 100""",
)
def file_list(t: Tables) -> DataFrame:
    page = (
        t.import_files.filter(F.col("original_name").ilike("%src1%") & (F.col("status") == "needs_review"))
        .orderBy(F.desc("updated_at"), F.asc("id"))
        .limit(100)
        .select("id", "original_name")
    )
    jobs = lc.latest(t.parse_jobs, ["file_id"]).select(
        F.col("file_id").alias("id"), F.col("id").alias("latest_job_id"), F.col("status").alias("latest_job_status")
    )
    summary = file_summary(t).select(
        F.col("file_id").alias("id"), F.col("status").alias("embedding_status"), "total_chunks"
    )
    return page.join(jobs, "id", "left").join(summary, "id", "left")


@query(
    "file_facets",
    """SELECT 'status' AS facet, status AS value, count(*) AS n FROM import_files GROUP BY ALL
    UNION ALL SELECT 'embedding_status', status, count(*) FROM file_summaries GROUP BY ALL""",
)
def file_facets(t: Tables) -> DataFrame:
    from loreframe.plans.traffic import facets

    return facets(t.import_files, ["status"]).unionByName(
        facets(file_summary(t).select(F.col("status").alias("embedding_status")), ["embedding_status"])
    )


JOB_STATES = ["queued", "processing", "generated", "skipped", "failed"]


def job_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("job_id").agg(
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in JOB_STATES]
    )


@query(
    "generation_job_counts",
    "SELECT job_id, "
    + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}_count" for s in JOB_STATES)
    + " FROM job_items GROUP BY job_id",
)
def generation_job_counts(t: Tables) -> DataFrame:
    return job_counts(t.job_items)


@query(
    "file_totals",
    """SELECT file_id, CAST(sum(len(kids)) AS BIGINT) AS message_count, count(*) AS chunk_count
    FROM child_lists GROUP BY file_id""",
)
def file_totals(t: Tables) -> DataFrame:
    size = F.size(kn.children()).cast("long")
    return t.import_chunks.select("file_id", size.alias("n")).groupBy("file_id").agg(
        F.sum("n").alias("message_count"), F.count(F.lit(1)).alias("chunk_count")
    )


_QUESTION_SQL = f"""CASE WHEN {strip('source_text')} = '' THEN 'skipped' WHEN len(questions) > 0 THEN 'keep'
  ELSE 'generate' END"""


def question_action(force: bool = False):
    has = F.size("questions") > 0
    return (
        F.when(tx.blank(F.col("source_text")), "skipped")
        .when(has & F.lit(not force), "keep")
        .otherwise("generate")
    )


@query("question_backlog", f"SELECT {_QUESTION_SQL} AS action, count(*) AS n FROM import_chunks GROUP BY 1")
def question_backlog(t: Tables) -> DataFrame:
    return t.import_chunks.groupBy(question_action().alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "question_outcomes",
    f"""SELECT file_id, CASE {_QUESTION_SQL} WHEN 'generate' THEN CASE WHEN chunk_index % 7 = 0 THEN 'failed' ELSE 'ready' END
    WHEN 'keep' THEN 'ready' ELSE 'skipped' END AS outcome, count(*) AS n FROM import_chunks GROUP BY ALL""",
)
def question_outcomes(t: Tables) -> DataFrame:
    action = question_action()
    outcome = (
        F.when((action == "generate") & (F.col("chunk_index") % 7 == 0), "failed")
        .when(action == "skipped", "skipped")
        .otherwise("ready")
    )
    return t.import_chunks.groupBy("file_id", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "file_candidates",
    """SELECT c.id, c.chunk_id, ch.file_id, c.status FROM import_candidates c
    JOIN import_chunks ch ON ch.id = c.chunk_id JOIN import_files f ON f.id = ch.file_id""",
)
def file_candidates(t: Tables) -> DataFrame:
    chunks = t.import_chunks.select(F.col("id").alias("chunk_id"), "file_id")
    files = t.import_files.select(F.col("id").alias("file_id"))
    return (
        t.import_candidates.select("id", "chunk_id", "status")
        .join(chunks, "chunk_id")
        .join(files, "file_id", "left_semi")
    )


@query(
    "due_jobs",
    f"""SELECT id, file_id, strftime(next_attempt_at, {SQL_STAMP}) AS next_attempt_at FROM parse_jobs
    WHERE status = 'queued' AND next_attempt_at <= TIMESTAMP '{NOW}' ORDER BY created_at, id LIMIT 50""",
)
def due_jobs(t: Tables) -> DataFrame:
    return (
        t.parse_jobs.filter((F.col("status") == "queued") & (F.col("next_attempt_at") <= now()))
        .orderBy("created_at", "id")
        .limit(50)
        .select("id", "file_id", F.date_format("next_attempt_at", STAMP).alias("next_attempt_at"))
    )


# --- parent context over parent / child rows ------------------------------------------------------


@query(
    "parent_context",
    """WITH cand AS (SELECT parent_index % 50 AS query_id, id, parent_chunk_id, source_id, source_chunk_id FROM stored_rows
      WHERE child_no = 1 OR (child_no = 0 AND parent_index % 10 = 0))
    SELECT DISTINCT c.query_id, p.id, p.source_id, p.content, 1.0::DOUBLE AS score FROM cand c JOIN stored_rows p
      ON p.id = c.parent_chunk_id AND p.source_id = c.source_id AND p.source_chunk_id = c.source_chunk_id
    JOIN import_files f ON f.id = p.source_id AND NOT f.is_disabled
    JOIN import_chunks k ON k.id = p.source_chunk_id AND k.file_id = p.source_id AND NOT k.is_disabled
    WHERE p.chunk_level = 'parent' AND p.status = 'usable' AND p.embedding_status = 'ready'
      AND NOT EXISTS (SELECT 1 FROM cand x WHERE x.query_id = c.query_id AND x.id = p.id)""",
)
def parent_context(t: Tables) -> DataFrame:
    from loreframe.operators.retrieval import parent_context as context

    rows = stored_rows(t)
    n = F.regexp_extract("source_chunk_id", r"(\d+)$", 1).cast("long")
    candidates = rows.filter(
        (F.col("child_no") == 1) | ((F.col("child_no") == 0) & (n % 10 == 0))
    ).select((n % 50).alias("query_id"), "id")
    return context(candidates, rows, t.import_files, t.import_chunks).select(
        "query_id", "id", "source_id", "content", "score"
    )


# --- repairs --------------------------------------------------------------------------------------

register(
    "faq_projection",
    """SELECT id, source_id, CASE WHEN item_id % 7 = 0 THEN 'disabled' ELSE status END AS status,
      CASE WHEN item_id % 9 = 0 THEN NULL ELSE confidence END AS confidence,
      CASE WHEN item_id % 4 = 0 THEN sha256('old') ELSE content_hash END AS content_hash,
      CASE WHEN item_id % 6 = 1 THEN 'stale' ELSE 'ready' END AS embedding_status FROM faq_rows WHERE item_id % 11 <> 0""",
)


def faq_hashes(t: Tables) -> DataFrame:
    """FAQ rows as stored now: id, status, confidence, hash, embedding status."""
    rows = kn.faq_knowledge_rows(t.faq_documents).select(
        F.col("source_id").alias("id"), "content_hash", F.col("id").alias("kc")
    )
    return t.faq_documents.select("id", "item_id", "status", "confidence", "embedding_status").join(rows, "id")


def faq_projection(t: Tables) -> DataFrame:
    """Stored projections of the FAQs, some of them drifted or missing."""
    i = F.col("item_id")
    return faq_hashes(t).filter(i % 11 != 0).select(
        F.col("kc").alias("id"),
        F.col("id").alias("source_id"),
        F.when(i % 7 == 0, "disabled").otherwise(F.col("status")).alias("status"),
        F.when(i % 9 != 0, F.col("confidence")).alias("confidence"),
        F.when(i % 4 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(i % 6 == 1, "stale").otherwise("ready").alias("embedding_status"),
    )


_MISSING_SQL = """SELECT f.id FROM faq_documents f JOIN faq_rows r ON r.source_id = f.id WHERE f.embedding_status = 'ready'
  AND NOT EXISTS (SELECT 1 FROM faq_projection p WHERE p.source_id = f.id AND p.content_hash = r.content_hash
  AND p.embedding_status = 'ready')"""


@query("faq_missing_projection", _MISSING_SQL)
def faq_missing_projection(t: Tables) -> DataFrame:
    ready = faq_projection(t).filter("embedding_status = 'ready'").select(
        F.col("source_id").alias("id"), "content_hash"
    )
    return (
        faq_hashes(t).filter("embedding_status = 'ready'").join(ready, ["id", "content_hash"], "left_anti").select("id")
    )


_ORPHAN_PARENT_SQL = """SELECT p.id FROM stored_rows p WHERE p.chunk_level = 'parent' AND p.embedding_status = 'ready'
  AND NOT EXISTS (SELECT 1 FROM stored_rows c WHERE c.source_id = p.source_id AND c.source_chunk_id = p.source_chunk_id
  AND c.parent_chunk_id = p.id AND c.chunk_level = 'child' AND c.child_no % 2 = 0)"""


@query("parent_without_child", _ORPHAN_PARENT_SQL)
def parent_without_child(t: Tables) -> DataFrame:
    """Parents without an even-numbered child: what a half-lost child set looks like."""
    rows = stored_rows(t)
    kept = rows.filter((F.col("chunk_level") == "child") & (F.col("child_no") % 2 == 0))
    return childless_parents(rows.filter("chunk_level = 'parent'").unionByName(kept))


def childless_parents(rows: DataFrame) -> DataFrame:
    parents = rows.filter("chunk_level = 'parent' and embedding_status = 'ready'")
    children = rows.filter("chunk_level = 'child'").select(
        F.col("parent_chunk_id").alias("id"), "source_id", "source_chunk_id"
    )
    return parents.join(children, ["id", "source_id", "source_chunk_id"], "left_anti").select("id")


@query(
    "projection_drift",
    """SELECT p.id, p.status, p.confidence FROM faq_projection p JOIN faq_documents f ON f.id = p.source_id
    WHERE p.status IS DISTINCT FROM f.status OR p.confidence IS DISTINCT FROM f.confidence""",
)
def projection_drift(t: Tables) -> DataFrame:
    expected = t.faq_documents.select(F.col("id").alias("source_id"), "status", "confidence")
    return lc.anti_drift(faq_projection(t), expected, ["source_id"], ["status", "confidence"]).select(
        "id", "status", "confidence"
    )


@query(
    "faq_projection_sync",
    """SELECT p.id, f.status, f.confidence, p.content_hash, p.embedding_status,
    p.status IS DISTINCT FROM f.status OR p.confidence IS DISTINCT FROM f.confidence AS changed
    FROM faq_projection p JOIN faq_documents f ON f.id = p.source_id""",
)
def faq_projection_sync(t: Tables) -> DataFrame:
    expected = t.faq_documents.select(
        F.col("id").alias("source_id"), F.col("status").alias("s"), F.col("confidence").alias("c")
    )
    same = F.col("status").eqNullSafe(F.col("s")) & F.col("confidence").eqNullSafe(F.col("c"))
    return faq_projection(t).join(expected, "source_id").select(
        "id", F.col("s").alias("status"), F.col("c").alias("confidence"), "content_hash", "embedding_status",
        (~same).alias("changed"),
    )


@query(
    "child_locator_fix",
    """WITH moved AS (SELECT id, source_id, parent_chunk_id, embedding_status, source_chunk_id AS right_id,
      CASE WHEN child_no % 5 = 1 THEN id WHEN child_no % 7 = 2 THEN NULL ELSE source_chunk_id END AS source_chunk_id
      FROM stored_rows WHERE chunk_level = 'child')
    SELECT c.id, p.source_chunk_id, 'stale' AS embedding_status FROM moved c JOIN stored_rows p
      ON p.id = c.parent_chunk_id AND p.chunk_level = 'parent' AND p.source_id = c.source_id
    WHERE c.source_chunk_id IS DISTINCT FROM p.source_chunk_id""",
)
def child_locator_fix(t: Tables) -> DataFrame:
    rows = stored_rows(t)
    moved = rows.filter("chunk_level = 'child'").select(
        "id", "source_id", "parent_chunk_id",
        F.when(F.col("child_no") % 5 == 1, F.col("id"))
        .when(F.col("child_no") % 7 == 2, F.lit(None))
        .otherwise(F.col("source_chunk_id"))
        .alias("stored_chunk_id"),
    )
    parents = rows.filter("chunk_level = 'parent' and source_chunk_id is not null").select(
        F.col("id").alias("parent_chunk_id"), "source_id", "source_chunk_id"
    )
    return (
        moved.join(parents, ["parent_chunk_id", "source_id"])
        .filter(~F.col("stored_chunk_id").eqNullSafe(F.col("source_chunk_id")))
        .select("id", "source_chunk_id", F.lit("stale").alias("embedding_status"))
    )


_QUESTIONS_STALE_SQL = """SELECT r.id, 'stale' AS embedding_status FROM stored_rows r JOIN import_chunks c
  ON c.id = r.source_chunk_id AND c.file_id = r.source_id WHERE r.embedding_status <> 'stale'
  AND (CASE WHEN c.chunk_index % 10 = 0 THEN c.questions ELSE CAST([] AS VARCHAR[]) END) IS DISTINCT FROM c.questions"""


@query("questions_stale", _QUESTIONS_STALE_SQL)
def questions_stale(t: Tables) -> DataFrame:
    stored = F.when(F.col("chunk_index") % 10 == 0, F.col("questions")).otherwise(
        F.array().cast("array<string>")
    )
    changed = t.import_chunks.filter(~stored.eqNullSafe(F.col("questions"))).select(
        F.col("id").alias("source_chunk_id"), F.col("file_id").alias("source_id")
    )
    return (
        stored_rows(t)
        .filter("embedding_status <> 'stale'")
        .join(changed, ["source_chunk_id", "source_id"], "left_semi")
        .select("id", F.lit("stale").alias("embedding_status"))
    )


@query(
    "repair_report",
    f"""SELECT 'parent_without_child' AS rule, count(*) AS n FROM ({_ORPHAN_PARENT_SQL})
    UNION ALL SELECT 'faq_hash_drift', count(*) FROM faq_projection p JOIN faq_rows r ON r.source_id = p.source_id
      WHERE p.content_hash IS DISTINCT FROM r.content_hash AND p.embedding_status <> 'stale'
    UNION ALL SELECT 'faq_missing_projection', count(*) FROM ({_MISSING_SQL})
    UNION ALL SELECT 'questions_changed', count(*) FROM ({_QUESTIONS_STALE_SQL})""",
)
def repair_report(t: Tables) -> DataFrame:
    expected = faq_hashes(t).select(F.col("id").alias("source_id"), "content_hash")
    hash_drift = lc.anti_drift(
        faq_projection(t).filter("embedding_status <> 'stale'"), expected, ["source_id"], ["content_hash"]
    )
    rules = {
        "parent_without_child": parent_without_child(t),
        "faq_hash_drift": hash_drift,
        "faq_missing_projection": faq_missing_projection(t),
        "questions_changed": questions_stale(t),
    }
    out = None
    for name, found in rules.items():
        one = found.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# --- merges ---------------------------------------------------------------------------------------

register(
    "faq_updates",
    """SELECT id, question || ' v' || v AS question, answer, 'usable' AS status,
      updated_at + to_seconds(CAST(v * 10 AS BIGINT)) AS updated_at, TIMESTAMP '2024-01-31 00:00:00' AS created_at
    FROM faq_documents, (SELECT unnest([1, 2]) AS v) WHERE item_id % 2 = 0
    UNION ALL SELECT 'new_' || id, question, answer, 'needs_review', updated_at, TIMESTAMP '2024-01-31 00:00:00'
    FROM faq_documents WHERE item_id % 3 = 0""",
)


def faq_updates(t: Tables) -> DataFrame:
    f = t.faq_documents
    twice = f.filter("item_id % 2 = 0").withColumn("v", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        "id",
        F.concat("question", F.lit(" v"), F.col("v").cast("string")).alias("question"),
        "answer",
        F.lit("usable").alias("status"),
        (F.col("updated_at") + F.make_dt_interval(secs=(F.col("v") * 10).cast("decimal(18,6)"))).alias("updated_at"),
        now().alias("created_at"),
    )
    new = f.filter("item_id % 3 = 0").select(
        F.concat(F.lit("new_"), "id").alias("id"), "question", "answer", F.lit("needs_review").alias("status"),
        "updated_at", now().alias("created_at"),
    )
    return twice.unionByName(new)


FAQ_BASE = ["id", "question", "answer", "status", "updated_at", "created_at"]


def stamped(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.date_format(n, STAMP) for n in names})


@query(
    "upsert_latest",
    f"""WITH u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn
      FROM faq_updates) WHERE rn = 1)
    SELECT id, question, answer, status, strftime(updated_at, {SQL_STAMP}) AS updated_at,
      strftime(created_at, {SQL_STAMP}) AS created_at FROM faq_documents WHERE id NOT IN (SELECT id FROM u)
    UNION ALL SELECT u.id, u.question, u.answer, u.status, strftime(u.updated_at, {SQL_STAMP}),
      strftime(coalesce(f.created_at, u.created_at), {SQL_STAMP}) FROM u LEFT JOIN faq_documents f USING (id)""",
)
def upsert_latest(t: Tables) -> DataFrame:
    base = t.faq_documents.select(*FAQ_BASE)
    merged = lc.upsert(base, faq_updates(t), ["id"], [F.col("updated_at")])
    return stamped(merged, "updated_at", "created_at")


@query(
    "insert_if_absent",
    f"""SELECT id, question, status FROM faq_documents UNION ALL
    SELECT id, question, status FROM faq_updates WHERE id NOT IN (SELECT id FROM faq_documents)""",
)
def insert_if_absent(t: Tables) -> DataFrame:
    base = t.faq_documents.select("id", "question", "status")
    return lc.insert_if_absent(base, faq_updates(t).select("id", "question", "status"), ["id"])


@query(
    "faq_change_effects",
    """SELECT f.id, f.question IS DISTINCT FROM u.question AS content_changed,
    (f.status = 'usable') <> (u.status = 'usable') AS gate_changed,
    CASE WHEN f.question IS DISTINCT FROM u.question AND f.embedding_status = 'ready' THEN 'stale'
      ELSE f.embedding_status END AS embedding_status
    FROM faq_documents f JOIN (SELECT id, max_by(question, updated_at) AS question, max_by(status, updated_at) AS status
      FROM faq_updates GROUP BY id) u USING (id)""",
)
def faq_change_effects(t: Tables) -> DataFrame:
    from loreframe.scale import latest_per_key

    new = latest_per_key(faq_updates(t), ["id"], [F.col("updated_at")]).select(
        "id", F.col("question").alias("q"), F.col("status").alias("s")
    )
    changed = ~F.col("question").eqNullSafe(F.col("q"))
    return t.faq_documents.join(new, "id").select(
        "id",
        changed.alias("content_changed"),
        ((F.col("status") == "usable") != (F.col("s") == "usable")).alias("gate_changed"),
        F.when(changed & (F.col("embedding_status") == "ready"), "stale")
        .otherwise(F.col("embedding_status"))
        .alias("embedding_status"),
    )


@query(
    "faq_status_change",
    """WITH c AS (SELECT id, 'usable' AS s FROM faq_documents WHERE item_id % 5 < 2)
    SELECT p.id, coalesce(c.s, f.status) AS status, coalesce(c.s, f.status) IS DISTINCT FROM f.status AS changed
    FROM faq_documents f LEFT JOIN c USING (id) JOIN faq_projection p ON p.source_id = f.id""",
)
def faq_status_change(t: Tables) -> DataFrame:
    changes = t.faq_documents.filter("item_id % 5 < 2").select("id", F.lit("usable").alias("new_status"))
    applied = lc.apply_status(t.faq_documents.select("id", "status"), changes).withColumnRenamed("id", "source_id")
    return faq_projection(t).select("id", "source_id").join(applied, "source_id").select("id", "status", "changed")


@query(
    "embedding_commit",
    """SELECT r.id, CASE WHEN r.hash = f.content_hash THEN CASE WHEN r.failed THEN 'failed' ELSE 'ready' END
      ELSE 'rejected' END AS outcome FROM (SELECT source_id AS id, item_id % 5 = 0 AS failed,
      CASE WHEN item_id % 3 = 0 THEN 'outdated' ELSE content_hash END AS hash FROM faq_rows) r
    JOIN (SELECT source_id AS id, content_hash FROM faq_rows) f USING (id)""",
)
def embedding_commit(t: Tables) -> DataFrame:
    current = faq_hashes(t).select("id", "content_hash", "item_id")
    i = F.col("item_id")
    results = current.select(
        "id",
        F.when(i % 3 == 0, "outdated").otherwise(F.col("content_hash")).alias("result_hash"),
        (i % 5 == 0).alias("failed"),
    )
    return results.join(current.select("id", "content_hash"), "id").select(
        "id",
        F.when(F.col("result_hash") != F.col("content_hash"), "rejected")
        .when(F.col("failed"), "failed")
        .otherwise("ready")
        .alias("outcome"),
    )


@query(
    "vector_replace",
    f"""WITH fp AS (SELECT c.id, c.file_id, c.is_disabled OR f.is_disabled AS off, {FINGERPRINT} AS h
      FROM import_chunks c JOIN import_files f ON f.id = c.file_id),
    got AS (SELECT source_chunk_id, count(*) AS rows, count(*) FILTER (chunk_level = 'parent') AS parents
      FROM stored_rows GROUP BY 1)
    SELECT k.id, CASE WHEN fp.off THEN 'source_unavailable' WHEN k.chunk_index % 8 = 3 THEN 'source_changed'
      WHEN coalesce(g.rows, 0) <> len(k.kids) + 1 OR g.parents <> 1 THEN 'wrong_shape' ELSE 'replaced' END AS outcome
    FROM child_lists k JOIN fp ON fp.id = k.id LEFT JOIN got g ON g.source_chunk_id = k.id""",
)
def vector_replace(t: Tables) -> DataFrame:
    """Result batches per source chunk: accepted, or rejected with the reason."""
    n = F.col("c.chunk_index")
    source = (
        t.import_chunks.alias("c")
        .join(t.import_files.alias("f"), F.col("f.id") == F.col("c.file_id"))
        .select(
            F.col("c.id").alias("id"),
            (F.col("c.is_disabled") | F.col("f.is_disabled")).alias("off"),
            fingerprint().alias("now_hash"),
            F.when(n % 8 == 3, F.lit("before")).otherwise(fingerprint()).alias("planned_hash"),
        )
    )
    expected = doc_rows(t).select("source_chunk_id", "id", "chunk_level", "chunk_index", "parent_chunk_id")
    result = stored_rows(t).select(
        "source_chunk_id", "id", "chunk_level", "chunk_index", "parent_chunk_id", F.lit(True).alias("present")
    )
    shape = (
        expected.join(
            result.select("id", F.struct("chunk_level", "chunk_index", "parent_chunk_id").alias("got")), "id", "left"
        )
        .groupBy("source_chunk_id")
        .agg(
            F.every(
                F.coalesce(
                    F.col("got").eqNullSafe(F.struct("chunk_level", "chunk_index", "parent_chunk_id")), F.lit(False)
                )
            ).alias("complete")
        )
        .withColumnRenamed("source_chunk_id", "id")
    )
    return source.join(shape, "id").select(
        "id",
        F.when(F.col("off"), "source_unavailable")
        .when(F.col("now_hash") != F.col("planned_hash"), "source_changed")
        .when(~F.col("complete"), "wrong_shape")
        .otherwise("replaced")
        .alias("outcome"),
    )


@query(
    "chunk_text_edit",
    """WITH e AS (SELECT id, chunk_index % 3 <> 0 AS changed FROM import_chunks WHERE chunk_index % 2 = 0)
    SELECT r.id, CASE WHEN e.changed THEN 'stale' ELSE r.embedding_status END AS embedding_status
    FROM stored_rows r LEFT JOIN e ON e.id = r.source_chunk_id
    WHERE NOT (coalesce(e.changed, false) AND r.chunk_level = 'child')""",
)
def chunk_text_edit(t: Tables) -> DataFrame:
    """Edited chunks lose their children and their parent turns stale; equal text is no edit."""
    c = t.import_chunks
    edits = c.filter("chunk_index % 2 = 0").select(
        "id",
        F.when(F.col("chunk_index") % 3 == 0, F.col("source_text"))
        .otherwise(F.concat("source_text", F.lit(" edited")))
        .alias("new_text"),
    )
    changed = (
        c.select("id", "source_text").join(edits, "id").filter("source_text <> new_text")
        .select(F.col("id").alias("source_chunk_id"), F.lit(True).alias("edited"))
    )
    rows = stored_rows(t).join(changed, "source_chunk_id", "left")
    edited = F.coalesce("edited", F.lit(False))
    return rows.filter(~(edited & (F.col("chunk_level") == "child"))).select(
        "id", F.when(edited, "stale").otherwise(F.col("embedding_status")).alias("embedding_status")
    )


@query(
    "disable_effects",
    """WITH want AS (SELECT id, chunk_index % 3 = 0 AS off FROM import_chunks)
    SELECT c.id, w.off AS is_disabled, (SELECT count(*) FROM kg_evidence e WHERE e.source_chunk_id = c.id) AS evidence
    FROM import_chunks c JOIN want w USING (id) WHERE w.off <> c.is_disabled""",
)
def disable_effects(t: Tables) -> DataFrame:
    want = t.import_chunks.select("id", (F.col("chunk_index") % 3 == 0).alias("off"))
    moved = (
        t.import_chunks.select("id", "is_disabled").join(want, "id").filter("off <> is_disabled")
        .select("id", F.col("off").alias("is_disabled"))
    )
    touched = (
        t.kg_evidence.filter("source_type = 'document'").groupBy(F.col("source_chunk_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("evidence"))
    )
    return moved.join(touched, "id", "left").withColumn(
        "evidence", F.coalesce("evidence", F.lit(0).cast("long"))
    )


@query(
    "file_delete_counts",
    """SELECT f.id, (SELECT count(*) FROM import_chunks c WHERE c.file_id = f.id) AS chunks,
      (SELECT count(*) FROM stored_rows r WHERE r.source_id = f.id) AS vectors,
      (SELECT count(*) FROM import_candidates x JOIN import_chunks c ON c.id = x.chunk_id WHERE c.file_id = f.id) AS candidates,
      (SELECT count(*) FROM kg_evidence e WHERE e.source_type = 'document' AND e.source_id = f.id) AS evidence
    FROM import_files f WHERE f.is_disabled OR f.id LIKE '%2'""",
)
def file_delete_counts(t: Tables) -> DataFrame:
    """What deleting the chosen files removes from every dependent table."""
    files = t.import_files.filter("is_disabled or id like '%2'").select("id")
    chunks = t.import_chunks.select(F.col("file_id").alias("id"), F.col("id").alias("chunk_id"))
    parts = {
        "chunks": chunks,
        "vectors": stored_rows(t).select(F.col("source_id").alias("id")),
        "candidates": t.import_candidates.select("chunk_id").join(chunks, "chunk_id"),
        "evidence": t.kg_evidence.filter("source_type = 'document'").select(F.col("source_id").alias("id")),
    }
    out = files
    for name, rows in parts.items():
        gone = rows.join(files, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias(name))
        out = out.join(gone, "id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


@query(
    "file_reparse",
    """SELECT id, file_id, 'kept' AS state FROM import_chunks WHERE file_id NOT LIKE '%4'
    UNION ALL SELECT 'new_' || id, file_id, 'new' FROM import_chunks WHERE file_id LIKE '%4'""",
)
def file_reparse(t: Tables) -> DataFrame:
    """All chunks of the reparsed files are replaced; every other file keeps its chunks."""
    base = t.import_chunks.select("id", "file_id", F.lit("kept").alias("state"))
    parsed = base.filter(F.col("file_id").endswith("4")).select(
        F.concat(F.lit("new_"), "id").alias("id"), "file_id", F.lit("new").alias("state")
    )
    kept = base.join(parsed.select("file_id").distinct(), "file_id", "left_anti")
    return kept.unionByName(parsed)


@query(
    "generation_plan",
    """WITH req AS (SELECT 'chunk_' || doc_id AS chunk_id FROM documents UNION SELECT 'chunk_x' || doc_id FROM labels),
    act AS (SELECT DISTINCT chunk_id FROM job_items WHERE status IN ('queued', 'processing'))
    SELECT r.chunk_id, CASE WHEN c.id IS NULL THEN 'missing_chunk' WHEN c.status = 'generated' THEN 'already_generated'
      WHEN a.chunk_id IS NOT NULL THEN 'already_queued' END AS reason,
      CASE WHEN c.id IS NULL OR c.status = 'generated' OR a.chunk_id IS NOT NULL THEN 'skipped' ELSE 'queued' END AS status
    FROM req r LEFT JOIN import_chunks c ON c.id = r.chunk_id LEFT JOIN act a ON a.chunk_id = r.chunk_id""",
)
def generation_plan(t: Tables) -> DataFrame:
    asked = t.raw("documents").select(F.concat(F.lit("chunk_"), F.col("doc_id").cast("string")).alias("chunk_id"))
    unknown = t.raw("labels").select(F.concat(F.lit("chunk_x"), F.col("doc_id").cast("string")).alias("chunk_id"))
    request = asked.unionByName(asked).unionByName(unknown).distinct()
    chunks = t.import_chunks.select(F.col("id").alias("chunk_id"), F.col("status").alias("chunk_status"))
    active = (
        t.job_items.filter(F.col("status").isin("queued", "processing")).select("chunk_id").distinct()
        .withColumn("active", F.lit(True))
    )
    reason = (
        F.when(F.col("chunk_status").isNull(), "missing_chunk")
        .when(F.col("chunk_status") == "generated", "already_generated")
        .when(F.col("active"), "already_queued")
    )
    return (
        request.join(chunks, "chunk_id", "left").join(active, "chunk_id", "left")
        .select("chunk_id", reason.alias("reason"))
        .withColumn("status", F.when(F.col("reason").isNull(), "queued").otherwise("skipped"))
    )


@query(
    "candidate_promotion",
    f"""SELECT 'faq_' || c.id AS id, c.question, c.answer, f.original_name AS source_file, 'import_review' AS source_group,
    c.chunk_id AS evidence_chunk_id, 'medium' AS confidence, 'needs_review' AS status,
    '标准问题：' || {strip('c.question')} || chr(10) || '答案：' || {strip('c.answer')} AS embedding_text,
    'saved' AS candidate_status FROM import_candidates c JOIN import_chunks k ON k.id = c.chunk_id
    JOIN import_files f ON f.id = k.file_id WHERE c.status = 'pending'""",
)
def candidate_promotion(t: Tables) -> DataFrame:
    chunks = t.import_chunks.select(F.col("id").alias("chunk_id"), "file_id")
    files = t.import_files.select(F.col("id").alias("file_id"), F.col("original_name").alias("source_file"))
    none = F.lit(None).cast("string")
    no = F.array().cast("array<string>")
    return (
        t.import_candidates.filter("status = 'pending'").join(chunks, "chunk_id").join(files, "file_id")
        .select(
            F.concat(F.lit("faq_"), "id").alias("id"), "question", "answer", "source_file",
            F.lit("import_review").alias("source_group"), F.col("chunk_id").alias("evidence_chunk_id"),
            F.lit("medium").alias("confidence"), F.lit("needs_review").alias("status"),
            tx.faq_embedding_text(F.col("question"), no, F.col("answer"), none, no).alias("embedding_text"),
            F.lit("saved").alias("candidate_status"),
        )
    )


@query(
    "faq_normalise",
    f"""SELECT id, {strip('question')} AS question, {strip('a')} AS answer, coalesce(nullif(confidence, ''), 'medium') AS confidence,
    array_to_string({ITEMS.format("regexp_split_to_array(array_to_string(tags, '，'), '[,，' || chr(10) || '；;]')")}, '|') AS tags,
    CASE WHEN {strip('question')} = '' THEN 'question is required' WHEN {strip('a')} = '' THEN 'answer is required' END AS reject
    FROM (SELECT *, CASE WHEN item_id % 6 = 0 THEN '  ' ELSE answer END AS a FROM faq_documents)""",
)
def faq_normalise(t: Tables) -> DataFrame:
    answer = F.when(F.col("item_id") % 6 == 0, F.lit("  ")).otherwise(F.col("answer"))
    payload = t.faq_documents.select(
        "id", tx.strip("question").alias("question"), tx.strip(answer).alias("answer"),
        F.coalesce(F.nullif("confidence", F.lit("")), F.lit("medium")).alias("confidence"),
        F.array_join(tx.split_list(F.array_join("tags", "，")), "|").alias("tags"),
    )
    return payload.withColumn(
        "reject",
        F.when(F.col("question") == "", "question is required").when(F.col("answer") == "", "answer is required"),
    )


@query(
    "parse_plan",
    f"""WITH act AS (SELECT DISTINCT file_id FROM latest_parse WHERE status IN ('queued', 'processing'))
    SELECT f.id AS file_id, f.chunker_type, sha256(f.chunker_type || '|' || f.original_name) AS input_fingerprint
    FROM import_files f WHERE f.id NOT IN (SELECT file_id FROM act)""",
)
def parse_plan(t: Tables) -> DataFrame:
    active = (
        lc.latest(t.parse_jobs, ["file_id"]).filter(F.col("status").isin("queued", "processing"))
        .select(F.col("file_id").alias("id"))
    )
    return t.import_files.join(active, "id", "left_anti").select(
        F.col("id").alias("file_id"), "chunker_type",
        F.sha2(F.concat_ws("|", "chunker_type", "original_name"), 256).alias("input_fingerprint"),
    )


# --- data quality ---------------------------------------------------------------------------------


def duplicates(df: DataFrame, rule: str, keys: list) -> DataFrame:
    key = F.concat_ws("|", *[k.cast("string") if not isinstance(k, str) else F.col(k).cast("string") for k in keys])
    return (
        df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(F.lit(rule).alias("rule"), "key", "n")
    )


@query(
    "dq_unique",
    """SELECT 'line_key' AS rule, concat_ws('|', l_orderkey, l_linenumber) AS key, count(*) AS n FROM lineitem
      GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'entity_name_type', concat_ws('|', lower(name), entity_type), count(*) FROM kg_entities GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'chunk_slot', concat_ws('|', source_type, source_id, chunk_index), count(*) FROM doc_rows GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'relation', concat_ws('|', head_entity_id, relation_type, tail_entity_id), count(*) FROM kg_relations
      GROUP BY ALL HAVING count(*) > 1""",
)
def dq_unique(t: Tables) -> DataFrame:
    return (
        duplicates(t.raw("lineitem"), "line_key", ["l_orderkey", "l_linenumber"])
        .unionByName(duplicates(t.kg_entities, "entity_name_type", [F.lower("name"), "entity_type"]))
        .unionByName(duplicates(doc_rows(t), "chunk_slot", ["source_type", "source_id", "chunk_index"]))
        .unionByName(duplicates(t.kg_relations, "relation", ["head_entity_id", "relation_type", "tail_entity_id"]))
    )


def orphans(child: DataFrame, rule: str, column: str, parent: DataFrame, key: str) -> DataFrame:
    keys = parent.select(F.col(key).alias("__k"))
    return (
        child.filter(F.col(column).isNotNull())
        .join(keys, F.col(column) == F.col("__k"), "left_anti")
        .groupBy(F.col(column).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(rule).alias("rule"), "key", "n")
    )


@query(
    "dq_orphans",
    """SELECT 'candidate_chunk' AS rule, chunk_id AS key, count(*) AS n FROM import_candidates WHERE chunk_id NOT IN (SELECT id FROM import_chunks) GROUP BY ALL
    UNION ALL SELECT 'evidence_chunk', source_chunk_id, count(*) FROM kg_evidence WHERE source_chunk_id NOT IN (SELECT id FROM import_chunks) GROUP BY ALL
    UNION ALL SELECT 'relation_head', head_entity_id, count(*) FROM kg_relations WHERE head_entity_id NOT IN (SELECT id FROM kg_entities WHERE status <> 'disabled') GROUP BY ALL
    UNION ALL SELECT 'run_case', case_id, count(*) FROM eval_runs WHERE case_id NOT IN (SELECT id FROM eval_cases WHERE status = 'active') GROUP BY ALL""",
)
def dq_orphans(t: Tables) -> DataFrame:
    return (
        orphans(t.import_candidates, "candidate_chunk", "chunk_id", t.import_chunks, "id")
        .unionByName(orphans(t.kg_evidence, "evidence_chunk", "source_chunk_id", t.import_chunks, "id"))
        .unionByName(
            orphans(t.kg_relations, "relation_head", "head_entity_id", t.kg_entities.filter("status <> 'disabled'"), "id")
        )
        .unionByName(orphans(t.eval_runs, "run_case", "case_id", t.eval_cases.filter("status = 'active'"), "id"))
    )


@query(
    "dq_checks",
    """SELECT rule, count(*) AS n FROM (
      SELECT 'confidence_range' AS rule FROM kg_entities WHERE NOT (confidence BETWEEN 0.55 AND 0.85)
      UNION ALL SELECT 'status_value' FROM kg_relations WHERE status NOT IN ('usable', 'disabled')
      UNION ALL SELECT 'owner_xor' FROM kg_evidence WHERE (entity_id IS NULL) = (relation_id IS NULL)
      UNION ALL SELECT 'offset_order' FROM kg_evidence WHERE char_start < 1 OR char_end <= char_start
      UNION ALL SELECT 'document_locator' FROM kg_evidence WHERE source_type = 'document' AND source_chunk_id IS NULL
      UNION ALL SELECT 'faq_locator' FROM kg_evidence WHERE source_type = 'faq' AND source_chunk_id IS NOT NULL
      UNION ALL SELECT 'progress' FROM parse_jobs WHERE CAST(json_extract(progress, '$.extracted_pages') AS BIGINT)
        > CAST(json_extract(progress, '$.total_pages') AS BIGINT)) GROUP BY rule""",
)
def dq_checks(t: Tables) -> DataFrame:
    """Rule columns per table in one scan each; only violations travel on."""
    def violations(df: DataFrame, rules: dict) -> DataFrame:
        flags = F.filter(
            F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]), lambda x: x.isNotNull()
        )
        return df.select(F.explode(flags).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))

    c = F.col
    pages = [tx.safe_int(F.get_json_object("progress", f"$.{k}")) for k in ("extracted_pages", "total_pages")]
    return (
        violations(t.kg_entities, {"confidence_range": ~c("confidence").between(0.55, 0.85)})
        .unionByName(violations(t.kg_relations, {"status_value": ~c("status").isin("usable", "disabled")}))
        .unionByName(
            violations(
                t.kg_evidence,
                {
                    "owner_xor": c("entity_id").isNull() == c("relation_id").isNull(),
                    "offset_order": (c("char_start") < 1) | (c("char_end") <= c("char_start")),
                    "document_locator": (c("source_type") == "document") & c("source_chunk_id").isNull(),
                    "faq_locator": (c("source_type") == "faq") & c("source_chunk_id").isNotNull(),
                },
            )
        )
        .unionByName(violations(t.parse_jobs, {"progress": pages[0] > pages[1]}))
    )


@query(
    "dq_one_active",
    """SELECT 'parse' AS kind, file_id AS key, count(*) AS n FROM parse_jobs WHERE status IN ('queued', 'processing') GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'extraction', source_id, count(*) FROM kg_jobs WHERE status IN ('queued', 'processing') GROUP BY ALL HAVING count(*) > 1""",
)
def dq_one_active(t: Tables) -> DataFrame:
    def active(df, kind, key):
        return (
            df.filter(F.col("status").isin("queued", "processing")).groupBy(F.col(key).alias("key"))
            .agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(kind).alias("kind"), "key", "n")
        )

    return active(t.parse_jobs, "parse", "file_id").unionByName(active(t.kg_jobs, "extraction", "source_id"))


# --- stored tables ----------------------------------------------------------------------------------


@query(
    "chunk_table_update",
    """SELECT id, file_id, CASE WHEN file_id IN ('src3', 'src7') THEN 'usable' ELSE retrieval_status END AS retrieval_status
    FROM import_chunks WHERE NOT (file_id = 'src3' AND is_disabled)""",
)
def chunk_table_update(t: Tables) -> DataFrame:
    """The chunk table, written by file; then two files are written again without touching the others."""
    from loreframe.operators.sinks import replace_partitions
    from loreframe.session import new_work_path

    path = new_work_path(t.spark, "chunks")
    rows = t.import_chunks.select("id", "file_id", "retrieval_status", "is_disabled")
    replace_partitions(rows, path, ["file_id"])
    again = rows.filter(F.col("file_id").isin("src3", "src7")).withColumn("retrieval_status", F.lit("usable"))
    replace_partitions(again.filter("not (file_id = 'src3' and is_disabled)"), path, ["file_id"])
    return t.spark.read.schema(rows.schema).parquet(path).select("id", "file_id", "retrieval_status")
