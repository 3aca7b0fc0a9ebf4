"""Evaluation, duplicates, answers and model-assisted steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loreframe.functions import text as tx
from loreframe.functions.constants import EVAL_CONTRACT, EVAL_STRATEGIES, INTENTS, TOP_K
from loreframe.operators import dedupe as dd, evaluation as ev, graph as kg, lifecycle as lc, models as md, retrieval as rt
from loreframe.plans.bindings_sql import register, strip
from loreframe.plans.registry import query
from loreframe.plans.search import fused, live
from loreframe.plans.textual import intent_questions, sql_signature
from loreframe.sources.tables import Tables

# --- evaluation -----------------------------------------------------------------------------------

register(
    "latest_eval",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, strategy ORDER BY created_at DESC, id DESC) AS rn FROM eval_runs
    WHERE contract_version = 2 AND strategy IN ('retrieval_hybrid_v1', 'retrieval_hybrid_v1_kg_debug')) WHERE rn = 1""",
)


@query("latest_eval_run", "SELECT case_id, strategy, id, array_to_string(retrieved_ids, '|') AS retrieved_ids FROM latest_eval")
def latest_eval_run(t: Tables) -> DataFrame:
    return ev.latest_runs(t.eval_runs).select("case_id", "strategy", "id", F.array_join("retrieved_ids", "|").alias("retrieved_ids"))


@query(
    "eval_cases_latest",
    """SELECT c.id, c.status, (SELECT coalesce(string_agg(strategy || '=' || id, ',' ORDER BY strategy), '') FROM latest_eval r WHERE r.case_id = c.id) AS latest_runs
    FROM eval_cases c ORDER BY c.updated_at DESC, c.id LIMIT 100""",
)
def eval_cases_latest(t: Tables) -> DataFrame:
    page = t.eval_cases.orderBy(F.desc("updated_at"), F.asc("id")).limit(100).select("id", "status")
    runs = ev.latest_runs(t.eval_runs).groupBy(F.col("case_id").alias("id")).agg(
        F.array_join(F.sort_array(F.collect_list(F.concat("strategy", F.lit("="), F.col("id")))), ",").alias("latest_runs")
    )
    return page.join(runs, "id", "left").withColumn("latest_runs", F.coalesce("latest_runs", F.lit("")))


@query(
    "eval_run_check",
    """SELECT id, CASE WHEN strategy NOT IN ('retrieval_hybrid_v1', 'retrieval_hybrid_v1_kg_debug') THEN 'bad_strategy'
    WHEN contract_version <> 2 THEN 'bad_contract' END AS reject FROM (SELECT id, contract_version,
      CASE WHEN id LIKE '%7_1_1' THEN 'other' ELSE strategy END AS strategy FROM eval_runs)""",
)
def eval_run_check(t: Tables) -> DataFrame:
    strategy = F.when(F.col("id").like("%7_1_1"), "other").otherwise(F.col("strategy"))
    return t.eval_runs.select(
        "id",
        F.when(~strategy.isin(EVAL_STRATEGIES), "bad_strategy").when(F.col("contract_version") != EVAL_CONTRACT, "bad_contract").alias("reject"),
    )


@query(
    "eval_metrics",
    """WITH r AS (SELECT r.strategy, list_min(list_filter(list_transform(range(1, 4), lambda i: CASE WHEN i <= len(r.retrieved_ids)
        AND list_contains(c.expected_source_ids, r.retrieved_ids[i]) THEN i END), lambda x: x IS NOT NULL)) AS rank
      FROM latest_eval r JOIN eval_cases c ON c.id = r.case_id)
    SELECT strategy, count(*) AS case_count, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0 END), 9) AS recall_at_k,
      round(avg(coalesce(1.0::DOUBLE / rank, 0)), 9) AS mrr, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END), 9) AS hit_rate_at_1 FROM r GROUP BY strategy""",
)
def eval_metrics(t: Tables) -> DataFrame:
    cases = t.eval_cases.select(F.col("id").alias("case_id"), F.col("expected_source_ids").alias("expected_ids"))
    results = ev.latest_runs(t.eval_runs).join(cases, "case_id")
    out = ev.metrics(results, ["strategy"], k=3)
    return out.withColumns({c: F.round(c, 9) for c in ("recall_at_k", "mrr", "hit_rate_at_1")})


register(
    "eval_labels",
    """SELECT id, status, CASE WHEN query_id % 4 = 0 AND len(expected_source_ids) > 1 THEN expected_source_ids ELSE CAST([] AS VARCHAR[]) END AS chunks,
    CASE WHEN query_id % 4 = 0 AND query_id % 8 = 0 THEN ['src' || (query_id % 20)] WHEN query_id % 4 = 0 THEN CAST([] AS VARCHAR[])
      WHEN query_id % 6 = 5 THEN CAST([] AS VARCHAR[]) ELSE ['src' || (query_id % 20 + query_id % 3)] END AS sources FROM eval_cases""",
)


def eval_labels(t: Tables) -> DataFrame:
    q, none = F.col("query_id"), F.array().cast("array<string>")
    src = F.array(F.concat(F.lit("src"), (q % 20).cast("string")))
    off = F.array(F.concat(F.lit("src"), (q % 20 + q % 3).cast("string")))
    return t.eval_cases.select(
        "id", "status",
        F.when((q % 4 == 0) & (F.size("expected_source_ids") > 1), F.col("expected_source_ids")).otherwise(none).alias("expected_chunk_ids"),
        F.when(q % 8 == 0, src).when((q % 4 == 0) | (q % 6 == 5), none).otherwise(off).alias("expected_source_ids"),
    )


register(
    "eval_diag",
    """SELECT id, level, CASE WHEN level = 'none' THEN 'missing_expected' WHEN retrieved_ids IS NULL THEN 'not_run' WHEN len(retrieved_ids) = 0 THEN 'empty_candidates'
      WHEN rank = 1 THEN 'hit' WHEN rank > 1 THEN 'low_rank' WHEN len(chunks) > 0 AND list_contains(sources, retrieved_source) THEN 'granularity_mismatch' ELSE 'missed' END AS reason,
      CASE WHEN level <> 'none' AND retrieved_ids IS NOT NULL THEN rank END AS rank,
      CASE WHEN level <> 'none' AND retrieved_ids IS NOT NULL THEN CASE WHEN rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END END AS recall,
      CASE WHEN level <> 'none' AND retrieved_ids IS NOT NULL THEN coalesce(1.0::DOUBLE / rank, 0) END AS mrr,
      CASE WHEN level <> 'none' AND retrieved_ids IS NOT NULL THEN CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END END AS top1
    FROM (SELECT *, CASE WHEN len(chunks) > 0 THEN list_min(list_filter(list_transform(range(1, 6), lambda i: CASE WHEN i <= len(retrieved_ids) AND list_contains(chunks, retrieved_ids[i]) THEN i END), lambda x: x IS NOT NULL))
        WHEN len(retrieved_ids) > 0 AND list_contains(sources, retrieved_source) THEN 1 END AS rank FROM (
      SELECT l.*, r.retrieved_ids, r.retrieved_source, CASE WHEN len(chunks) > 0 THEN 'chunk' WHEN len(sources) > 0 THEN 'source' ELSE 'none' END AS level
      FROM eval_labels l LEFT JOIN latest_eval r ON r.case_id = l.id AND r.strategy = 'retrieval_hybrid_v1_kg_debug' WHERE l.status = 'active'))""",
)


def diagnoses(t: Tables) -> DataFrame:
    runs = t.eval_runs.withColumn(
        "items", F.transform("retrieved_ids", lambda x: F.struct(x.alias("id"), F.col("retrieved_source").alias("source_id")))
    )
    return ev.diagnose(eval_labels(t), runs, EVAL_STRATEGIES[1])


@query("eval_diagnostics", "SELECT id, level, reason, rank, recall, mrr, top1 FROM eval_diag")
def eval_diagnostics(t: Tables) -> DataFrame:
    return diagnoses(t)


@query(
    "eval_summary",
    "SELECT count(*) AS active_cases, count(*) FILTER (level <> 'none') AS labelled_cases, "
    + ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}_count" for r in ev.REASONS)
    + ", round(avg(recall), 9) AS average_recall, round(avg(mrr), 9) AS average_mrr, round(avg(top1), 9) AS top1_rate FROM eval_diag",
)
def eval_summary(t: Tables) -> DataFrame:
    return ev.summary(diagnoses(t)).withColumns({c: F.round(c, 9) for c in ("average_recall", "average_mrr", "top1_rate")})


@query(
    "eval_clean_expected",
    """SELECT id, array_to_string(list_filter(expected_source_ids, lambda x: NOT starts_with(x, 'kc_kg_entity_')), '|') AS expected_source_ids
    FROM eval_cases""",
)
def eval_clean_expected(t: Tables) -> DataFrame:
    graph_ids = t.raw("embeddings").select(F.concat(F.lit("kc_kg_entity_"), F.col("vec_id").cast("string")).alias("id"))
    return ev.without_graph_ids(t.eval_cases, graph_ids).select(
        "id", F.array_join("expected_source_ids", "|").alias("expected_source_ids")
    )


@query(
    "eval_case_upsert",
    f"""SELECT id, {strip("question")} AS question, status FROM (
      SELECT id, CASE WHEN query_id % 3 = 0 THEN question || ' ?' ELSE question END AS question, CASE WHEN query_id % 3 = 0 THEN 'active' ELSE status END AS status FROM eval_cases
      UNION ALL SELECT 'case_faq_' || item_id, question, 'active' FROM faq_documents)""",
)
def eval_case_upsert(t: Tables) -> DataFrame:
    base = t.eval_cases.select("id", "question", "status", "updated_at", F.col("updated_at").alias("created_at"))
    later = F.col("updated_at") + F.expr("interval 1 day")
    edits = t.eval_cases.filter("query_id % 3 = 0").select(
        "id", F.concat("question", F.lit(" ?")).alias("question"), F.lit("active").alias("status"),
        later.alias("updated_at"), later.alias("created_at"),
    )
    new = t.faq_documents.select(
        F.concat(F.lit("case_faq_"), F.col("item_id").cast("string")).alias("id"), "question",
        F.lit("active").alias("status"), "updated_at", F.col("updated_at").alias("created_at"),
    )
    merged = lc.upsert(base, edits.unionByName(new), ["id"], [F.col("updated_at")])
    return merged.select("id", tx.strip("question").alias("question"), "status")


@query(
    "eval_run",
    f"""WITH r AS (SELECT c.id AS case_id, q.query_id, list_min(list(CASE WHEN list_contains(
          CASE WHEN len(l.chunks) > 0 THEN l.chunks ELSE l.sources END, CASE WHEN len(l.chunks) > 0 THEN f.id ELSE k.source_id END)
          THEN f.rank END)) AS rank, count(f.id) AS retrieved
      FROM eval_cases c JOIN eval_labels l ON l.id = c.id JOIN queries q USING (query_id) LEFT JOIN fused_rows f ON f.query_id = q.query_id AND f.rank <= {TOP_K}
      LEFT JOIN knowledge_chunks k ON k.id = f.id GROUP BY ALL)
    SELECT case_id, retrieved, rank, CASE WHEN rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END AS recall_at_k, coalesce(1.0::DOUBLE / rank, 0) AS mrr,
      CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END AS hit_rate_at_1, 'faq_exact' AS intent FROM r""",
)
def eval_run(t: Tables) -> DataFrame:
    """All cases through the hybrid run; a case's source ids count only where it expects no chunk ids."""
    hits = rt.hybrid_topk(t.queries, t.retrieval_aliases, live(t)).select("query_id", "id", "rank")
    found = hits.join(t.knowledge_chunks.select("id", "source_id"), "id")
    labels = eval_labels(t).select(F.col("id").alias("case_id"), "expected_chunk_ids", "expected_source_ids")
    cases = t.eval_cases.select(F.col("id").alias("case_id"), "query_id", "question").join(labels, "case_id")
    by_chunk = F.size("expected_chunk_ids") > 0
    hit = F.when(by_chunk, F.array_contains("expected_chunk_ids", F.col("id"))).otherwise(
        F.array_contains("expected_source_ids", F.col("source_id"))
    )
    ranked = cases.join(found, "query_id", "left").groupBy("case_id", "question").agg(
        F.count("id").alias("retrieved"), F.min(F.when(hit, F.col("rank"))).alias("rank")
    )
    return ranked.select(
        "case_id", "retrieved", "rank", *ev.case_metrics(F.col("rank")), tx.query_intent(F.col("question"))["intent"].alias("intent")
    )


# --- answers --------------------------------------------------------------------------------------


@query(
    "answer_documents",
    """SELECT f.query_id, f.rank, f.id, k.source_type, coalesce(nullif(k.source_title, ''), k.source_id) AS question, k.content AS answer,
    coalesce(q.category, k.source_type) AS category, f.fused_score AS score FROM fused_rows f JOIN knowledge_chunks k USING (id)
    LEFT JOIN faq_documents q ON k.source_type = 'faq' AND q.id = k.source_id WHERE f.rank <= 5""",
)
def answer_documents(t: Tables) -> DataFrame:
    hits = rt.hybrid_topk(t.queries, t.retrieval_aliases, live(t)).select("query_id", "rank", "id", F.col("fused_score").alias("score"))
    rows = t.knowledge_chunks.select("id", "source_type", "source_id", "source_title", "content")
    category = t.faq_documents.select(F.col("id").alias("source_id"), "category", F.lit("faq").alias("source_type"))
    return hits.join(rows, "id").join(category, ["source_id", "source_type"], "left").select(
        "query_id", "rank", "id", "source_type",
        F.coalesce(F.nullif("source_title", F.lit("")), "source_id").alias("question"),
        F.col("content").alias("answer"),
        F.coalesce("category", "source_type").alias("category"),
        "score",
    )


@query(
    "eval_items",
    """SELECT f.query_id, f.rank, f.id, k.source_id, k.source_type, f.channels, f.fused_score,
    CASE WHEN k.source_type NOT IN ('faq', 'document') THEN 'bad_source_type' WHEN k.source_id = '' OR f.id = '' THEN 'blank_id' END AS reject
    FROM fused_rows f JOIN knowledge_chunks k USING (id) WHERE f.rank <= 5""",
)
def eval_items(t: Tables) -> DataFrame:
    hits = rt.hybrid_topk(t.queries, t.retrieval_aliases, live(t))
    joined = hits.join(t.knowledge_chunks.select("id", "source_id", "source_type"), "id")
    reject = F.when(~F.col("source_type").isin("faq", "document"), "bad_source_type").when(
        tx.blank(F.col("source_id")) | tx.blank(F.col("id")), "blank_id"
    )
    return joined.select("query_id", "rank", "id", "source_id", "source_type", "channels", "fused_score", reject.alias("reject"))


@query(
    "rag_prompts",
    """SELECT q.query_id, coalesce((SELECT string_agg('[' || f.rank || '] id=' || f.id || chr(10) || 'source_type=' || k.source_type || chr(10) || 'source_id=' || k.source_id
      || chr(10) || 'source_title=' || coalesce(k.source_title, '') || chr(10) || 'content=' || k.content, chr(10) || chr(10) ORDER BY f.rank)
      FROM fused_rows f JOIN knowledge_chunks k USING (id) WHERE f.query_id = q.query_id AND f.rank <= 5), '没有检索到相关知识库内容。') AS context FROM queries q""",
)
def rag_prompts(t: Tables) -> DataFrame:
    """Ordered context per question; at most k rows per question are gathered."""
    hits = rt.hybrid_topk(t.queries, t.retrieval_aliases, live(t)).select("query_id", "rank", "id")
    rows = t.knowledge_chunks.select("id", "source_type", "source_id", "source_title", "content")
    part = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] id="), "id", F.lit("\nsource_type="), "source_type",
        F.lit("\nsource_id="), "source_id", F.lit("\nsource_title="), F.coalesce("source_title", F.lit("")), F.lit("\ncontent="), "content",
    )
    parts = F.sort_array(F.collect_list(F.struct("rank", part.alias("text"))))
    context = hits.join(rows, "id").groupBy("query_id").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("context")
    )
    return t.queries.select("query_id").join(context, "query_id", "left").withColumn(
        "context", F.coalesce("context", F.lit("没有检索到相关知识库内容。"))
    )


# --- duplicates -----------------------------------------------------------------------------------

register(
    "dd_refs",
    """SELECT id, question, answer, NULL AS chunk_id FROM faq_documents
    UNION ALL SELECT id, question, answer, chunk_id FROM import_candidates WHERE status IN ('pending', 'saved')""",
)


def dd_refs(t: Tables) -> DataFrame:
    return dd.references(t.faq_documents, t.import_candidates)


@query("dedupe_refs", "SELECT id, question, answer, chunk_id FROM dd_refs")
def dedupe_refs(t: Tables) -> DataFrame:
    return dd_refs(t)


register(
    "dd_candidates",
    """SELECT id, chunk_id, question, answer FROM import_candidates
    UNION ALL SELECT 'copy_' || id, 'chunk_copy', lower(question), ' ' || answer || '!' FROM import_candidates
    UNION ALL SELECT 'faqcopy_' || id, 'chunk_copy', question || '?', answer FROM faq_documents""",
)


def dd_candidates(t: Tables) -> DataFrame:
    c, f = t.import_candidates, t.faq_documents
    return (
        c.select("id", "chunk_id", "question", "answer")
        .unionByName(
            c.select(
                F.concat(F.lit("copy_"), "id").alias("id"), F.lit("chunk_copy").alias("chunk_id"),
                F.lower("question").alias("question"), F.concat(F.lit(" "), "answer", F.lit("!")).alias("answer"),
            )
        )
        .unionByName(
            f.select(
                F.concat(F.lit("faqcopy_"), "id").alias("id"), F.lit("chunk_copy").alias("chunk_id"),
                F.concat("question", F.lit("?")).alias("question"), "answer",
            )
        )
    )


@query(
    "dedupe_exact",
    f"""SELECT c.id, min(r.id) AS target_id FROM (SELECT *, {sql_signature('question', 'answer')} AS sig FROM dd_candidates) c
    JOIN (SELECT *, {sql_signature('question', 'answer')} AS sig FROM dd_refs) r ON r.sig = c.sig AND coalesce(r.chunk_id, '') <> c.chunk_id GROUP BY c.id""",
)
def dedupe_exact(t: Tables) -> DataFrame:
    return dd.exact_matches(dd_candidates(t), dd_refs(t))


@query("dedupe_near")
def dedupe_near(t: Tables) -> DataFrame:
    return dd.near_matches(dd_candidates(t), dd_refs(t))


@query(
    "doc_dedupe_exact",
    """SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS root, count(*) OVER (PARTITION BY s) AS copies FROM (SELECT doc_id, sha256(text) AS s FROM documents)""",
)
def doc_dedupe_exact(t: Tables) -> DataFrame:
    """Copies by text hash; the aggregate combines map-side, rows only look their root up."""
    hashed = t.raw("documents").select("doc_id", F.sha2("text", 256).alias("s"))
    roots = hashed.groupBy("s").agg(F.min("doc_id").alias("root"), F.count(F.lit(1)).alias("copies"))
    return hashed.join(roots, "s").select("doc_id", "root", "copies")


@query(
    "doc_dedupe_near",
    r"""WITH RECURSIVE words AS (
      SELECT doc_id, list_filter(string_split_regex(lower(text), '[\s\x0B\p{Z}]+'), lambda w: w <> '') AS w
      FROM documents WHERE text IS NOT NULL),
    sets AS MATERIALIZED (
      SELECT doc_id, list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
      FROM words WHERE len(w) > 0),
    each AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS x FROM sets),
    alike AS MATERIALIZED (
      SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
    edges AS MATERIALIZED (
      SELECT a, b FROM alike UNION SELECT b, a FROM alike
      UNION SELECT x.doc_id, y.doc_id FROM documents x JOIN documents y ON x.text = y.text),
    reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a)
    SELECT id AS doc_id, min(other) AS root FROM reach JOIN documents d ON d.doc_id = id AND d.text IS NOT NULL GROUP BY id""",
)
def doc_dedupe_near(t: Tables) -> DataFrame:
    docs = t.raw("documents").select(F.col("doc_id").alias("id"), "text")
    # equal texts fold to one representative before any banding
    hashed = docs.withColumn("s", F.sha2("text", 256))
    folded = hashed.groupBy("s").agg(F.min("id").alias("first"))
    kept = docs.join(folded.select(F.col("first").alias("id")), "id", "left_semi")
    _, roots = dd.near_classes(kept.select("id", F.col("text").alias("body")))
    return hashed.select("id", "s").join(folded, "s").join(roots.toDF("first", "root"), "first").select(
        F.col("id").alias("doc_id"), "root"
    )


# --- model-assisted steps -------------------------------------------------------------------------


@query("embed_backlog")
def embed_backlog(t: Tables) -> DataFrame:
    """Pending and stale FAQ texts through the embedder, committed where the text is still current."""
    from loreframe.operators.knowledge import faq_knowledge_rows

    waiting = t.faq_documents.filter(F.col("embedding_status").isin("pending", "stale", "failed"))
    rows = faq_knowledge_rows(waiting).select("id", "embedding_text", "content_hash")
    done = md.embed_rows(rows, "embedding_text")
    return done.join(rows.select("id", "content_hash"), "id").select(
        "id", "embedding_model", "embedding_dimensions", F.size("embedding").alias("size"), "embedding_error", "content_hash"
    )


def rerank_pairs(t: Tables) -> tuple[DataFrame, DataFrame]:
    candidates = fused(t).select("query_id", "id", "rank")
    pairs = (
        candidates.join(t.knowledge_chunks.select("id", "content"), "id")
        .join(t.queries.select("query_id", "query"), "query_id")
        .withColumn("index", F.col("rank") - 1)
    )
    return candidates, pairs


@query("rerank_scores")
def rerank_scores(t: Tables) -> DataFrame:
    candidates, pairs = rerank_pairs(t)
    return rt.rerank_merge(candidates, md.rerank_scores(pairs), TOP_K)


def question_answers(t: Tables) -> DataFrame:
    """Stored model answers, some fenced, some broken."""
    d = F.col("doc_id")
    w = F.split("text", " ")
    body = F.to_json(F.struct(F.array(F.concat(F.lit(" "), F.get(w, F.lit(0))), F.get(w, F.lit(0)), F.lit(" "), F.get(w, F.lit(1)), F.get(w, F.lit(2))).alias("questions")))
    answer = F.when(d % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(d % 3 == 1, body).otherwise(F.lit("no json"))
    return t.raw("documents").select(F.concat(F.lit("chunk_"), d.cast("string")).alias("id"), answer.alias("answer"))


_QWORDS = f"list_filter([{strip('w[1]')}, {strip('w[2]')}, {strip('w[3]')}], lambda x: x <> '')"


@query(
    "parse_questions",
    f"""SELECT 'chunk_' || doc_id AS id, CASE WHEN doc_id % 3 = 2 THEN '' ELSE array_to_string(list_filter(list_transform(range(1, len(l) + 1),
      lambda i: CASE WHEN list_position(l, l[i]) = i THEN l[i] END), lambda x: x IS NOT NULL), '|') END AS questions
    FROM (SELECT doc_id, {_QWORDS} AS l FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))""",
)
def parse_questions(t: Tables) -> DataFrame:
    return question_answers(t).select("id", F.array_join(md.parse_questions(F.col("answer")), "|").alias("questions"))


def candidate_answers(t: Tables) -> DataFrame:
    f = t.faq_documents
    good = F.struct("question", "answer", "category", "tags", F.lit(None).cast("string").alias("confidence"))
    blank = F.struct(
        "question", F.lit(" ").alias("answer"), "category", "tags", F.lit("high").alias("confidence")
    )
    body = F.to_json(F.struct(F.array(good, blank).alias("candidates")))
    return f.select(F.concat(F.lit("chunk_"), "item_id").alias("chunk_id"), F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("answer"))


@query(
    "parse_candidates",
    f"""SELECT 'chunk_' || item_id AS chunk_id, 0 AS n, {strip('question')} AS question, {strip('answer')} AS answer, category, 'medium' AS confidence
    FROM faq_documents WHERE {strip('answer')} <> '' AND {strip('question')} <> ''""",
)
def parse_candidates(t: Tables) -> DataFrame:
    return md.parse_candidates(candidate_answers(t)).select("chunk_id", "n", "question", "answer", "category", "confidence")


@query("candidate_create")
def candidate_create(t: Tables) -> DataFrame:
    """Parsed candidates with their duplicate level against FAQs and other candidates."""
    found = md.parse_candidates(candidate_answers(t)).withColumn(
        "id", F.concat_ws("_", F.lit("cand"), "chunk_id", F.col("n").cast("string"))
    )
    near = dd.near_matches(found.select("id", "chunk_id", "question", "answer"), dd_refs(t))
    return found.join(near, "id").select(
        "id", "chunk_id", "question", "answer", "confidence", F.col("level").alias("duplicate_level"),
        F.col("score").alias("duplicate_score"), F.col("target_id").alias("duplicate_target"),
    )


@query(
    "parse_suggestions",
    f"""SELECT id, {strip('question')} AS question, {strip('answer')} AS answer, CASE WHEN item_id % 4 = 1 THEN 'missing reason' END AS reject FROM faq_documents""",
)
def parse_suggestions(t: Tables) -> DataFrame:
    """Rewrite answers need question, answer and reason."""
    f = t.faq_documents
    reply = F.to_json(F.struct("question", "answer", F.when(F.col("item_id") % 4 != 1, F.lit("clearer")).alias("reason")))
    stored = f.select("id", F.concat(F.lit("```json\n"), reply, F.lit("\n```")).alias("reply"))
    body = md.fenced_object(F.col("reply"))
    fields = ["question", "answer", "reason"]
    missing = F.array_except(F.array(*[F.lit(x) for x in fields]), F.json_object_keys(body))
    parsed = F.from_json(body, "question string, answer string, reason string")
    return stored.select(
        "id", tx.strip(parsed["question"]).alias("question"), tx.strip(parsed["answer"]).alias("answer"),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))).alias("reject"),
    )


@query(
    "intent_with_fallback",
    """SELECT id, CASE WHEN intent = 'faq_exact' AND n % 3 = 0 THEN 'procedure' WHEN intent = 'faq_exact' AND n % 3 = 1 THEN 'faq_exact' ELSE intent END AS intent,
    CASE WHEN intent = 'faq_exact' AND n % 3 = 0 THEN 'low' WHEN intent = 'faq_exact' THEN 'medium' ELSE 'high' END AS confidence,
    intent = 'faq_exact' AND n % 3 < 1 AS from_model FROM (SELECT id, intent, CAST(substr(id, 2) AS BIGINT) AS n FROM intent_rows)""",
)
def intent_with_fallback(t: Tables) -> DataFrame:
    asked = intent_questions(t)
    rules = asked.select("id", tx.query_intent(F.col("question")).alias("a")).select("id", "a.intent", "a.confidence")
    n = F.expr("substring(id, 2)").cast("long")
    answer = (
        F.when(n % 3 == 0, F.lit('{"intent": "procedure", "confidence": "low"}'))
        .when(n % 3 == 1, F.lit('{"intent": "made_up"}'))
        .otherwise(F.lit("sorry"))
    )
    return md.intent_with_fallback(rules, asked.select("id", answer.alias("answer")))


@query(
    "parse_clusters",
    """SELECT event_type AS cluster_label, count(*) AS event_count, min(lower(trim(query))) AS first_sample FROM query_events q JOIN events e ON e.event_id = q.id
    WHERE hit_count = 0 GROUP BY event_type""",
)
def parse_clusters(t: Tables) -> DataFrame:
    """A stored theme answer per intent, parsed back to rows."""
    e = t.query_events.filter("hit_count = 0")
    per = e.groupBy(F.col("intent").alias("label")).agg(
        F.count(F.lit(1)).alias("event_count"), F.min(F.lower(F.trim("query"))).alias("sample")
    )
    reply = per.select(
        F.to_json(F.struct(F.array(F.struct("label", "event_count", F.array("sample").alias("samples"))).alias("clusters"))).alias("reply")
    )
    parsed = F.from_json(F.get_json_object(md.fenced_object(F.col("reply")), "$.clusters"), "array<struct<label:string,event_count:bigint,samples:array<string>>>")
    return reply.select(F.explode(parsed).alias("c")).select(
        F.col("c.label").alias("cluster_label"), "c.event_count", F.get("c.samples", F.lit(0)).alias("first_sample")
    )


def kg_responses(t: Tables) -> DataFrame:
    """Extraction answers per document: all its entities, each related to the next one.

    Some have an extra field, a bad type or a moved excerpt; in some the last entity is named only as the
    end of a relation.
    """
    e = t.map_entities
    n = F.col("chunk_order")
    entity = F.struct(
        "name",
        F.when(n % 23 == 5, F.lit("planet")).otherwise(F.col("entity_type")).alias("entity_type"),
        "aliases", "description", "confidence",
        F.array(F.struct(F.when(n % 29 == 3, F.lit("not in the text #")).otherwise(F.col("excerpt")).alias("excerpt"))).alias("evidence"),
    )
    rows = F.transform(F.sort_array(F.collect_list(F.struct("pos", entity.alias("e")))), lambda x: x["e"])
    per = e.groupBy("job_id", "chunk_order").agg(rows.alias("all"))
    kinds = F.array(F.lit("belongs_to"), F.lit("requires"), F.lit("causes"))
    related = F.zip_with(
        F.slice("all", F.lit(1), F.size("all") - 1),
        F.filter("all", lambda _, i: i > 0),
        lambda a, b: F.struct(
            a["name"].alias("head"), a["entity_type"].alias("head_type"),
            F.get(kinds, (F.length(b["name"]) % 3).cast("int")).alias("relation_type"),
            b["name"].alias("tail"), b["entity_type"].alias("tail_type"),
            F.concat(a["name"], F.lit(" - "), b["name"]).alias("description"), a["confidence"].alias("confidence"),
            F.array(F.struct(b["name"].alias("excerpt"))).alias("evidence"),
        ),
    )
    ended = (n % 4 == 1) & (F.size("all") > 1)
    per = per.withColumn("relations", F.when(F.size("all") > 1, related).otherwise(F.slice(related, 1, 0))).withColumn(
        "entities", F.when(ended, F.slice("all", F.lit(1), F.size("all") - 1)).otherwise(F.col("all"))
    )
    body = F.to_json(F.struct("entities", "relations", F.when(n % 31 == 7, F.lit(1)).alias("note")))
    docs = t.raw("documents").select(F.col("doc_id").alias("chunk_order"), F.col("text").alias("source_text"))
    return per.select("job_id", "chunk_order", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("answer")).join(docs, "chunk_order")


@query("kg_parse")
def kg_parse(t: Tables) -> DataFrame:
    from loreframe.operators.extraction import parse_extractions

    return parse_extractions(kg_responses(t))
