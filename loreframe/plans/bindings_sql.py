"""The canonical tables once more as SQL text for the oracle, and a small composer.

``compose(body)`` prefixes a query with the bindings it mentions (and the ones those mention).
"""

from __future__ import annotations

import re

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NOW = "TIMESTAMP '2024-01-31 00:00:00'"
TYPES = (
    "['product_platform_module','feature_ui_action','error_symptom','process_task_object',"
    "'role_permission_channel','condition_policy']"
)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def compact(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def secs(x: str) -> str:
    return f"{NOW} - to_seconds(CAST({x} AS BIGINT))"


_Q = "CASE WHEN strpos(text, '.') > 0 THEN substr(text, 1, strpos(text, '.')) ELSE text END"
_A = "CASE WHEN strpos(text, '.') > 0 THEN trim(substr(text, strpos(text, '.') + 1)) ELSE '' END"


def _node(table, prefix, key, name, kind, description):
    return f"""SELECT 'kg_ent_{prefix}' || {key} AS id, {name} AS name, '{kind}' AS entity_type,
      [lower({name})] AS aliases, {description} AS description,
      CASE WHEN {key} % 13 = 0 THEN 'disabled' WHEN {key} % 11 = 0 THEN 'needs_review'
           ELSE 'usable' END AS status,
      0.5::DOUBLE + ({key} % 5) / 10.0::DOUBLE AS confidence,
      CAST({key} % 3 AS BIGINT) AS review_revision,
      {secs(key)} AS updated_at, CAST({key} AS BIGINT) AS key FROM {table}"""


def _edge(source, prefix, x, y, head, tail, kind):
    return f"""SELECT 'kg_rel_{prefix}' || {x} || '_' || {y} AS id,
      'kg_ent_{head}' || {x} AS head_entity_id, '{kind}' AS relation_type,
      'kg_ent_{tail}' || {y} AS tail_entity_id, '{kind} ' || ({x} % 10) AS description,
      CASE WHEN ({x} + {y}) % 7 = 0 THEN 'needs_review' ELSE 'usable' END AS status,
      0.5::DOUBLE + (({x} + {y}) % 5) / 10.0::DOUBLE AS confidence,
      CAST(({x} + {y}) % 3 AS BIGINT) AS review_revision,
      {secs(f'({x} * 7 + {y}) % 86400')} AS updated_at FROM {source}"""


BINDINGS: dict[str, str] = {
    "query_events_k": """SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
      event_type || ' item ' || (CAST(json_extract(props, '$.k') AS BIGINT) % 25) AS q FROM events""",
    "query_events": """SELECT event_id AS id, ts AS created_at,
      CASE WHEN k % 2 = 1 THEN '  ' || upper(q) || ' ' ELSE q END AS query, event_type AS intent,
      k % 4 AS hit_count, CASE WHEN k % 4 > 0 THEN least(value / 100, 1.0) END AS top_score,
      list_transform(range(0, k % 4), lambda i: 'kc_' || ((k + 7 * i) % 100))
        || (CASE WHEN k % 10 = 0 THEN [''] ELSE [] END) AS retrieved_chunk_ids,
      k % 2 = 0 AS rerank_used, CAST(floor(value * 10) AS BIGINT) AS latency_ms,
      CASE WHEN user_id % 2 = 0 THEN 'mcp' ELSE 'web' END AS requester_type,
      CASE WHEN user_id % 11 = 0 THEN '  ' ELSE CAST(user_id AS VARCHAR) END AS requester_id
      FROM query_events_k""",
    "import_files": f"""SELECT source AS id, source || '.md' AS original_name,
      'markdown' AS file_type, 'markdown_chat' AS parser,
      CASE WHEN source LIKE '%3' THEN 'manual' ELSE 'naive' END AS chunker_type,
      'needs_review' AS status, source = 'src7' AS is_disabled, {secs('max(doc_id)')} AS updated_at
      FROM documents GROUP BY source""",
    "import_chunks": """SELECT 'chunk_' || d.doc_id AS id, d.source AS file_id,
      d.doc_id AS chunk_index, d.text AS source_text,
      CASE d.doc_id % 7 WHEN 3 THEN '`. `\\n' WHEN 5 THEN '' ELSE '\\n' END AS children_delimiter,
      CASE WHEN d.doc_id % 11 = 4 THEN [
        {'text': '  ' || d.text || ' ', 'section_title': 'A > ' || d.lang, 'page_number': CAST(d.doc_id % 9 AS INTEGER), 'block_type': CAST(NULL AS VARCHAR)},
        {'text': '   ', 'section_title': 'B', 'page_number': 1, 'block_type': 'text'},
        {'text': d.source, 'section_title': NULL, 'page_number': NULL, 'block_type': 'table'}] ELSE [] END AS source_blocks,
      [d.lang] AS section_path,
      CASE WHEN d.doc_id % 4 <> 0 THEN CAST(d.doc_id % 50 + 1 AS INT) END AS page_start,
      CASE WHEN d.doc_id % 4 > 1 THEN CAST(d.doc_id % 50 + 2 AS INT) END AS page_end,
      'text' AS block_type, [d.source, d.lang] AS keywords,
      CASE WHEN d.doc_id % 5 = 0 THEN ['What is in ' || d.source || '?'] ELSE [] END AS questions,
      CASE WHEN l.quality = 0 THEN 'needs_review' ELSE 'usable' END AS retrieval_status,
      CASE WHEN d.doc_id % 3 = 0 THEN 'generated' ELSE 'pending' END AS status,
      coalesce(l.toxic = 1, false) AS is_disabled
      FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "document_chunk_rows": f"""SELECT 'kc_' || d.doc_id AS id, 'document' AS source_type,
      d.source AS source_id, 'chunk_' || d.doc_id AS source_chunk_id, 'child' AS chunk_level,
      d.source || '.md' AS source_title, d.text AS content,
      d.source || '.md' || chr(10) || d.lang || chr(10) || d.text AS search_text,
      CASE WHEN l.quality = 0 THEN 'needs_review' ELSE 'usable' END AS status,
      CASE WHEN d.doc_id % 17 = 0 THEN 'stale' ELSE 'ready' END AS embedding_status,
      {secs('d.doc_id')} AS updated_at, e.embedding
      FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
      LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "faq_documents": f"""SELECT 'faq_' || item_id AS id, {_Q} AS question,
      CASE WHEN item_id % 2 = 0 THEN [lower({_Q})] ELSE [] END AS question_variants,
      {_A} AS answer,
      CASE item_id % 4 WHEN 1 THEN 'billing' WHEN 2 THEN 'report' WHEN 3 THEN 'account' END AS category,
      string_split(text, ' ')[1:2] AS tags, ['high','medium','low'][item_id % 3 + 1] AS confidence,
      CASE item_id % 5 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'disabled' ELSE 'usable' END AS status,
      ['ready','stale','pending'][item_id % 3 + 1] AS embedding_status,
      {secs('item_id * 60')} AS updated_at, {secs('item_id * 3600')} AS created_at, item_id
      FROM benchmark""",
    "faq_chunk_rows": """SELECT 'kc_faq_' || id AS id, 'faq' AS source_type, id AS source_id,
      CAST(NULL AS VARCHAR) AS source_chunk_id, 'chunk' AS chunk_level, question AS source_title,
      '问题：' || question || chr(10) || '答案：' || answer AS content,
      concat_ws(chr(10), question, nullif(answer, ''), category) AS search_text,
      status, embedding_status, updated_at, embedding
      FROM faq_documents LEFT JOIN embeddings ON vec_id = item_id""",
    "knowledge_chunks": "SELECT * FROM document_chunk_rows UNION ALL SELECT * FROM faq_chunk_rows",
    "queries": """SELECT vec_id AS query_id,
      array_to_string(string_split(text, ' ')[1:3], ' ') AS query, embedding AS query_embedding
      FROM embeddings JOIN documents ON doc_id = vec_id""",
    "retrieval_aliases": f"""SELECT 'alias_' || item_id AS id,
      lower(string_split(text, ' ')[1]) AS canonical, string_split(text, ' ')[2:3] AS aliases,
      CASE WHEN item_id % 4 = 0 THEN 'disabled' ELSE 'active' END AS status,
      {secs('item_id')} AS updated_at FROM benchmark""",
    "import_candidates": f"""SELECT 'cand_' || u.conv_id || '_' || u.turn AS id,
      'chunk_' || u.conv_id AS chunk_id, u.text AS question, a.text AS answer,
      CASE (u.conv_id + u.turn) % 4 WHEN 0 THEN 'saved' WHEN 1 THEN 'ignored' ELSE 'pending' END AS status,
      {secs('u.conv_id * 100 + u.turn')} AS created_at
      FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
      WHERE u.role = 'user' AND a.role = 'assistant'""",
    "job_items": """SELECT 'job_' || source AS job_id, 'chunk_' || doc_id AS chunk_id,
      ['queued','processing','generated','skipped','failed'][doc_id % 5 + 1] AS status FROM documents""",
    "parse_jobs": f"""SELECT 'pj_' || doc_id AS id, source AS file_id,
      ['completed','failed','queued','processing','completed'][doc_id % 5 + 1] AS status,
      '{{"extracted_pages": ' || (doc_id % 13) || ', "total_pages": ' || (doc_id % 9) || '}}' AS progress,
      {secs('(doc_id * 37 % 1000) * 60')} AS created_at,
      {secs('(doc_id * 37 % 1000) * 60 - 30')} AS next_attempt_at FROM documents""",
    "kg_jobs": f"""SELECT 'kgj_' || doc_id AS id, 'document' AS source_type, source AS source_id,
      ['completed','failed','completed','queued','completed','failed','completed'][doc_id % 7 + 1] AS status,
      {secs('(doc_id * 53 % 1000) * 60')} AS created_at FROM documents""",
    "kg_job_items": """SELECT 'kgjob_' || source AS job_id, source AS file_id,
      'chunk_' || doc_id AS chunk_id, doc_id AS chunk_order,
      CASE WHEN doc_id % 29 = 0 THEN sha256('old ' || text) ELSE sha256(text) END AS source_fingerprint,
      CASE WHEN doc_id % 31 = 0 THEN ['moved'] ELSE [lang] END AS section_path,
      CASE WHEN doc_id % 20 < 10 OR doc_id % 3 <> 0 THEN 'mapped' ELSE 'queued' END AS status
      FROM documents""",
    "chat_messages": """SELECT user_id AS channel, event_id AS pos,
      date_trunc('minute', ts)::TIMESTAMP AS sent_at,
      CASE WHEN event_type = 'signup' THEN '[系统]' ELSE event_type END AS speaker,
      CASE WHEN event_type = 'view' THEN '收到'
           WHEN event_type = 'error' THEN '退款 报告 ' || json_extract_string(props, '$.k')
           ELSE event_type || ' ' || json_extract_string(props, '$.k') END AS content FROM events""",
    "kg_entities": " UNION ALL ".join(
        [
            _node("region", "r", "r_regionkey", "r_name", "product_platform_module", "''"),
            _node("nation", "n", "n_nationkey", "n_name", "role_permission_channel", "''"),
            _node("supplier", "s", "s_suppkey", "s_name", "process_task_object", "''"),
            _node("part", "p", "p_partkey", "p_name", "feature_ui_action", "p_type"),
        ]
    ),
    "kg_relations": " UNION ALL ".join(
        [
            _edge("nation", "n", "n_nationkey", "n_regionkey", "n", "r", "belongs_to"),
            _edge("supplier", "s", "s_suppkey", "s_nationkey", "s", "n", "belongs_to"),
            _edge(
                "(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)",
                "p", "l_partkey", "l_suppkey", "p", "s", "available_for",
            ),
        ]
    ),
    "kg_evidence": f"""SELECT concat_ws('_', 'kg_ev_l', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
      CAST(NULL AS VARCHAR) AS entity_id, 'kg_rel_p' || l_partkey || '_' || l_suppkey AS relation_id,
      'document' AS source_type, 'src' || (l_orderkey % 20) AS source_id,
      'chunk_' || (l_orderkey % 1000) AS source_chunk_id, 'line ' || l_linenumber AS excerpt,
      CAST(l_linenumber AS BIGINT) AS char_start,
      CAST(l_linenumber + length('line ' || l_linenumber) AS BIGINT) AS char_end,
      l_shipdate AS created_at FROM lineitem
      UNION ALL
      SELECT 'kg_ev_' || id, id, NULL, 'faq', 'faq_' || (key % 40), NULL, name, 0,
      CAST(length(name) AS BIGINT), {secs('key')} FROM kg_entities""",
    "map_words": """SELECT doc_id, source, text, lang, list_transform(list_filter(
        list_transform(range(1, len(a) + 1), lambda i: {'i': i, 'w': a[i]}),
        lambda x: list_position(a, x.w) = x.i), lambda x: x.w) AS w
      FROM (SELECT *, regexp_extract_all(text, '[A-Z][a-z]+') AS a FROM documents)""",
    "map_entities": f"""SELECT 'kgjob_' || source AS job_id, doc_id AS chunk_order,
      CAST(pos - 1 AS BIGINT) AS pos, name, {TYPES}[length(name) % 6 + 1] AS entity_type,
      [lower(name), upper(name)] AS aliases, name || ' in ' || source AS description,
      0.5::DOUBLE + (doc_id % 5) / 10.0::DOUBLE AS confidence, name AS excerpt,
      CAST(strpos(text, name) - 1 AS BIGINT) AS char_start,
      CAST(strpos(text, name) - 1 + length(name) AS BIGINT) AS char_end
      FROM (SELECT doc_id, source, text, unnest(w) AS name, unnest(range(1, len(w) + 1)) AS pos
            FROM map_words)""",
    "map_relations": f"""SELECT 'kgjob_' || source AS job_id, doc_id AS chunk_order,
      w[i] AS head_name, {TYPES}[length(w[i]) % 6 + 1] AS head_type,
      ['belongs_to','requires','causes'][(doc_id + i - 1) % 3 + 1] AS relation_type,
      w[i + 1] AS tail_name, {TYPES}[(length(w[i + 1]) + CASE WHEN (doc_id + i - 1) % 13 = 7 THEN 1 ELSE 0 END) % 6 + 1] AS tail_type,
      w[i] || ' - ' || w[i + 1] AS description,
      0.5::DOUBLE + (doc_id % 5) / 10.0::DOUBLE AS confidence
      FROM (SELECT *, unnest(range(1, len(w))) AS i FROM map_words)""",
    "eval_cases": f"""SELECT 'case_' || query_id AS id, query_id, query AS question,
      CASE WHEN query_id % 6 = 5 THEN CAST([] AS VARCHAR[])
           WHEN query_id % 7 = 0 THEN ['src' || (query_id % 20)]
           ELSE ['kc_' || query_id, 'kc_' || (query_id + 1), 'kc_kg_entity_' || query_id]
           END AS expected_source_ids,
      CASE WHEN query_id % 5 = 4 THEN 'disabled' ELSE 'active' END AS status,
      {secs('query_id')} AS updated_at FROM queries""",
    "eval_runs": f"""SELECT concat_ws('_', 'run', vec_id, s, n) AS id, 'case_' || vec_id AS case_id,
      CASE WHEN s = 1 THEN 'retrieval_hybrid_v1' ELSE 'retrieval_hybrid_v1_kg_debug' END AS strategy,
      CASE WHEN vec_id % 9 = 0 THEN 1 ELSE 2 END AS contract_version,
      CASE WHEN vec_id % 8 = 1 THEN CAST([] AS VARCHAR[])
           ELSE list_transform(range(0, 5), lambda i: 'kc_' || (vec_id + n * s - 2 + i)) END AS retrieved_ids,
      'src' || (vec_id % 20) AS retrieved_source,
      {secs('vec_id * 10 + n * CASE WHEN vec_id % 2 = 0 THEN 3 ELSE -3 END')} AS created_at
      FROM (SELECT vec_id, unnest([1, 2]) AS s FROM embeddings) CROSS JOIN (SELECT unnest([1, 2]) AS n)
      WHERE NOT (vec_id % 10 = 3 AND s = 2)""",
}


def register(name: str, body: str) -> None:
    """Add a shared intermediate (for example the live rows) to the bindings."""
    BINDINGS[name] = body


def _needed(text: str) -> list[str]:
    order: list[str] = []

    def visit(body: str) -> None:
        words = set(re.findall(r"\b[a-z_0-9]+\b", body))
        for name in BINDINGS:
            if name in words and name not in order:
                visit(BINDINGS[name])
                if name not in order:
                    order.append(name)

    visit(text)
    return order


def compose(body: str) -> str:
    """Full oracle SQL: the bindings a body needs, then the body (which may begin with WITH)."""
    body = body.strip()
    names = [n for n in _needed(body)]
    own = re.match(r"(?is)^with\s+(recursive\s+)?", body)
    parts = [f"{n} AS ({BINDINGS[n]})" for n in names]
    if own:
        rest = body[own.end():]
        start = "WITH RECURSIVE " if own[1] else "WITH "
        return start + ",\n".join([*parts, rest]) if parts else body
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body
