"""Scalar functions shown over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loreframe.functions import text as tx
from loreframe.functions.constants import (
    CONTENT_TYPES, EVAL_CONTRACT, INTENTS, LOW_VALUE_CONTENTS, LOW_VALUE_SPEAKER,
    PAGE_CHROME_TYPES, SKIP_SECTION_PATTERN,
)
from loreframe.plans.bindings_sql import WS, compact, register, strip
from loreframe.plans.registry import query
from loreframe.sources.tables import Tables



class _Items:
    """Oracle text for a cleaned list; ``format`` takes the list expression."""

    @staticmethod
    def format(expr: str) -> str:
        return f"list_filter(list_transform({expr}, lambda x: {strip('x')}), lambda x: x <> '')"


ITEMS = _Items


def joined(name: str):
    return F.array_join(name, "|").alias(name)


@query("text_normalise", f"SELECT doc_id, {compact('text')} AS text FROM documents")
def text_normalise(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", tx.compact(F.col("text")).alias("text"))


@query(
    "text_truncate",
    f"""SELECT doc_id, CASE WHEN length(c) > 120 THEN regexp_replace(substr(c, 1, 117), '{WS}+$', '') || '...'
    ELSE c END AS text FROM (SELECT doc_id, {compact('text')} AS c FROM documents)""",
)
def text_truncate(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", tx.truncate(F.col("text"), 120).alias("text"))


@query(
    "clean_list",
    f"""SELECT item_id, 'csv' AS form, array_to_string({ITEMS.format("string_split(text, ',')")}, '|') AS items FROM benchmark
      UNION ALL SELECT item_id, 'json', array_to_string({ITEMS.format("string_split(text, ' ')[1:2]")}, '|') FROM benchmark""",
)
def clean_list(t: Tables) -> DataFrame:
    words = F.split("text", " ")
    js = F.to_json(F.array(F.concat(F.lit(" "), F.get(words, F.lit(0))), F.get(words, F.lit(1)), F.lit(" ")))
    b = t.raw("benchmark")
    both = b.select("item_id", F.lit("csv").alias("form"), F.col("text").alias("body")).unionByName(
        b.select("item_id", F.lit("json").alias("form"), js.alias("body"))
    )
    return both.select("item_id", "form", F.array_join(tx.clean_list(F.col("body")), "|").alias("items"))


@query(
    "split_list",
    f"""SELECT doc_id, array_to_string({ITEMS.format("regexp_split_to_array(text, '[,，' || chr(10) || '；;]')")}, '|') AS items
    FROM documents""",
)
def split_list(t: Tables) -> DataFrame:
    return t.raw("documents").select(
        "doc_id", F.array_join(tx.split_list(F.col("text")), "|").alias("items")
    )


@query(
    "safe_int",
    """SELECT event_id, TRY_CAST(raw AS BIGINT) AS value FROM (SELECT event_id,
    CASE WHEN event_id % 3 = 0 THEN event_type ELSE json_extract_string(props, '$.k') END AS raw FROM events)""",
)
def safe_int(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(
        F.get_json_object("props", "$.k")
    )
    return t.raw("events").select("event_id", tx.safe_int(raw).alias("value"))


def _any(c: str, words: str) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words.split("/")) + ")"


register(
    "intent_rows",
    f"""SELECT id, CASE
      WHEN {_any('lower(c)', 'api key/apikey/secret/access token/system prompt/系统提示词/密钥/数据库密码/微信 token/后台密码')} THEN 'sensitive_or_forbidden'
      WHEN {_any('c', '现在/当前/实时/到哪一步/处理到哪/有没有完成/是否完成/进度')} AND {_any('c', '状态/报告/订单/账号/后台/生成/处理')} THEN 'realtime_status'
      WHEN {_any('c', '怎么办/无法/不能/失败/报错/没有生成/没生成/打不开/登不上/异常')} THEN 'troubleshooting'
      WHEN {_any('c', '怎么/如何/步骤/流程/操作/在哪里/导出/上传/配置')} THEN 'procedure'
      WHEN c IN ('你好','您好','谢谢','感谢','在吗') THEN 'chitchat_or_out_of_scope'
      ELSE 'faq_exact' END AS intent
    FROM (SELECT 'e' || event_id AS id, CASE event_type WHEN 'error' THEN '当前报告 ' || json_extract_string(props, '$.k')
        WHEN 'click' THEN '无法登录' WHEN 'view' THEN '如何导出' WHEN 'signup' THEN ' 你好 '
        ELSE 'item ' || event_id END AS c0 FROM events
      UNION ALL SELECT 'd' || doc_id, text FROM documents) x, LATERAL (SELECT {compact('c0')} AS c) y""",
)
_INTENT_SQL = """SELECT id, intent, CASE intent WHEN 'faq_exact' THEN 'medium' ELSE 'high' END AS confidence,
  CASE intent WHEN 'sensitive_or_forbidden' THEN '' WHEN 'chitchat_or_out_of_scope' THEN ''
    WHEN 'procedure' THEN 'document|faq' ELSE 'faq|document' END AS preferred_sources,
  intent = 'realtime_status' AS must_not_answer_realtime,
  CASE intent WHEN 'sensitive_or_forbidden' THEN 'refuse' WHEN 'chitchat_or_out_of_scope' THEN 'smalltalk'
    ELSE 'answer_with_retrieval' END AS safety_action FROM intent_rows"""


def intent_questions(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    asked = t.raw("events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("当前报告 "), k))
        .when(F.col("event_type") == "click", "无法登录")
        .when(F.col("event_type") == "view", "如何导出")
        .when(F.col("event_type") == "signup", " 你好 ")
        .otherwise(F.concat(F.lit("item "), F.col("event_id").cast("string")))
        .alias("question"),
    )
    return asked.unionByName(
        t.raw("documents").select(
            F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("question")
        )
    )


@query("query_intent", _INTENT_SQL)
def query_intent(t: Tables) -> DataFrame:
    return (
        intent_questions(t)
        .select("id", tx.query_intent(F.col("question")).alias("a"))
        .select(
            "id", "a.intent", "a.confidence",
            F.array_join("a.preferred_sources", "|").alias("preferred_sources"),
            "a.must_not_answer_realtime", "a.safety_action",
        )
    )


@query(
    "chat_keywords",
    """SELECT pos, array_to_string(list_slice(list_filter(['退款','退货','签收','账号','密码','后台','报告',
    '生成','下载','派发','测评','发票','地址'], lambda w: contains(content, w)), 1, 4), '|') AS keywords FROM chat_messages""",
)
def chat_keywords(t: Tables) -> DataFrame:
    return t.chat_messages.select(
        "pos", F.array_join(tx.chat_keywords(F.col("content")), "|").alias("keywords")
    )


@query(
    "chat_low_value",
    """SELECT channel, pos, content FROM chat_messages WHERE speaker <> '[系统]'
    AND trim(content) NOT IN ('收到','好的','好','👌','[表情]','[图片]')""",
)
def chat_low_value(t: Tables) -> DataFrame:
    from loreframe.operators.chat import drop_low_value

    return drop_low_value(t.chat_messages).select("channel", "pos", "content")


FAQ_TEXT = f"""concat_ws(chr(10), '标准问题：' || {strip('question')},
  CASE WHEN len(question_variants) > 0 THEN '相似问法：' || array_to_string({ITEMS.format('question_variants')}, '；') END,
  '答案：' || {strip('answer')}, '分类：' || category,
  CASE WHEN len({ITEMS.format('tags')}) > 0 THEN '标签：' || array_to_string({ITEMS.format('tags')}, '，') END)"""


def faq_text(prefix: str = ""):
    c = lambda n: F.col(prefix + n)
    return tx.faq_embedding_text(
        c("question"), c("question_variants"), c("answer"), c("category"), c("tags")
    )


@query("faq_embedding_text", f"SELECT id, {FAQ_TEXT} AS embedding_text FROM faq_documents")
def faq_embedding_text(t: Tables) -> DataFrame:
    return t.faq_documents.select("id", faq_text().alias("embedding_text"))


PAGES = """CASE WHEN page_start IS NULL AND page_end IS NULL THEN ''
  WHEN page_start IS NOT NULL AND page_end IS NOT NULL AND page_start <> page_end
    THEN page_start || '-' || page_end ELSE CAST(coalesce(page_start, page_end) AS VARCHAR) END"""
DOC_TEXT = f"""concat_ws(chr(10), '文件：' || title, '章节：' || nullif(array_to_string(section_path, ' > '), ''),
  '页码：' || nullif({PAGES}, ''), '块类型：' || block_type, '关键词：' || nullif(array_to_string(keywords, '，'), ''),
  '可能问题：' || nullif(array_to_string(questions, ' / '), ''), '正文：' || body)"""


def doc_text(title, body):
    return tx.document_embedding_text(
        title, F.col("section_path"), F.col("page_start"), F.col("page_end"), F.col("block_type"),
        F.col("keywords"), F.col("questions"), body,
    )


@query(
    "doc_embedding_text",
    f"""SELECT id, {DOC_TEXT} AS embedding_text FROM (SELECT *, file_id || '.md' AS title,
    source_text AS body FROM import_chunks)""",
)
def doc_embedding_text(t: Tables) -> DataFrame:
    title = F.concat("file_id", F.lit(".md"))
    return t.import_chunks.select("id", doc_text(title, F.col("source_text")).alias("embedding_text"))


@query("content_hash", f"SELECT id, sha256({FAQ_TEXT}) AS content_hash FROM faq_documents")
def content_hash(t: Tables) -> DataFrame:
    return t.faq_documents.select("id", tx.content_hash(faq_text()).alias("content_hash"))


@query(
    "search_text",
    f"""SELECT id, array_to_string({ITEMS.format("[question] || question_variants || [answer] || [coalesce(category, '')] || tags")}, chr(10)) AS search_text
    FROM faq_documents""",
)
def search_text(t: Tables) -> DataFrame:
    return t.faq_documents.select(
        "id",
        tx.join_parts(
            tx.one(F.col("question")), F.col("question_variants"), tx.one(F.col("answer")),
            tx.one(F.col("category")), F.col("tags"),
        ).alias("search_text"),
    )


@query("page_range", f"SELECT id, {PAGES} AS pages, array_to_string(section_path, ' > ') AS section FROM import_chunks")
def page_range(t: Tables) -> DataFrame:
    return t.import_chunks.select(
        "id",
        tx.page_range(F.col("page_start"), F.col("page_end")).alias("pages"),
        F.array_join("section_path", " > ").alias("section"),
    )


FINGERPRINT = """sha256(concat_ws('|', f.id, f.original_name, f.file_type, f.parser, f.chunker_type, f.status,
  CAST(f.is_disabled AS VARCHAR), c.id, c.file_id, CAST(c.chunk_index AS VARCHAR),
  array_to_string(c.section_path, ','), coalesce(CAST(c.page_start AS VARCHAR), ''),
  coalesce(CAST(c.page_end AS VARCHAR), ''), c.block_type, c.children_delimiter,
  array_to_string(c.keywords, ','), c.source_text, c.status, array_to_string(c.questions, ','),
  CAST(c.is_disabled AS VARCHAR)))"""


def fingerprint(f: str = "f", c: str = "c"):
    """Hash over every file and chunk field that changes the projection, in a fixed order."""
    def s(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    def arr(name):
        return F.array_join(name, ",")

    return F.sha2(
        F.concat_ws(
            "|",
            *[s(f"{f}.{n}") for n in ("id", "original_name", "file_type", "parser", "chunker_type", "status", "is_disabled")],
            s(f"{c}.id"), s(f"{c}.file_id"), s(f"{c}.chunk_index"), arr(f"{c}.section_path"),
            s(f"{c}.page_start"), s(f"{c}.page_end"), s(f"{c}.block_type"), s(f"{c}.children_delimiter"),
            arr(f"{c}.keywords"), s(f"{c}.source_text"), s(f"{c}.status"), arr(f"{c}.questions"),
            s(f"{c}.is_disabled"),
        ),
        256,
    )


@query(
    "source_fingerprint",
    f"SELECT c.id, {FINGERPRINT} AS fingerprint FROM import_chunks c JOIN import_files f ON f.id = c.file_id",
)
def source_fingerprint(t: Tables) -> DataFrame:
    return (
        t.import_chunks.alias("c")
        .join(t.import_files.alias("f"), F.col("f.id") == F.col("c.file_id"))
        .select(F.col("c.id").alias("id"), fingerprint().alias("fingerprint"))
    )


def _sql_entity_id(name: str, kind: str) -> str:
    return f"'kg_ent_' || substr(sha256(lower({compact(name)}) || chr(1) || {kind}), 1, 16)"


def _sql_relation_id(h: str, r: str, t_: str) -> str:
    return f"'kg_rel_' || substr(sha256({h} || chr(1) || {r} || chr(1) || {t_}), 1, 16)"


@query(
    "kg_ids",
    f"""WITH e AS (SELECT id, {_sql_entity_id('name', 'entity_type')} AS cid FROM kg_entities)
    SELECT r.id, h.cid AS head_id, t.cid AS tail_id, {_sql_relation_id('h.cid', 'r.relation_type', 't.cid')} AS relation_id
    FROM kg_relations r JOIN e h ON h.id = r.head_entity_id JOIN e t ON t.id = r.tail_entity_id""",
)
def kg_ids(t: Tables) -> DataFrame:
    e = t.kg_entities.select("id", tx.entity_id(F.col("name"), F.col("entity_type")).alias("cid"))
    h, tl = e.toDF("head_entity_id", "head_id"), e.toDF("tail_entity_id", "tail_id")
    return (
        t.kg_relations.join(h, "head_entity_id")
        .join(tl, "tail_entity_id")
        .select(
            "id", "head_id", "tail_id",
            tx.relation_id(F.col("head_id"), F.col("relation_type"), F.col("tail_id")).alias("relation_id"),
        )
    )


@query(
    "child_index",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, -((l_orderkey + l_linenumber) * (l_orderkey + l_linenumber + 1) // 2
    + l_linenumber + 1) AS child_index FROM lineitem""",
)
def child_index(t: Tables) -> DataFrame:
    return t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        tx.child_index(F.col("l_orderkey"), F.col("l_linenumber")).alias("child_index"),
    )


@query(
    "embedding_transition",
    """SELECT id, CASE WHEN embedding_status = 'ready' AND same THEN 'ready' WHEN embedding_status = 'ready' THEN 'stale'
    WHEN embedding_status IN ('stale','failed') AND same THEN embedding_status ELSE 'pending' END AS next_status
    FROM (SELECT id, embedding_status, item_id % 4 <> 0 AS same FROM faq_documents)""",
)
def embedding_transition(t: Tables) -> DataFrame:
    text = F.col("question")
    old = F.sha2(text, 256)
    new = F.sha2(F.when(F.col("item_id") % 4 != 0, text).otherwise(F.concat(text, F.lit("!"))), 256)
    return t.faq_documents.select(
        "id", tx.embedding_transition(F.col("embedding_status"), old, new).alias("next_status")
    )


DEDUPE = (
    "regexp_replace(replace(replace(replace(replace(lower(coalesce({0}, '')), '多久到账', '需要多久'), "
    "'多久到', '需要多久'), '多长时间到账', '需要多久'), '通常', '一般'), "
    "'[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}，。！？、,.!?;；:：''\"“”‘’（）()\\[\\]【】《》<>]+', '', 'g')"
)


def sql_signature(q: str, a: str) -> str:
    return f"sha256({DEDUPE.format(q)} || '|' || {DEDUPE.format(a)})"


@query(
    "dedupe_signature",
    f"SELECT id, {sql_signature('question', 'answer')} AS signature FROM import_candidates",
)
def dedupe_signature(t: Tables) -> DataFrame:
    return t.import_candidates.select(
        "id", tx.dedupe_signature(F.col("question"), F.col("answer")).alias("signature")
    )


@query("token_count", "SELECT doc_id, length(text) AS tokens FROM documents")
def token_count(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.length("text").cast("long").alias("tokens"))


@query(
    "sentences",
    """SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, s AS sentence FROM (SELECT doc_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS pos
    FROM (SELECT doc_id, regexp_extract_all(text, '[^.。！？!?；;：:\\n]*[.。！？!?；;：:\\n]|[^.。！？!?；;：:\\n]+$') AS l FROM documents))""",
)
def sentences(t: Tables) -> DataFrame:
    return (
        t.raw("documents")
        .select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
        .withColumn("pos", F.col("pos").cast("long"))
    )


@query(
    "progress_percent",
    """SELECT id, CASE WHEN total IS NULL OR total <= 0 THEN 0 ELSE
    CAST(greatest(0, least(100, floor(done * 100 / total))) AS BIGINT) END AS percent FROM (
    SELECT id, CAST(json_extract(progress, '$.extracted_pages') AS BIGINT) AS done,
      CAST(json_extract(progress, '$.total_pages') AS BIGINT) AS total FROM parse_jobs)""",
)
def progress_percent(t: Tables) -> DataFrame:
    from loreframe.functions.jobs import progress_percent as percent

    return t.parse_jobs.select("id", percent(F.col("progress")).alias("percent"))


@query(
    "location_label",
    f"""SELECT ev.id, concat_ws(' · ', f.original_name, nullif(array_to_string(c.section_path, ' > '), ''),
      '第 ' || nullif({PAGES}, '') || ' 页', ev.source_chunk_id) AS label,
      CAST(round(0.5 * 100) AS BIGINT) || '%' AS confidence
    FROM kg_evidence ev JOIN import_chunks c ON c.id = ev.source_chunk_id AND c.file_id = ev.source_id
    JOIN import_files f ON f.id = ev.source_id WHERE ev.source_type = 'document'""",
)
def location_label(t: Tables) -> DataFrame:
    chunks = t.import_chunks.select(
        F.col("id").alias("source_chunk_id"), F.col("file_id").alias("source_id"),
        "section_path", "page_start", "page_end",
    )
    files = t.import_files.select(F.col("id").alias("source_id"), "original_name")
    pages = tx.page_range(F.col("page_start"), F.col("page_end"))
    return (
        t.kg_evidence.filter("source_type = 'document'")
        .select("id", "source_id", "source_chunk_id")
        .join(chunks, ["source_chunk_id", "source_id"])
        .join(files, "source_id")
        .select(
            "id",
            F.concat_ws(
                " · ", "original_name", F.nullif(F.array_join("section_path", " > "), F.lit("")),
                F.when(pages != "", F.concat(F.lit("第 "), pages, F.lit(" 页"))), "source_chunk_id",
            ).alias("label"),
            F.concat(F.round(F.lit(0.5) * 100).cast("long").cast("string"), F.lit("%")).alias("confidence"),
        )
    )


@query(
    "file_type",
    """SELECT name, CASE WHEN ext IN ('.md', '.markdown') THEN 'markdown' WHEN ext = '.pdf' THEN 'pdf'
    WHEN ext IN ('.xlsx', '.xls') THEN 'excel' WHEN ext = '.docx' THEN 'word' ELSE 'unknown' END AS file_type,
    CASE WHEN ext IN ('.md', '.markdown') THEN 'markdown_chat' WHEN ext IN ('.pdf', '.xlsx', '.xls', '.docx') THEN 'mineru'
    ELSE 'unsupported' END AS parser FROM (SELECT name, lower(regexp_extract(name, '(\\.[^./]+)$', 1)) AS ext FROM (
      SELECT source || '_' || doc_id || ['.MD', '.pdf', '.xls', '.docx', '', '.tar.gz', '.markdown'][doc_id % 7 + 1] AS name FROM documents))""",
)
def file_type(t: Tables) -> DataFrame:
    from loreframe.functions.jobs import file_type as kind

    suffixes = F.array(*[F.lit(s) for s in (".MD", ".pdf", ".xls", ".docx", "", ".tar.gz", ".markdown")])
    name = F.concat(
        "source", F.lit("_"), F.col("doc_id").cast("string"),
        F.element_at(suffixes, (F.col("doc_id") % 7 + 1).cast("int")),
    )
    return t.raw("documents").select(name.alias("name")).select("name", *kind(F.col("name")))


@query(
    "skip_sections",
    """SELECT doc_id, title, regexp_matches(lower(trim(title)), '^(contents\\s*$|table of contents\\s*$|list of figures\\s*$|list of tables\\s*$|rev\\.\\s*\\w+|revision\\s*history\\s*$|document\\s*history\\s*$|change\\s*history\\s*$)') AS skipped
    FROM (SELECT doc_id, ['Contents','Rev. A2','Table of Contents ','Change  History', string_split(text, ' ')[1]][doc_id % 5 + 1] AS title FROM documents)""",
)
def skip_sections(t: Tables) -> DataFrame:
    fixed = F.array(
        F.lit("Contents"), F.lit("Rev. A2"), F.lit("Table of Contents "), F.lit("Change  History"),
        F.get(F.split("text", " "), F.lit(0)),
    )
    title = F.element_at(fixed, (F.col("doc_id") % 5 + 1).cast("int"))
    return (
        t.raw("documents")
        .select("doc_id", title.alias("title"))
        .withColumn("skipped", F.lower(tx.compact(F.col("title"))).rlike(SKIP_SECTION_PATTERN))
    )


_KINDS = ["text", "title", "table", "image", "header", "page_number", "list", "equation", "chart", "paragraph"]


def typed_events(t: Tables) -> DataFrame:
    """Events read as layout items of a rotating block type."""
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    return t.raw("events").select(
        "event_id",
        F.element_at(kinds, (F.col("event_id") % 10 + 1).cast("int")).alias("block_type"),
        F.when(F.col("event_id") % 3 == 0, F.get_json_object("props", "$.k")).alias("page_idx"),
        F.get_json_object("props", "$.k").alias("level"),
    )


register(
    "typed_events",
    f"""SELECT event_id, {_KINDS}[event_id % 10 + 1] AS block_type,
    CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') END AS page_idx,
    json_extract_string(props, '$.k') AS level FROM events""",
)


@query(
    "block_type_filter",
    """SELECT event_id, block_type FROM typed_events
    WHERE block_type IN ('code','equation','equation_interline','image','list','table','text','title')""",
)
def block_type_filter(t: Tables) -> DataFrame:
    keep = F.col("block_type").isin(CONTENT_TYPES) & ~F.col("block_type").isin(PAGE_CHROME_TYPES)
    return typed_events(t).filter(keep).select("event_id", "block_type")


@query(
    "block_fields",
    """SELECT event_id, TRY_CAST(page_idx AS BIGINT) + 1 AS page_number,
    greatest(1, coalesce(nullif(TRY_CAST(level AS BIGINT), 0), 1)) AS title_level,
    CASE block_type WHEN 'paragraph' THEN 'text' WHEN 'list' THEN 'text' WHEN 'image' THEN 'figure'
      WHEN 'header' THEN 'noise' WHEN 'page_number' THEN 'noise' ELSE block_type END AS kb_type,
    CASE WHEN block_type = 'table' THEN 'table' WHEN block_type IN ('figure','image') THEN 'image' ELSE 'text' END AS doc_type
    FROM typed_events""",
)
def block_fields(t: Tables) -> DataFrame:
    b = F.col("block_type")
    return typed_events(t).select(
        "event_id",
        (tx.safe_int(F.col("page_idx")) + 1).alias("page_number"),
        F.greatest(
            F.lit(1).cast("long"), F.coalesce(F.nullif(tx.safe_int(F.col("level")), F.lit(0)), F.lit(1))
        ).alias("title_level"),
        tx.kb_block_type(b).alias("kb_type"),
        F.when(b == "table", "table").when(b.isin("figure", "image"), "image").otherwise("text").alias("doc_type"),
    )


@query(
    "reparse_needed",
    """SELECT id, input_fingerprint, stored <> input_fingerprint AS reparse FROM (
      SELECT 'chunk_' || doc_id AS id, sha256(chunker || '|' || text) AS input_fingerprint,
        sha256(CASE WHEN doc_id % 6 = 0 THEN 'manual' ELSE chunker END || '|' || text) AS stored
      FROM (SELECT doc_id, text, CASE WHEN source LIKE '%3' THEN 'manual' ELSE 'naive' END AS chunker FROM documents))""",
)
def reparse_needed(t: Tables) -> DataFrame:
    chunker = F.when(F.col("source").endswith("3"), "manual").otherwise("naive")
    before = F.when(F.col("doc_id") % 6 == 0, "manual").otherwise(chunker)
    return (
        t.raw("documents")
        .select(
            F.concat(F.lit("chunk_"), F.col("doc_id").cast("string")).alias("id"),
            F.sha2(F.concat_ws("|", chunker, "text"), 256).alias("input_fingerprint"),
            F.sha2(F.concat_ws("|", before, "text"), 256).alias("stored"),
        )
        .select("id", "input_fingerprint", (F.col("stored") != F.col("input_fingerprint")).alias("reparse"))
    )


@query(
    "chunk_keywords",
    """WITH b AS (SELECT source AS file_id, doc_id, [source || '.md', nullif(lang, 'fr'), CASE WHEN doc_id % 3 = 0 THEN 'table' ELSE 'text' END] AS v
      FROM documents),
    f AS (SELECT file_id, doc_id // 200 AS chunk, v[i] AS word, doc_id * 3 + i AS place
      FROM b, (SELECT unnest(range(1, 4)) AS i) WHERE v[i] IS NOT NULL),
    d AS (SELECT file_id, chunk, word, min(place) AS place FROM f GROUP BY ALL)
    SELECT file_id, chunk, array_to_string((list(word ORDER BY place))[1:4], '|') AS keywords FROM d GROUP BY ALL""",
)
def chunk_keywords(t: Tables) -> DataFrame:
    """Keywords of chunks of some documents per file, from file name, section and type."""
    block = F.struct(
        "doc_id",
        F.concat("source", F.lit(".md")).alias("source_file"),
        F.nullif("lang", F.lit("fr")).alias("section_title"),
        F.when(F.col("doc_id") % 3 == 0, "table").otherwise("text").alias("block_type"),
    )
    rows = t.raw("documents").groupBy(F.col("source").alias("file_id"), F.floor(F.col("doc_id") / 200).alias("chunk"))
    gathered = rows.agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    return gathered.select("file_id", "chunk", F.array_join(tx.chunk_keywords(F.col("blocks"), 4), "|").alias("keywords"))
