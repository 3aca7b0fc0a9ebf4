"""Documents, pages and chats to blocks and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loreframe.functions import text as tx
from loreframe.operators import chat, chunking as ch, media, models
from loreframe.plans.bindings_sql import WS, register, strip
from loreframe.plans.registry import query
from loreframe.session import new_work_path
from loreframe.sources import blocks as bl
from loreframe.sources.faq_jsonl import read_faq_jsonl
from loreframe.sources.tables import Tables

LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
TS = "yyyy-MM-dd HH:mm:ss"
SQL_TS = "'%Y-%m-%d %H:%M:%S'"


def markdown(t: Tables) -> DataFrame:
    """Documents as markdown: lines that begin with A-M are headings."""
    return t.raw("documents").select(
        F.col("doc_id").alias("file_id"), F.regexp_replace("text", r"\n([A-M])", "\n# $1").alias("markdown")
    )


register(
    "md_pieces",
    f"""SELECT file_id, i - 1 AS pos, b[i] AS text FROM (SELECT file_id, b, unnest(range(1, len(b) + 1)) AS i FROM (
      SELECT doc_id AS file_id, list_filter(list_transform(string_split(replace(regexp_replace(regexp_replace(text, '\\n([A-M])', chr(10) || '# \\1', 'g'),
        '{LINES}', chr(10), 'g'), chr(10) || '#', chr(1) || '#'), chr(1)), lambda p: array_to_string(list_filter(list_transform(string_split(p, chr(10)),
        lambda l: regexp_replace(l, '{WS}+$', '')), lambda l: l <> ''), chr(10))), lambda p: p <> '') AS b FROM documents))""",
)
register(
    "md_blocks",
    f"""SELECT file_id, pos, {strip('text')} AS text, last_value(CASE WHEN starts_with(text, '#') THEN
      nullif({strip("regexp_replace(string_split(text, chr(10))[1], '^#+', '')")}, '') END IGNORE NULLS)
      OVER (PARTITION BY file_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section_title FROM md_pieces""",
)
register(
    "typed_blocks",
    "SELECT *, CASE pos % 4 WHEN 3 THEN 'list' ELSE 'text' END AS block_type, CAST(pos % 5 + 1 AS INT) AS page_number FROM md_blocks",
)


def md_blocks(t: Tables) -> DataFrame:
    return bl.markdown_blocks(markdown(t))


def typed_blocks(t: Tables) -> DataFrame:
    return md_blocks(t).withColumns(
        {
            "block_type": F.when(F.col("pos") % 4 == 3, "list").otherwise("text"),
            "page_number": (F.col("pos") % 5 + 1).cast("int"),
        }
    )


@query("markdown_blocks", "SELECT file_id, pos, text, section_title FROM md_blocks")
def markdown_blocks(t: Tables) -> DataFrame:
    return md_blocks(t)


register(
    "manual_groups",
    """SELECT *, sum(CASE WHEN prev = key THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY pos) - 1 AS chunk_no FROM (
      SELECT *, lag(key) OVER (PARTITION BY file_id ORDER BY pos) AS prev FROM (
        SELECT *, coalesce(section_title, '未分章节') AS key FROM typed_blocks))""",
)


@query(
    "manual_chunks",
    """SELECT file_id, CAST(chunk_no AS BIGINT) AS chunk_no, string_agg(text, chr(10) ORDER BY pos) AS text FROM manual_groups GROUP BY ALL""",
)
def manual_chunks(t: Tables) -> DataFrame:
    return ch.manual_chunks(typed_blocks(t)).select("file_id", "chunk_no", "text")


@query(
    "chunk_metadata",
    """SELECT file_id, CAST(chunk_no AS BIGINT) AS chunk_no, min(page_number) AS page_start, max(page_number) AS page_end,
    array_to_string(list_filter(list_transform(string_split(key, '>'), lambda x: trim(x)), lambda x: x <> ''), ' > ') AS section,
    CASE WHEN count(DISTINCT block_type) > 1 THEN 'mixed' ELSE min(block_type) END AS block_type, count(*) AS block_count
    FROM manual_groups GROUP BY file_id, chunk_no, key""",
)
def chunk_metadata(t: Tables) -> DataFrame:
    return ch.manual_chunks(typed_blocks(t)).drop("text")


@query(
    "delimiter_chunks",
    f"""SELECT file_id, pos, i - 1 AS piece_no, p[i] AS text FROM (SELECT file_id, pos, p, unnest(range(1, len(p) + 1)) AS i FROM (
      SELECT file_id, pos, list_filter(list_transform(regexp_split_to_array(text, ', |\\.'), lambda x: {strip('x')}), lambda x: x <> '') AS p FROM md_blocks))""",
)
def delimiter_chunks(t: Tables) -> DataFrame:
    return ch.delimiter_chunks(md_blocks(t), [".", ", "])


@query(
    "naive_chunks",
    f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS n, length(text) + 1 AS size
      FROM typed_blocks WHERE {strip('text')} <> ''),
    f AS (SELECT file_id, n, size AS total, 0 AS chunk_no FROM b WHERE n = 1
      UNION ALL SELECT b.file_id, b.n, CASE WHEN f.total > 512 THEN b.size ELSE f.total + b.size END, f.chunk_no + CAST(f.total > 512 AS INTEGER)
      FROM f JOIN b ON b.file_id = f.file_id AND b.n = f.n + 1)
    SELECT file_id, CAST(chunk_no AS BIGINT) AS chunk_no, {strip("string_agg(text, chr(10) ORDER BY pos)")} AS text,
      min(page_number) AS page_start, max(page_number) AS page_end,
      coalesce(array_to_string(list_filter(list_transform(string_split(arg_max(nullif(section_title, ''), pos), '>'), lambda x: trim(x)),
        lambda x: x <> ''), ' > '), '') AS section,
      CASE WHEN count(DISTINCT block_type) > 1 THEN 'mixed' ELSE min(block_type) END AS block_type, count(*) AS block_count
    FROM b JOIN f USING (file_id, n) GROUP BY file_id, chunk_no""",
)
def naive_chunks(t: Tables) -> DataFrame:
    return ch.naive_chunks(typed_blocks(t))


def qa_blocks(t: Tables) -> DataFrame:
    """Document lines as rows; every third line is a tab-separated pair."""
    lines = F.split(F.regexp_replace("text", "[\t,\"]", " "), "\n")
    first = F.substring_index("line", " ", 1)
    return (
        t.raw("documents").select(F.col("doc_id").alias("file_id"), F.posexplode(lines).alias("pos", "line"))
        .select(
            "file_id", F.col("pos").cast("long").alias("pos"),
            F.when(F.col("pos") % 3 == 1, F.concat(first, F.lit("\t"), "line")).otherwise(F.col("line")).alias("text"),
            F.lit("text").alias("block_type"), (F.col("pos") % 7 + 1).cast("int").alias("page_number"),
            F.lit(None).cast("string").alias("section_title"),
        )
    )


@query(
    "qa_chunks",
    f"""WITH l AS (SELECT doc_id AS file_id, unnest(a) AS line, unnest(range(0, len(a))) AS pos FROM (
        SELECT doc_id, string_split(regexp_replace(text, '[\\t,"]', ' ', 'g'), chr(10)) AS a FROM documents)),
    b AS (SELECT file_id, pos, pos % 7 + 1 AS page, {strip("line")} AS body, CASE WHEN pos % 3 = 1 AND {strip("string_split(line, ' ')[1]")} <> '' AND {strip('line')} <> ''
        THEN {strip("string_split(line, ' ')[1]")} END AS q FROM l),
    g AS (SELECT *, sum(CASE WHEN q IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY pos) - 1 AS chunk_no FROM b)
    SELECT file_id, CAST(chunk_no AS BIGINT) AS chunk_no, arg_min(q, pos) AS question, coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (body <> ''), '') AS answer,
      CAST(min(page) AS INT) AS page_start, CAST(max(page) AS INT) AS page_end, count(*) AS block_count FROM g WHERE chunk_no >= 0 GROUP BY ALL""",
)
def qa_chunks(t: Tables) -> DataFrame:
    return ch.qa_chunks(qa_blocks(t)).drop("text")


def table_blocks(t: Tables) -> DataFrame:
    """Events as small tables: header, a data row, an empty row, a row of the wrong width."""
    k = F.get_json_object("props", "$.k")
    sep = F.when(F.col("event_id") % 2 == 0, " | ").otherwise("\t")
    e = F.col("event_id").cast("string")
    row = F.concat(e, sep, F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_type")), sep, k)
    body = F.concat_ws(
        "\n", F.concat(F.lit("id"), sep, F.lit("kind"), sep, F.lit("k")), row, F.concat(F.lit("x"), sep, F.lit("y")),
    )
    return t.raw("events").select(
        F.col("event_id").alias("file_id"), F.lit(0).cast("long").alias("pos"), body.alias("text"),
        F.lit("table").alias("block_type"), (F.col("event_id") % 9 + 1).cast("int").alias("page_number"),
        F.lit(None).cast("string").alias("section_title"),
    )


@query(
    "table_chunks",
    """SELECT event_id AS file_id, 1 AS row_index, '- id: ' || event_id || CASE WHEN event_id % 5 = 0 THEN '' ELSE chr(10) || '- kind: ' || event_type END
      || chr(10) || '- k: ' || json_extract_string(props, '$.k') AS text FROM events""",
)
def table_chunks(t: Tables) -> DataFrame:
    return ch.table_chunks(table_blocks(t)).select("file_id", "row_index", "text")


@query("chunk_pipeline")
def chunk_pipeline(t: Tables) -> DataFrame:
    """Naive and manual files from documents; question-answer files and tables next to them."""
    def keyed(df, prefix):
        cols = ["pos", "text", "block_type", "page_number", "section_title"]
        return df.select(F.concat(F.lit(prefix), F.col("file_id").cast("string")).alias("file_id"), *cols)

    md, qa, tb = typed_blocks(t), qa_blocks(t), table_blocks(t)
    every = keyed(md, "md").unionByName(keyed(qa, "qa")).unionByName(keyed(tb, "tb"))
    n = F.regexp_extract("file_id", r"(\d+)$", 1).cast("long")
    kind = (
        F.when(F.col("file_id").startswith("qa"), "QA ")
        .when(F.col("file_id").startswith("tb"), F.when(n % 50 == 0, "unknown").otherwise("table"))
        .otherwise(F.when(n % 2 == 0, " Manual").otherwise(""))
    )
    chunkers = every.select("file_id").distinct().withColumn("chunker_type", kind)
    return ch.chunk_pipeline(every, chunkers)


# --- HTML and layout ------------------------------------------------------------------------------


@query("html_clean")
def html_clean(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", bl.clean_inline(F.col("html")).alias("text"))


def html_tables(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    row = F.concat(
        F.lit("<Table><tr><th>id</th><TH class='x'>kind</TH></tr><tr><td><b>"), F.col("event_id").cast("string"),
        F.lit("</b></td><td>"), "event_type", F.lit("<br/>"), k, F.lit("</td></tr><tr><td> </td></tr></table>"),
    )
    return t.raw("events").select("event_id", row.alias("html"))


@query(
    "html_table_text",
    """SELECT event_id, 'id | kind' || chr(10) || event_id || ' | ' || event_type || chr(10) || json_extract_string(props, '$.k') AS text FROM events""",
)
def html_table_text(t: Tables) -> DataFrame:
    return html_tables(t).select("event_id", bl.table_text(F.col("html")).alias("text"))


@query("html_blocks")
def html_blocks(t: Tables) -> DataFrame:
    return bl.html_blocks(t.raw("pages").select("page_id", "html"))


def layout_payloads(t: Tables) -> DataFrame:
    """Pages as parser payloads in several wrappings, one item per block plus page chrome."""
    b = bl.html_blocks(t.raw("pages").select("page_id", "html"))
    y = (F.col("pos") * 20).cast("double")
    item = F.struct(
        F.when(F.col("pos") % 17 == 16, "page_number").otherwise(F.col("block_type")).alias("type"),
        F.when(F.col("block_type") != "list", F.col("text")).alias("text"),
        F.when(F.col("block_type") == "list", F.array("text")).alias("list_items"),
        F.col("level"),
        F.floor(F.col("pos") / 10).alias("page_idx"),
        F.when(F.col("pos") % 5 == 2, F.concat(F.lit("img/"), F.col("pos").cast("string"), F.lit(".png"))).alias("img_path"),
        F.array(F.lit(100.0), y, F.lit(10.0), y + 15.0).alias("bbox"),
    )
    said = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("content")))
    title, kind = F.col("block_type") == "title", F.col("block_type")
    picture = F.concat(F.lit("img/"), F.col("pos").cast("string"), F.lit(".png"))
    nested = F.struct(
        F.when(title, "title").when(kind == "list", "list").when(F.col("pos") % 5 == 2, "image").otherwise("paragraph").alias("type"),
        F.struct(
            F.when(title, said).alias("title_content"),
            F.when(title, F.col("level")).alias("level"),
            F.when(~title & (kind != "list") & (F.col("pos") % 5 != 2), said).alias("paragraph_content"),
            F.when(kind == "list", F.array(F.struct(said.alias("item_content")))).alias("list_items"),
            F.when(~title & (kind != "list") & (F.col("pos") % 5 == 2), F.struct(picture.alias("path"))).alias("image_source"),
        ).alias("content"),
    )
    order = F.sort_array(F.collect_list(F.struct("pos", item.alias("i"), nested.alias("d"))))
    items, deep = F.to_json(F.transform(order, lambda x: x["i"])), F.to_json(F.transform(order, lambda x: x["d"]))
    listed = b.groupBy(F.col("page_id").alias("file_id")).agg(items.alias("items"), deep.alias("deep"))
    n = F.col("file_id") % 5
    body = (
        F.when(n == 0, F.concat(F.lit('{"content_list": '), "items", F.lit("}")))
        .when(n == 1, F.concat(F.lit('{"data": {"result": {"blocks": '), "items", F.lit("}}}")))
        .when(n == 2, F.concat(F.lit('{"meta": {"deep": {"contents": '), "items", F.lit("}}}")))
        .when(n == 3, F.concat(F.lit('{"result": {"content_list_v2": ['), "deep", F.lit("]}}")))
        .otherwise(F.concat(F.lit('{"result": {"content_list_v2": ['), "items", F.lit("]}}")))
    )
    return listed.select("file_id", body.alias("payload"))


@query("layout_blocks")
def layout_blocks(t: Tables) -> DataFrame:
    return bl.layout_blocks(layout_payloads(t)).withColumn("asset_paths", F.to_json("asset_paths"))


@query("block_assets")
def block_assets(t: Tables) -> DataFrame:
    items = bl.layout_items(layout_payloads(t)).withColumn("assets", bl.asset_paths())
    return items.select("file_id", "pos", F.explode("assets").alias("kind", "path"))


@query("pdf_positions")
def pdf_positions(t: Tables) -> DataFrame:
    tagged = bl.layout_blocks(layout_payloads(t)).filter("position_tag is not null")
    at = F.get(ch.pdf_positions(F.col("position_tag")), F.lit(0))
    names = ["page", "left_edge", "right_edge", "top_edge", "bottom_edge"]
    return tagged.select("file_id", "pos", *[F.get(at, F.lit(i)).alias(n) for i, n in enumerate(names)])


@query("chunk_source_offsets")
def chunk_source_offsets(t: Tables) -> DataFrame:
    """Position tags and distinct positions of the merged chunks of layout payloads."""
    grouped = ch.naive_groups(bl.layout_blocks(layout_payloads(t)))
    found = ch.source_offsets(grouped, ["file_id", "chunk_no"])
    return found.select(
        "file_id", "chunk_no", F.array_join("position_tags", "|").alias("position_tags"), F.to_json("pdf_positions").alias("pdf_positions")
    )


def kb_source(t: Tables) -> DataFrame:
    b = bl.html_blocks(t.raw("pages").select("page_id", "html"))
    return b.select(
        F.col("page_id").alias("file_id"), "pos", "block_type", "text", "level",
        F.floor(F.col("pos") / 10).cast("int").alias("page_number"),
    )


@query("section_paths")
def section_paths(t: Tables) -> DataFrame:
    return ch.section_stack(kb_source(t)).select(
        "file_id", "pos", F.array_join("section_path", " > ").alias("section"), "skipped"
    )


@query("layout_kb_blocks")
def layout_kb_blocks(t: Tables) -> DataFrame:
    """Parser payloads to knowledge-base blocks: shapes, sections, noise, assets, merged text."""
    found = ch.kb_blocks(bl.kb_items(layout_payloads(t)))
    return found.withColumn("assets", F.array_join(F.transform("assets", lambda e: F.concat_ws("=", e["key"], e["value"])), "|"))


@query("media_context")
def media_context(t: Tables) -> DataFrame:
    """Layout blocks with an image path count as images and get the text around them."""
    b = bl.layout_blocks(layout_payloads(t))
    kind = F.when(F.size(F.map_keys("asset_paths")) > 0, "image").otherwise(F.col("block_type"))
    rows = b.select(
        "file_id", "pos", kind.alias("block_type"), "text", ch.pdf_positions(F.col("position_tag")).alias("positions")
    )
    return media.media_context(rows, table_budget=120, image_budget=120)


@query("split_messages")
def split_messages(t: Tables) -> DataFrame:
    return t.raw("documents").select(
        "doc_id", F.posexplode(ch.split_message(F.col("text"))).alias("part_no", "part")
    )


# --- chat -----------------------------------------------------------------------------------------


@query(
    "chat_parse",
    f"""SELECT event_id AS file_id, 0 AS message_no, strftime(date_trunc('minute', ts), {SQL_TS}) AS sent_at, event_type AS speaker,
      'k ' || json_extract_string(props, '$.k') || chr(10) || 'more: text' AS content FROM events
    UNION ALL SELECT event_id, 1, strftime(date_trunc('minute', ts), {SQL_TS}), 'user ' || user_id, 'ok: yes' FROM events""",
)
def chat_parse(t: Tables) -> DataFrame:
    at = F.date_format("ts", "yyyy-MM-dd HH:mm")
    body = F.concat(
        F.lit("# Export\n\n- ["), at, F.lit("] "), "event_type", F.lit(": k "), F.get_json_object("props", "$.k"),
        F.lit("  \n\n   more: text\n- ["), at, F.lit("] user "), F.col("user_id").cast("string"), F.lit(": ok: yes\n"),
    )
    docs = t.raw("events").select(F.col("event_id").alias("file_id"), body.alias("markdown"))
    return bl.chat_messages(docs).withColumn("sent_at", F.date_format("sent_at", TS))


CHAT_AGG = f"""strftime(min(sent_at), {SQL_TS}) AS start_at, strftime(max(sent_at), {SQL_TS}) AS end_at, count(*) AS message_count,
  string_agg('[' || strftime(sent_at, '%Y-%m-%d %H:%M') || '] ' || speaker || ': ' || content, chr(10) ORDER BY sent_at, pos) AS text"""
KEPT = "SELECT * FROM chat_messages WHERE speaker <> '[系统]' AND content <> '收到'"


def shown(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns(
        {
            "start_at": F.date_format("start_at", TS),
            "end_at": F.date_format("end_at", TS),
            "keywords": F.array_join("keywords", "|"),
        }
    )


def chat_sql(joins: str, max_messages: int, max_chars: int) -> str:
    """Chunks of a channel, folded message by message; ``joins`` says when m may follow in f's chunk."""
    return f"""WITH RECURSIVE k AS ({KEPT}),
    m AS (SELECT *, row_number() OVER w AS n, length(content) + length(speaker) + 20 AS size, CAST(sent_at AS DATE) AS day,
                 lag(sent_at) OVER w AS prev FROM k WINDOW w AS (PARTITION BY channel ORDER BY sent_at, pos)),
    f AS (SELECT channel, n, day AS first_day, 1 AS messages, size AS total, 1 AS part FROM m WHERE n = 1
      UNION ALL SELECT channel, n, CASE WHEN opens THEN day ELSE first_day END, CASE WHEN opens THEN 1 ELSE messages + 1 END,
        CASE WHEN opens THEN size ELSE total + size END, part + CAST(opens AS INTEGER)
      FROM (SELECT m.channel, m.n, m.day, m.size, f.first_day, f.messages, f.total, f.part,
              NOT ({joins}) OR f.messages >= {max_messages} OR f.total + m.size > {max_chars} AS opens
            FROM f JOIN m ON m.channel = f.channel AND m.n = f.n + 1))
    SELECT channel, CAST(part AS BIGINT) AS part, {CHAT_AGG}, CASE WHEN max(speaker = 'error') THEN '退款|报告' ELSE '' END AS keywords
    FROM m JOIN f USING (channel, n) GROUP BY channel, part"""


@query("chat_chunks_gap", chat_sql("m.sent_at - m.prev <= INTERVAL 600 MINUTE", 120, 8000))
def chat_chunks_gap(t: Tables) -> DataFrame:
    return shown(chat.build_chunks(chat.chunk_parts(t.chat_messages, gap_minutes=600), ["channel", "part"]))


@query("chat_chunks_day", chat_sql("m.day - f.first_day < 1", 120, 8000))
def chat_chunks_day(t: Tables) -> DataFrame:
    return shown(chat.build_chunks(chat.chunk_parts(t.chat_messages, days=1), ["channel", "part"]))


@query("chat_chunks_capped", chat_sql("m.day - f.first_day < 7", 12, 400))
def chat_chunks_capped(t: Tables) -> DataFrame:
    parts = chat.chunk_parts(t.chat_messages, days=7, max_messages=12, max_chars=400)
    return shown(chat.build_chunks(parts, ["channel", "part"]))


# --- FAQ files ------------------------------------------------------------------------------------


def faq_lines(t: Tables) -> DataFrame:
    """FAQ rows as JSON lines, with broken, non-object and incomplete lines among them."""
    f = t.faq_documents
    row = F.to_json(
        F.struct(
            "id", "question", "answer", "confidence", "status", "tags",
            F.when(F.col("item_id") % 7 != 3, F.col("question")).alias("embedding_text"),
        )
    )
    broken = (
        F.when(F.col("item_id") % 9 == 1, F.concat(row, F.lit("}")))
        .when(F.col("item_id") % 9 == 2, F.concat(F.lit("["), F.col("item_id").cast("string"), F.lit("]")))
        .when(F.col("item_id") % 9 == 3, F.lit("   "))
        .otherwise(row)
    )
    return f.select(broken.alias("value"))


def faq_files(t: Tables) -> tuple[DataFrame, DataFrame]:
    path = new_work_path(t.spark, "faq-lines")
    faq_lines(t).write.text(path)
    return read_faq_jsonl(t.spark, path)


@query("faq_jsonl_rejects")
def faq_jsonl_rejects(t: Tables) -> DataFrame:
    return faq_files(t)[1].select("line", "reason")


@query("faq_import")
def faq_import(t: Tables) -> DataFrame:
    """Lines to rows to vectors to the merged FAQ table."""
    from loreframe.operators import lifecycle as lc
    from loreframe.sources.tables import now

    rows, _ = faq_files(t)
    vectors = models.embed_rows(rows, "embedding_text").withColumn(
        "state", F.when(F.col("embedding_error").isNull(), "ready").otherwise("failed")
    )
    new = rows.join(vectors.select("id", "state"), "id").select(
        "id", "question", "answer", "status", now().alias("updated_at"), now().alias("created_at"),
        F.col("state").alias("embedding_status"),
    )
    base = t.faq_documents.select("id", "question", "answer", "status", "updated_at", "created_at", "embedding_status")
    return lc.upsert(base, new, ["id"], [F.col("updated_at")])
