"""Source rows to searchable knowledge rows: children, parent rows, FAQ rows, statuses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from loreframe.functions import text as tx



def delimiter_pattern(delimiter: str | None) -> str:
    """Regex for a delimiter setting: back-ticked groups (longest first) after single characters.

    It is a configuration value, so this runs once per distinct setting, not per row.
    """
    if not delimiter:
        return ""
    text = delimiter.encode("utf-8").decode("unicode_escape") if delimiter.isascii() else delimiter
    groups = sorted({g for g in re.findall(r"`([^`]+)`", text)}, key=lambda g: (-len(g), g))
    singles = re.sub(r"`[^`]+`", "", text)
    return "|".join([*(re.escape(ch) for ch in singles), *(re.escape(g) for g in groups)])


def row_pattern(delimiter: Column) -> Column:
    """``delimiter_pattern`` of a setting that differs from row to row; empty for none."""
    text = F.coalesce(delimiter, F.lit(""))
    for escape, sign in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r")):
        text = F.replace(text, F.lit(escape), F.lit(sign))
    groups = F.array_sort(
        F.array_distinct(F.regexp_extract_all(text, F.lit("`([^`]+)`"), 1)),
        lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0),
    )
    singles = F.filter(F.split(F.regexp_replace(text, "`[^`]+`", ""), ""), lambda c: c != "")
    quoted = F.transform(F.concat(singles, groups), lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E")))
    return F.array_join(quoted, "|")


def split_keep(content: Column, pattern: str | Column) -> Column:
    """Pieces of a text, each keeping the delimiter that ends it; blank pieces are dropped."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    group = F.concat(F.lit("("), pattern, F.lit(")"))
    pieces = F.filter(
        F.split(F.regexp_replace(content, group, F.lit("$1\u0000")), "\u0000"),
        lambda p: ~tx.blank(p) & ~F.rlike(p, F.concat(F.lit("^"), group, F.lit("$"))),
    )
    whole = F.when(~tx.blank(content), F.array(content)).otherwise(F.array().cast("array<string>"))
    return F.when(pattern == "", whole).otherwise(pieces)


def child_texts(text: Column, pattern: str | Column) -> Column:
    """Delimiter pieces, or the whole text when there are none."""
    pieces = split_keep(text, pattern)
    return F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.coalesce(text, F.lit(""))))


def children() -> Column:
    """Children of a source chunk: its blocks that have a text, else the pieces by its own delimiter.

    Array of struct(text, section_path, page_start, page_end, block_type); what a block does not say is
    the chunk's.
    """
    def child(text, path, first, last, kind):
        return F.struct(
            text.alias("text"), path.alias("section_path"), first.alias("page_start"), last.alias("page_end"), kind.alias("block_type")
        )

    def own_path(block):
        parts = F.transform(F.split(F.coalesce(block["section_title"], F.lit("")), ">"), lambda x: tx.strip(x))
        return F.filter(parts, lambda x: x != "")

    blocks = F.filter("source_blocks", lambda b: ~tx.blank(b["text"]))
    from_blocks = F.transform(
        blocks,
        lambda b: child(
            tx.strip(b["text"]),
            F.when(F.size(own_path(b)) > 0, own_path(b)).otherwise(F.col("section_path")),
            F.coalesce(b["page_number"], F.col("page_start")),
            F.coalesce(b["page_number"], F.col("page_end")),
            F.coalesce(F.nullif(b["block_type"], F.lit("")), F.col("block_type")),
        ),
    )
    from_text = F.transform(
        child_texts(F.col("source_text"), row_pattern(F.col("children_delimiter"))),
        lambda x: child(x, F.col("section_path"), F.col("page_start"), F.col("page_end"), F.col("block_type")),
    )
    return F.when(F.size(blocks) > 0, from_blocks).otherwise(from_text)


def expected_rows() -> Column:
    """Rows that a source chunk should have: its parent and its children."""
    return (F.size(children()) + 1).cast("long")


def document_knowledge_rows(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """One parent and its children per source chunk, with ids, index, texts and hash."""
    titled = chunks.join(
        files.select(F.col("id").alias("file_id"), F.col("original_name").alias("source_title")), "file_id"
    )
    parent = F.struct(
        F.when(~tx.blank(F.col("source_text")), F.col("source_text")).otherwise("").alias("text"),
        "section_path", "page_start", "page_end", "block_type",
    )
    rows = titled.select(
        "id", "file_id", "source_title", "chunk_index", "keywords", "questions",
        F.posexplode(F.concat(F.array(parent), children())).alias("child_no", "part"),
    ).select("*", F.col("part.text").alias("content"), "part.section_path", "part.page_start", "part.page_end", "part.block_type")
    parent_id = F.concat(F.lit("kc_document_"), F.col("id"))
    child = F.col("child_no") > 0
    embedding_text = tx.document_embedding_text(
        F.col("source_title"), F.col("section_path"), F.col("page_start"), F.col("page_end"),
        F.col("block_type"), F.col("keywords"), F.col("questions"), F.col("content"),
    )
    built = rows.select(
        F.when(child, F.concat(parent_id, F.lit("_child_"), F.col("child_no").cast("string")))
        .otherwise(parent_id)
        .alias("id"),
        F.lit("document").alias("source_type"),
        F.col("file_id").alias("source_id"),
        F.col("id").alias("source_chunk_id"),
        F.when(child, parent_id).alias("parent_chunk_id"),
        F.when(child, "child").otherwise("parent").alias("chunk_level"),
        "source_title",
        F.when(child, tx.child_index(F.col("chunk_index"), F.col("child_no")))
        .otherwise(F.col("chunk_index"))
        .alias("chunk_index"),
        F.col("child_no").cast("long").alias("child_no"),
        "section_path", "page_start", "page_end", "block_type",
        "content",
        embedding_text.alias("embedding_text"),
        tx.join_parts(
            tx.one(F.col("source_title")),
            tx.one(F.array_join("section_path", " > ")),
            tx.one(tx.page_range(F.col("page_start"), F.col("page_end"))),
            tx.one(F.col("block_type")),
            F.col("keywords"),
            F.col("questions"),
            tx.one(F.col("content")),
        ).alias("search_text"),
        F.col("keywords").alias("tags"),
        F.lit("usable").alias("status"),
    )
    return built.withColumn("content_hash", tx.content_hash(F.col("embedding_text")))


def faq_knowledge_rows(faqs: DataFrame) -> DataFrame:
    """One searchable row per FAQ."""
    embedding_text = tx.faq_embedding_text(
        F.col("question"), F.col("question_variants"), F.col("answer"), F.col("category"), F.col("tags")
    )
    return faqs.select(
        F.concat(F.lit("kc_faq_"), "id").alias("id"),
        F.lit("faq").alias("source_type"),
        F.col("id").alias("source_id"),
        F.lit("chunk").alias("chunk_level"),
        F.lit(0).cast("long").alias("chunk_index"),
        tx.strip("question").alias("source_title"),
        tx.faq_content(F.col("question"), F.col("question_variants"), F.col("answer")).alias("content"),
        embedding_text.alias("embedding_text"),
        tx.join_parts(
            tx.one(F.col("question")), F.col("question_variants"), tx.one(F.col("answer")),
            tx.one(F.col("category")), F.col("tags"),
        ).alias("search_text"),
        "tags",
        "confidence",
        "status",
        tx.content_hash(embedding_text).alias("content_hash"),
    )


def with_row_defaults(rows: DataFrame) -> DataFrame:
    """Fallbacks of a knowledge row: embedding text, search text, status, hash, lists."""
    embedding_text = F.coalesce(tx.none_if_blank(F.col("embedding_text")), tx.strip("content"))
    tags = tx.clean_items(F.coalesce("tags", F.array().cast("array<string>")))
    search = tx.join_parts(tx.one(F.col("source_title")), tags, tx.one(F.col("content")))
    return rows.select(
        "id",
        embedding_text.alias("embedding_text"),
        F.coalesce(F.nullif("search_text", F.lit("")), search).alias("search_text"),
        F.coalesce("status", F.lit("needs_review")).alias("status"),
        F.coalesce("embedding_status", F.lit("pending")).alias("embedding_status"),
        F.coalesce("content_hash", tx.content_hash(embedding_text)).alias("content_hash"),
        tags.alias("tags"),
    )


STATUSES = ("ready", "stale", "failed", "pending")


def chunk_embedding_counts(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """Knowledge rows per source chunk by embedding status; chunks without rows count zero."""
    per_chunk = rows.filter("source_type = 'document'").groupBy("source_id", "source_chunk_id").agg(
        F.count(F.lit(1)).alias("knowledge_count"),
        *[F.count_if(F.col("embedding_status") == s).alias(f"{s}_count") for s in STATUSES],
    )
    zero = F.lit(0).cast("long")
    counted = chunks.join(
        per_chunk.withColumnsRenamed({"source_id": "__file", "source_chunk_id": "__chunk"}),
        (F.col("id") == F.col("__chunk")) & (F.col("file_id") == F.col("__file")),
        "left",
    ).drop("__file", "__chunk")
    names = ["knowledge_count", *[f"{s}_count" for s in STATUSES]]
    return counted.withColumns({n: F.coalesce(n, zero) for n in names})


def chunk_status(expected: Column) -> Column:
    total, ready = F.col("knowledge_count"), F.col("ready_count")
    return (
        F.when(total == 0, "pending")
        .when(F.col("stale_count") > 0, "stale")
        .when((F.col("failed_count") > 0) & (ready == 0), "failed")
        .when((total == expected) & (ready == total), "ready")
        .when(ready == 0, "pending")
        .otherwise("partial")
    )


def chunk_embedding_status(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    expected = chunks.select("id", "file_id", "is_disabled", expected_rows().alias("expected"))
    return chunk_embedding_counts(expected, rows).withColumn(
        "embedding_status", chunk_status(F.col("expected"))
    )


def file_embedding_summary(
    files: DataFrame, chunks: DataFrame, rows: DataFrame
) -> DataFrame:
    """Totals per file; expected rows that do not exist yet count as pending."""
    status = chunk_embedding_status(chunks.filter(~F.col("is_disabled")), rows)
    missing = F.greatest(F.col("expected") - F.col("knowledge_count"), F.lit(0))
    per_file = status.groupBy("file_id").agg(
        F.sum(F.greatest("expected", "knowledge_count")).alias("total_chunks"),
        F.sum("knowledge_count").alias("knowledge_count"),
        F.sum("ready_count").alias("ready_count"),
        F.sum("stale_count").alias("stale_count"),
        F.sum("failed_count").alias("failed_count"),
        F.sum(F.col("pending_count") + missing).alias("pending_count"),
        F.sum(missing).alias("missing_count"),
    )
    names = [c for c in per_file.columns if c != "file_id"]
    joined = files.select(F.col("id").alias("file_id")).join(per_file, "file_id", "left").withColumns(
        {n: F.coalesce(n, F.lit(0).cast("long")) for n in names}
    )
    total, ready = F.col("total_chunks"), F.col("ready_count")
    return joined.withColumn(
        "status",
        F.when(total == 0, "none")
        .when(F.col("stale_count") > 0, "stale")
        .when((F.col("failed_count") > 0) & (ready == 0), "failed")
        .when(ready >= total, "ready")
        .when(ready == 0, "pending")
        .otherwise("partial"),
    )
