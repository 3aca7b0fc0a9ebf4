"""Live gates: which rows may be retrieved, and which graph evidence still counts.

Control tables join as semi joins on their keys only, so a chunk row never widens and duplicate
control rows cannot multiply it. No broadcast hints: the planner (with run-time sizes) broadcasts
a control table when it is small and falls back to a shuffle join when it is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def enabled_files(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("is_disabled")).select(F.col("id").alias("__file"))


def enabled_chunks(import_chunks: DataFrame) -> DataFrame:
    return import_chunks.filter(~F.col("is_disabled")).select(
        F.col("id").alias("__chunk"), F.col("file_id").alias("__chunk_file")
    )


def live_documents(rows: DataFrame, files: DataFrame, import_chunks: DataFrame) -> DataFrame:
    """Document rows whose file and chunk both exist and are enabled."""
    return rows.join(enabled_files(files), F.col("source_id") == F.col("__file"), "left_semi").join(
        enabled_chunks(import_chunks),
        (F.col("source_chunk_id") == F.col("__chunk")) & (F.col("source_id") == F.col("__chunk_file")),
        "left_semi",
    )


def live_chunks(
    rows: DataFrame, files: DataFrame, import_chunks: DataFrame, faqs: DataFrame, status="usable"
) -> DataFrame:
    """Rows that search may return now, FAQ and document rows gated by their own source tables."""
    ready = rows.filter(F.col("embedding_status") == "ready")
    documents = ready.filter(
        (F.col("source_type") == "document")
        & (F.col("status") == status)
        & (F.col("chunk_level") == "child")
    )
    usable_faqs = faqs.filter((F.col("status") == status) & (F.col("embedding_status") == "ready"))
    answers = ready.filter(F.col("source_type") == "faq").join(
        usable_faqs.select(F.col("id").alias("__faq")), F.col("source_id") == F.col("__faq"), "left_semi"
    )
    return live_documents(documents, files, import_chunks).unionByName(answers)


def live_evidence(
    evidence: DataFrame, files: DataFrame, import_chunks: DataFrame, faqs: DataFrame
) -> DataFrame:
    """Evidence whose FAQ is usable, or whose file and chunk are present and enabled."""
    from_faq = evidence.filter("source_type = 'faq'").join(
        faqs.filter("status = 'usable'").select(F.col("id").alias("__faq")),
        F.col("source_id") == F.col("__faq"),
        "left_semi",
    )
    from_document = evidence.filter("source_type = 'document'")
    return live_documents(from_document, files, import_chunks).unionByName(from_faq)


def often_cited_evidence(
    evidence: DataFrame, files: DataFrame, import_chunks: DataFrame, faqs: DataFrame
) -> DataFrame:
    """``live_evidence`` for a whole evidence table, whose chunks are cited many times each.

    The chunks that are cited and live are written once, so the planner knows their size: where they are few, the
    evidence is filtered where it is read instead of being moved to them.
    """
    from loreframe.session import written

    keys = ["source_id", "source_chunk_id"]
    document = evidence.filter("source_type = 'document'")
    live = written(live_documents(document.select(*keys).distinct(), files, import_chunks), "cited")
    usable = written(faqs.filter("status = 'usable'").select(F.col("id").alias("source_id")).distinct(), "faqs")
    from_faq = evidence.filter("source_type = 'faq'").join(usable, "source_id", "left_semi")
    return document.join(live, keys, "left_semi").unionByName(from_faq)


def with_validity(
    evidence: DataFrame, files: DataFrame, import_chunks: DataFrame, faqs: DataFrame
) -> DataFrame:
    """Every evidence row with a flag telling whether it is live."""
    f = enabled_files(files).distinct()
    c = enabled_chunks(import_chunks).distinct()
    q = faqs.filter("status = 'usable'").select(F.col("id").alias("__faq")).distinct()
    document, faq = F.col("source_type") == "document", F.col("source_type") == "faq"
    return (
        evidence.join(f, document & (F.col("source_id") == F.col("__file")), "left")
        .join(
            c,
            document
            & (F.col("source_chunk_id") == F.col("__chunk"))
            & (F.col("source_id") == F.col("__chunk_file")),
            "left",
        )
        .join(q, faq & (F.col("source_id") == F.col("__faq")), "left")
        .withColumn(
            "is_valid",
            (faq & F.col("__faq").isNotNull())
            | (document & F.col("__file").isNotNull() & F.col("__chunk").isNotNull()),
        )
        .drop("__file", "__chunk", "__chunk_file", "__faq")
    )
