"""Small column functions over files and job rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loreframe.functions import text as tx


def file_type(name: Column) -> list[Column]:
    """File type and parser by the name's suffix."""
    ext = tx.file_extension(name)
    return [
        F.when(ext.isin(".md", ".markdown"), "markdown")
        .when(ext == ".pdf", "pdf")
        .when(ext.isin(".xlsx", ".xls"), "excel")
        .when(ext == ".docx", "word")
        .otherwise("unknown")
        .alias("file_type"),
        F.when(ext.isin(".md", ".markdown"), "markdown_chat")
        .when(ext.isin(".pdf", ".xlsx", ".xls", ".docx"), "mineru")
        .otherwise("unsupported")
        .alias("parser"),
    ]


def progress_percent(progress: Column) -> Column:
    """Done over total pages of a progress object, clamped to 0..100."""
    done = tx.safe_int(F.get_json_object(progress, "$.extracted_pages"))
    total = tx.safe_int(F.get_json_object(progress, "$.total_pages"))
    share = F.floor(F.coalesce(done, F.lit(0)) * 100 / F.nullif(total, F.lit(0)))
    return F.when(total > 0, F.greatest(F.lit(0), F.least(F.lit(100), share))).otherwise(0).cast("long")
