"""FAQ rows from JSON lines, with rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loreframe.functions import text as tx

# Fields every row must have.
REQUIRED = ["id", "question", "answer", "confidence", "status", "embedding_text"]
SCHEMA = (
    "id string, doc_type string, question string, question_variants array<string>, answer string, category string, "
    "tags array<string>, confidence string, status string, embedding_text string, source_file string"
)


def read_faq_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects). Rejects carry the file path, the raw line and the reason."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), tx.strip("value").alias("line")
    ).filter("line <> ''")
    keys = F.json_object_keys("line")
    missing = F.array_except(F.array(*[F.lit(c) for c in REQUIRED]), keys)
    parsed = F.from_json("line", SCHEMA)
    is_json = F.try_parse_json("line").isNotNull()
    checked = raw.select(
        "path",
        "line",
        F.when(~is_json, "invalid JSON")
        .when(keys.isNull(), "expected JSON object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing required fields: "), F.array_join(missing, ", ")))
        .alias("reason"),
        parsed.alias("row"),
    )
    return (
        checked.filter("reason is null").select("row.*"),
        checked.filter("reason is not null").select("path", "line", "reason"),
    )
