"""Writing result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write ``rows`` under ``path`` by partition; only the partitions that occur in them are replaced.

    Rows are dealt out by the partition columns first, with adaptive execution splitting a partition
    that is too large for one file, so a task writes few files.
    """
    dealt = rows.hint("rebalance", *by)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
