"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Runtime settings every job relies on. They only switch on behaviour that is safe at any size;
# partition counts and memory stay with the cluster's own configuration.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows with long texts or sets: a batch for Python is bounded in bytes, not only in rows
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    # Adaptive coalescing may give the sides of a union different partition counts; a union that
    # claims one common partitioning then fails, so it must not claim it.
    "spark.sql.unionOutputPartitioning": "false",
}

_local_dirs: dict[str, str] = {}
_written: list[str] = []  # intermediate tables of this process, oldest first


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session (tests, a laptop), where that
    is unset, takes a folder of its own, and it is set on the context so ``checkpoint()`` uses it too.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not is_local(spark.sparkContext.master):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="run-")
        spark.sparkContext.setCheckpointDir(_local_dirs[app])
    return _local_dirs[app]


def is_local(master: str) -> bool:
    """Whether driver and executors are one process on one machine."""
    return master == "local" or master.startswith("local[")


def new_work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; never reused between runs."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so iteration survives a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder; later stages read it instead of redoing it."""
    path = new_work_path(df.sparkSession, label)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    """How many intermediate tables there are; a mark for ``empty_written``."""
    return len(_written)


def empty_written(spark: SparkSession, since: int, until: int) -> None:
    """Empty the tables between two marks. Only for tables that no DataFrame still in use reads."""
    for path in _written[since:until]:
        spark.range(0).write.mode("overwrite").parquet(path)
