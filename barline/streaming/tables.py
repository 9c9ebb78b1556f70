"""Exactly-once tables for micro-batches.

A batch writes its rows under its own id and overwrites them when it is run again,
so a retry changes nothing.  The current table is the newest row per key: merging
happens on reading, and no batch rewrites rows it did not touch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_batch(rows: DataFrame, path: str, batch_id: int, parts: Sequence[str] = ()) -> None:
    """``parts`` are columns whose values become folders inside the batch; their rows are brought together first, large parts in several tasks."""
    rows = rows.hint("rebalance", *parts) if parts else rows
    rows.write.mode("overwrite").partitionBy(*parts).parquet(f"{path}/batch={batch_id}")


def rewritten(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` as stored under ``path``, in place of those of the batch before."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def all_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def current(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest row per key; one partial aggregation."""
    log = all_batches(spark, path)
    values = [c for c in log.columns if c not in keys and c != "batch"]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch").cast("long")).alias("r"))
    return newest.select(*keys, "r.*")


def previous_batch(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The rows that the batch right before wrote, None for the first one; no other folder is listed or read."""
    return spark.read.parquet(f"{path}/batch={batch_id - 1}") if batch_id else None


def nothing_written(error: AnalysisException) -> bool:
    """No folder yet, or only batches without rows in their parts."""
    return any(kind in str(error) for kind in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"))


def earlier_batches(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """Rows of the batches before ``batch_id``, None when there is none; a batch that runs again does not see itself."""
    if batch_id == 0:
        return None
    try:
        log = all_batches(spark, path)
    except AnalysisException as missing:
        if not nothing_written(missing):
            raise
        return None
    return log.where(F.col("batch").cast("long") < batch_id)


def compact(spark: SparkSession, path: str, target: str, keys: Sequence[str]) -> None:
    """Fold all batches into one under a new path, numbered as the newest, so that a running stream can go on there."""
    newest = all_batches(spark, path).agg(F.max(F.col("batch").cast("long"))).first()[0]
    write_batch(current(spark, path, keys), target, newest)
