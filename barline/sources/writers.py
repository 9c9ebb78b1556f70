"""Writers and staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.sources.schemas import KEYS


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables inside the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` as compressed Parquet in the shared folder: wide rows take less room than in a checkpoint, and readers take the columns they need."""
    path = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], created: str = "created_at") -> DataFrame:
    """Rows of ``incoming`` win by key over ``current``; ``created`` keeps its first value.

    Columns that ``incoming`` does not have keep the current value.  Several
    incoming rows per key: the last in ``__seq`` wins when given.
    """
    keys = list(keys)
    supplied = [c for c in incoming.columns if c not in keys and c not in (created, "__seq")]
    extra = [c for c in current.columns if c not in keys and c not in supplied and c != created]
    order = F.struct(F.col("__new"), F.col("__seq"))
    seq = F.col("__seq") if "__seq" in incoming.columns else F.lit(0).cast("long")
    old = current.withColumns({"__new": F.lit(0), "__seq": F.lit(0).cast("long")})
    new = incoming.withColumns({"__new": F.lit(1), "__seq": seq.cast("long")})
    both = old.unionByName(new, allowMissingColumns=True)
    aggs = []
    if supplied:
        aggs.append(F.max_by(F.struct(*supplied), order).alias("__v"))
    for c in extra:
        aggs.append(F.max(F.when(F.col("__new") == 0, F.col(c))).alias(c))
    if created in both.columns:
        aggs.append(F.min_by(created, order).alias(created))
    out = both.groupBy(*keys).agg(*aggs)
    picks = [F.col(f"__v.{c}").alias(c) if c in supplied else F.col(c) for c in current.columns]
    return out.select(*picks)


def outside_range(df: DataFrame, column: str, start: str | None, end: str | None, also: Column | None = None) -> DataFrame:
    """Rows that a delete of ``column`` in [start, end] (and ``also``) leaves."""
    hit = F.lit(True)
    if start:
        hit = hit & (F.col(column) >= F.lit(start).cast("date"))
    if end:
        hit = hit & (F.col(column) <= F.lit(end).cast("date"))
    if also is not None:
        hit = hit & also
    return df.where(~F.coalesce(hit, F.lit(False)))


def replace_range(current: DataFrame, fresh: DataFrame, start: str, end: str, column: str = "trade_date") -> DataFrame:
    """Delete a date range, then insert: the same call twice gives the same table."""
    inside = fresh.where(F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return outside_range(current, column, start, end).unionByName(inside, allowMissingColumns=True)


def rebuild_range(fresh: DataFrame, path: str, partition: str = "trade_month") -> None:
    """Overwrite only the partitions that ``fresh`` touches."""
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def bad_records(df: DataFrame, domain: str, message: Column | str) -> DataFrame:
    """Failing rows with their business key and the whole row as JSON."""
    names = [F.col(c).cast("string") for c in ("symbol", "news_id", "announcement_id") if c in df.columns]
    nonblank = [F.when(c != "", c) for c in names]
    text = F.lit(message) if isinstance(message, str) else message
    return df.select(
        F.lit(domain).alias("domain"),
        F.coalesce(*nonblank, F.lit("")).alias("business_key"),
        F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("payload"),
        text.alias("error_message"),
    )


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL, timestamps to ISO text, nested values to JSON text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast each column to its declared type; what does not fit becomes NULL, nested values become JSON."""
    want = {f.name: f.dataType for f in schema.fields}
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if name in want:
            nested = kind.startswith(("array", "map", "struct"))
            if nested:
                c = F.to_json(c)
            else:
                c = c.try_cast(want[name])
        out.append(c.alias(name))
    return df.select(*out)


def write_table(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """Parquet by month of the natural date, sorted by key so that row groups prune."""
    key = KEYS[table]
    date = "trade_date" if "trade_date" in df.columns else "asof_date"
    out = df.withColumn("trade_month", F.date_format(date, "yyyy-MM"))
    out.repartition("trade_month", key[0]).sortWithinPartitions(*key).write.mode(mode).partitionBy("trade_month").parquet(path)


def write_predictions(df: DataFrame, folder: str, meta: dict[str, str] | None = None) -> None:
    """Parquet, CSV and a metadata JSON, by date and falling signal."""
    ordered = df.orderBy("trade_date", F.col("signal_score").desc(), "symbol")
    ordered.write.mode("overwrite").parquet(f"{folder}/predictions")
    flat = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    ordered.select(*flat).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(f"{folder}/predictions_csv")
    stats = df.agg(F.count("*").alias("rows"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))
    extra = {k: F.lit(v) for k, v in (meta or {}).items()}
    stats.withColumns(extra).write.mode("overwrite").json(f"{folder}/metadata")


def write_latest_and_archive(df: DataFrame, folder: str, stamp: str) -> None:
    """The same rows under ``latest`` and under the date stamp, with a manifest of counts.

    The archive is written once and the latest copy is read back from it.
    """
    archive = f"{folder}/archive/{stamp}"
    df.write.mode("overwrite").parquet(archive)
    saved = df.sparkSession.read.parquet(archive)
    saved.write.mode("overwrite").parquet(f"{folder}/latest")
    saved.agg(
        F.count("*").alias("rows"), F.countDistinct("symbol").alias("symbols"), F.max("trade_date").alias("trade_date")
    ).withColumn("stamp", F.lit(stamp)).write.mode("overwrite").json(f"{folder}/manifest")

