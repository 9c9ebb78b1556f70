"""A local session with the settings the library expects; clusters bring their own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def long_expressions(spark: SparkSession) -> None:
    """Have Spark cut long generated code into small methods, in this session from here on.

    Java leaves methods of over 8,000 bytes uncompiled, and Spark fuses a chain of long projections into one such method.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def joins_by_series(spark: SparkSession) -> None:
    """Have joins on symbol and date use tables hashed by symbol as they are, in this session from here on."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def local_session(cores: str | int | None = None, name: str = "barline") -> SparkSession:
    n = cores or os.environ.get("BENCH_CPUS") or 8
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
