"""Spark session and table helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A local session with adaptive execution, for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "8g")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
