"""Tables cut off from their lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session may have a folder of its own where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vexel-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder; what follows reads it from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder, and read again."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def join_small(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most: int = 100_000) -> DataFrame:
    """rows joined with a table that is mostly small: broadcast if it has up to `most` rows, else an ordinary join."""
    small = cut(small)
    return rows.join(F.broadcast(small) if small.count() <= most else small, on, how)
