"""Rank fusion of result lists (list_id, rank, id, score)."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import Window as W


def with_rank(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """Adds a 1-based rank within each list."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long"))


def reciprocal_rank(lists: DataFrame, k: float = 60.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, id, score): sum of 1 / (k + rank) over the lists."""
    return lists.groupBy(*by, "id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))


def weighted(lists: DataFrame, weights: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, id, score): sum of weight times score; lists without a weight count nothing."""
    if not weights:
        return lists.select(*by, "id", F.lit(0.0).alias("score")).limit(0)
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    return lists.withColumn("w", F.element_at(w, F.col("list_id"))).where("w is not null").groupBy(*by, "id").agg(F.sum(F.col("w") * F.col("score")).alias("score"))


def top(fused: DataFrame, k: int) -> DataFrame:
    return fused.orderBy(F.desc("score"), "id").limit(k)
