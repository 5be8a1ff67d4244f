"""Quality and latency measures."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from vexel.operators.ordered import running
from vexel.shared import cut


def recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, hits, recall): share of the k true ids (query_id, id) among the results."""
    found = results.select("query_id", "id").distinct().join(truth.select("query_id", "id"), ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    hits = F.coalesce("hits", F.lit(0))
    return truth.select("query_id").distinct().join(found, "query_id", "left").select("query_id", hits.alias("hits"), (hits / k).alias("recall"))


def rank_percentiles(rows: DataFrame, value: str, by: list[str], shares: dict[str, int]) -> DataFrame:
    """Values at place n * percent // 100 of each group's order, by name."""
    r = running(rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v")), by, ["v"])
    sizes = cut(r.groupBy(*[F.col(c).alias(f"__of_{c}") for c in by]).agg(F.count(F.lit(1)).alias("n")))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by], F.lit(True))
    r = r.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, same)
    return r.groupBy(*by).agg(*[F.max(F.when(F.col("__place") == F.floor(F.col("n") * p / 100), F.col("v"))).alias(name) for name, p in shares.items()])


def interpolated_percentiles(rows: DataFrame, value: str, by: list[str], shares: dict[str, int]) -> DataFrame:
    """Percentiles of each group between the two nearest values; values are counted in the tasks first."""
    return rows.groupBy(*by).agg(*[F.percentile(F.col(value), F.lit(p / 100)).alias(name) for name, p in shares.items()])


def spearman(rows: DataFrame, a: str, b: str, by: list[str], tie: str) -> DataFrame:
    """(by, rho): 1 - 6 sum d^2 / (n (n^2 - 1)) of the ranks of a and b, ties broken by `tie`."""
    columns = list(dict.fromkeys([*by, a, b, tie]))
    r = running(rows.select(*columns), by, [a, tie]).withColumnRenamed("__place", "__a").drop("__before")
    r = running(r, by, [b, tie]).withColumn("d", (F.col("__a") - F.col("__place")).cast("double"))
    n = F.count(F.lit(1)).cast("double")
    return r.groupBy(*by).agg((1 - 6 * F.sum(F.col("d") * F.col("d")) / (n * (n * n - 1))).alias("rho"))
