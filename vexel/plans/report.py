"""Measured recall, throughput and latency of a search."""

from __future__ import annotations

import time

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from vexel.operators import metrics
from vexel.plans.search import Index, SearchOptions, search


def timed(df: DataFrame) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def measure(index: Index, queries: DataFrame, truth: DataFrame, options: SearchOptions, single: int = 0) -> dict[str, float]:
    """Recall at k against truth (query_id, id), queries a second in one batch, and p50 and p99 of `single` jobs of one query each, in ms."""
    n, found = queries.count(), search(index, queries, options)
    seconds = timed(found)
    recall = metrics.recall(found, truth, options.k).agg(F.avg("recall")).first()[0]
    out = {"recall": round(float(recall), 4), "queries_per_sec": round(n / seconds, 1)}
    if single:
        one = [timed(search(index, queries.where(F.col("query_id") == r[0]), options)) * 1000 for r in queries.select("query_id").limit(single).collect()]
        out |= {"p50_ms": round(float(np.percentile(one, 50)), 1), "p99_ms": round(float(np.percentile(one, 99)), 1)}
    return out


def matrix(index: Index, queries: DataFrame, truth: DataFrame, rows: dict[str, SearchOptions], single: int = 0) -> dict[str, dict[str, float]]:
    """measure() for several options by name."""
    return {name: measure(index, queries, truth, o, single) for name, o in rows.items()}
