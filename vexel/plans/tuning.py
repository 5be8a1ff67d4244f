"""Recommended search options by size of the index."""

from __future__ import annotations

from vexel.operators.ivf import default_num_partitions
from vexel.plans.search import SearchOptions


def _clamp(x: int, lo: int, hi: int) -> int:
    return max(lo, min(hi, x))


def recommend(n: int, k: int = 10) -> dict[str, SearchOptions]:
    """Options for low latency, balance and high recall."""
    parts = default_num_partitions(n)
    if n < 10_000:
        balanced = SearchOptions(k=k, nprobe=min(parts, 50), refine_k=20 * k)
    elif n < 1_000_000:
        balanced = SearchOptions(k=k, nprobe=50, refine_k=1000)
    else:
        balanced = SearchOptions(k=k, nprobe=_clamp(parts // 100, 100, 300), refine_k=5000)
    return {
        "latency": SearchOptions(k=k, nprobe=16, refine_k=10 * k, query_bits=8),
        "balanced": balanced,
        "recall": SearchOptions(k=k, nprobe=_clamp(parts // 10, 100, 300), refine_k=5000),
    }
