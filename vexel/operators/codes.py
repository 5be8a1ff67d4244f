"""One-bit codes of rotated vectors, quantized queries, and 8-bit scalar quantization.

The code of a rotated vector r holds the sign bit of each component, alpha = sum r^2 and beta = sum |r| / (sqrt(alpha) + 1.9)
(`scaled=True`: sum |r| / sqrt(D)). The estimate of a squared distance is
alpha_q + alpha_x - 2 beta_q beta_x (D - 2 h) / D with h the number of differing signs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from vexel.functions.vectors import doubles, total

EPSILON = 1.9


def hadamard(dim: int) -> np.ndarray:
    """The normalised Hadamard matrix; dim is a power of two."""
    if dim & (dim - 1):
        raise ValueError("dim must be a power of two")
    i = np.arange(dim)
    parity = np.array([[int(a & b).bit_count() & 1 for b in i] for a in i])
    return (1 - 2 * parity) / np.sqrt(dim)


def random_rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A seeded random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def rotated(vectors: DataFrame, matrix: np.ndarray, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, r): the vectors times the matrix."""
    sent = vectors.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "r": list(np.array(b["v"].tolist()) @ sent.value.T)})

    return vectors.select(F.col(id_col).cast("long").alias("id"), doubles(F.col(vec_col)).alias("v")).mapInPandas(run, "id long, r array<double>")


def words(r: Column, dim: int) -> Column:
    """Sign bits of a rotated vector as 64-bit words, lowest bit first."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def word(w: int) -> Column:
        bit = lambda b: F.when(F.element_at(r, b + 1 + 64 * w) >= 0, F.call_function("shiftleft", one, b)).otherwise(zero)
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, lambda acc, b: acc.bitwiseOR(bit(b)))

    return F.array(*[word(w) for w in range(dim // 64)])


def encode(rows: DataFrame, dim: int, scaled: bool = False) -> DataFrame:
    """(id, code, alpha, beta) of rotated rows (id, r); dim is a multiple of 64."""
    if dim % 64:
        raise ValueError("dim must be a multiple of 64")
    alpha, size = total(F.transform("r", lambda x: x * x)), total(F.transform("r", F.abs))
    beta = size / (F.sqrt(alpha) + EPSILON) if not scaled else size / float(np.sqrt(dim))
    return rows.select("id", words(F.col("r"), dim).alias("code"), alpha.alias("alpha"), beta.alias("beta"))


def estimate(h: Column, alpha_q: Column, beta_q: Column, alpha_x: Column, beta_x: Column, dim: int) -> Column:
    return alpha_q + alpha_x - 2 * beta_q * beta_x * (dim - 2 * h) / dim


def quantized(r: Column, bits: int) -> Column:
    """struct(levels, scale, total): the components' magnitudes on 2^bits - 1 levels."""
    if bits not in (1, 2, 4, 8):
        raise ValueError("bits must be 1, 2, 4 or 8")
    top, levels = F.array_max(F.transform(r, F.abs)), float(2**bits - 1)
    v = F.transform(r, lambda x: F.when(top > 0, F.round(F.abs(x) / top * levels)).otherwise(0.0).cast("long"))
    return F.struct(v.alias("levels"), F.when(top > 0, top / levels).otherwise(1.0).alias("scale"), F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def sq8_stats(vectors: DataFrame, pid: str, vec_col: str = "embedding") -> DataFrame:
    """(pid, lo, hi): component minima and maxima of each partition."""
    flat = vectors.select(F.col(pid).cast("long").alias("pid"), F.posexplode(doubles(F.col(vec_col))).alias("pos", "x")).groupBy("pid", "pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "lo", "hi")))
    return flat.groupBy("pid").agg(F.transform(rows, lambda s: s["lo"]).alias("lo"), F.transform(rows, lambda s: s["hi"]).alias("hi"))


def sq8_encode(v: Column, lo: Column, hi: Column) -> Column:
    z = F.arrays_zip(v.alias("v"), lo.alias("lo"), hi.alias("hi"))
    return F.transform(z, lambda s: F.when(s["hi"] > s["lo"], F.round((s["v"] - s["lo"]) / (s["hi"] - s["lo"]) * 255)).otherwise(0.0).cast("int"))


def sq8_decode(code: Column, lo: Column, hi: Column) -> Column:
    z = F.arrays_zip(code.alias("c"), lo.alias("lo"), hi.alias("hi"))
    return F.transform(z, lambda s: s["lo"] + s["c"] / F.lit(255.0) * (s["hi"] - s["lo"]))


def sq8_near(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Rows of v as they come back from 8 bits."""
    span = hi - lo
    steps = np.where(span > 0, (v - lo) / np.where(span > 0, span, 1) * 255, 0)
    return lo + np.floor(np.abs(steps) + 0.5) * np.sign(steps) / 255 * span
