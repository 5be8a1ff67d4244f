"""Inverted-file partitioning: centroids, assignment, Lloyd iterations, routing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from vexel.functions.vectors import doubles, l2_squared
from vexel.operators.knn import closest

#: Centroids are sent to the tasks; there are at most this many, of so many bytes together.
MOST_PARTITIONS, MOST_BYTES = 65_536, 512 << 20
Centroids = DataFrame | tuple[np.ndarray, np.ndarray]


def default_num_partitions(n: int) -> int:
    return 4 if n < 4 else int(min(65_536, max(4, int(n**0.5))))


def centroid_matrix(centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """(pids, matrix) of (pid, centroid), within MOST_PARTITIONS and MOST_BYTES."""
    if isinstance(centroids, tuple):
        return centroids
    size = centroids.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("centroid") * 8), F.lit(0)).alias("bytes")).first()
    if size["n"] > MOST_PARTITIONS or size["bytes"] > MOST_BYTES:
        raise ValueError(f"more than {MOST_PARTITIONS} centroids or {MOST_BYTES} bytes")
    rows = centroids.select("pid", doubles(F.col("centroid"))).orderBy("pid").collect()
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64)


def centroids_of(vectors: DataFrame, pid: str, vec_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """(pid, centroid): component means of each group."""
    flat = vectors.where(F.col(pid).isNotNull()).select(F.col(pid).cast("long").alias("pid"), F.posexplode(doubles(F.col(vec_col))).alias("pos", "x"))
    mean = F.avg("x") if digits is None else F.round(F.avg("x"), digits)
    means = flat.groupBy("pid", "pos").agg(mean.alias("m"))
    return means.groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def assign(vectors: DataFrame, centroids: Centroids, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, pid, distance): the nearest centroid of each vector, the lowest pid of equals."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroid_matrix(centroids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pids, c = sent.value
        for b in batches:
            if len(b):
                at, d = closest(np.array(b["v"].tolist()), c)
                yield pd.DataFrame({"id": b["id"], "pid": pids[at], "distance": d})

    return vectors.select(F.col(id_col).cast("long").alias("id"), doubles(F.col(vec_col)).alias("v")).mapInPandas(run, "id long, pid long, distance double")


def lloyd_step(vectors: DataFrame, centroids: Centroids, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(pid, centroid) after one assignment and mean; sums are taken in the tasks first. Partitions without vectors are missing."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroid_matrix(centroids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pids, c = sent.value
        sums, counts = np.zeros_like(c), np.zeros(len(c), dtype=np.int64)
        for b in batches:
            if len(b):
                x = np.array(b["v"].tolist())
                at, _ = closest(x, c)
                np.add.at(sums, at, x)
                counts += np.bincount(at, minlength=len(c))
        full = counts > 0
        if full.any():
            yield pd.DataFrame({"pid": pids[full], "sums": list(sums[full]), "n": counts[full]})

    part = vectors.select(doubles(F.col(vec_col)).alias("v")).mapInPandas(run, "pid long, sums array<double>, n long")
    flat = part.select("pid", "n", F.posexplode("sums").alias("pos", "s")).groupBy("pid", "pos").agg((F.sum("s") / F.sum("n")).alias("m"))
    return flat.groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def farthest(vectors: DataFrame, centroids: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(pid, id, distance): the vector farthest from each centroid among its own; a seed for empty partitions."""
    near = assign(vectors, centroids, id_col, vec_col)
    return near.groupBy("pid").agg(F.max_by("id", F.struct("distance", -F.col("id"))).alias("id"), F.max("distance").alias("distance"))


def seeds(vectors: DataFrame, k: int, rounds: int = 5, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> np.ndarray:
    """k starting centroids by seeded D^2 sampling: a vector is drawn with a chance in proportion to its squared distance from those drawn before.

    Every round draws about k / 2 vectors at once; of the 2.5 k drawn in all, weighted by the vectors nearest to each, k are
    chosen in the same way on the driver.
    """
    k = min(k, MOST_PARTITIONS)
    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("vec_id"), doubles(F.col(vec_col)).alias("embedding"))
    chance = lambda r: F.pmod(F.xxhash64(F.lit(seed), F.lit(r), "vec_id"), F.lit(1 << 40)) / float(1 << 40)
    first = rows.orderBy(chance(0), "vec_id").limit(1).collect()
    c = np.array([r["embedding"] for r in first])
    if not len(c):
        return c
    for r in range(1, rounds + 1):
        far = assign(rows, (np.arange(len(c)), c)).withColumnRenamed("id", "vec_id")
        total = far.agg(F.sum("distance")).first()[0] or 0.0
        if total <= 0:
            break
        drawn = far.where(chance(r) * total < F.col("distance") * max(1.0, k / 2)).select("vec_id")
        found = drawn.join(rows, "vec_id").orderBy("vec_id").limit(2 * k).collect()
        c = np.unique(np.concatenate([c, np.array([x["embedding"] for x in found]).reshape(-1, c.shape[1])]), axis=0)
    weight = np.ones(len(c))
    for r in assign(rows, (np.arange(len(c)), c)).groupBy("pid").count().collect():
        weight[r["pid"]] = r["count"]
    return weighted_seeds(c, weight, k, np.random.default_rng(seed))


def weighted_seeds(c: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Up to k different rows of c, each drawn by weight times squared distance from those before."""
    chosen, d = [int(rng.choice(len(c), p=weight / weight.sum()))], np.full(len(c), np.inf)
    while len(chosen) < min(k, len(c)):
        d = np.minimum(d, ((c - c[chosen[-1]]) ** 2).sum(axis=1))
        p = d * weight
        if p.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(c), p=p / p.sum())))
    return c[chosen]


def kmeans(vectors: DataFrame, k: int, rounds: int = 20, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(pid, centroid) after up to `rounds` Lloyd steps from `seeds`; an empty partition takes the vector farthest from its centroid.

    Only centroids (within MOST_PARTITIONS and MOST_BYTES) come to the driver.
    """
    c = seeds(vectors, k, seed=seed, id_col=id_col, vec_col=vec_col)
    for _ in range(rounds if len(c) else 0):
        now = np.arange(len(c)), c
        pids, means = centroid_matrix(lloyd_step(vectors, now, id_col, vec_col))
        moved = c.copy()
        moved[pids] = means
        empty = sorted(set(range(len(c))) - set(pids.tolist()))
        if empty:
            far = assign(vectors, now, id_col, vec_col).orderBy(F.desc("distance"), "id").limit(len(empty))
            found = far.join(vectors.select(F.col(id_col).alias("id"), doubles(F.col(vec_col)).alias("v")), "id").orderBy(F.desc("distance"), "id").collect()
            for pid, r in zip(empty, found):
                moved[pid] = r["v"]
        if np.allclose(moved, c, rtol=0, atol=1e-9):
            break
        c = moved
    return vectors.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "pid long, centroid array<double>")


def route(queries: DataFrame, centroids: DataFrame, nprobe: int = 0) -> DataFrame:
    """(query_id, rank, pid, distance) of the nprobe nearest partitions of each query (query_id, q); 0: all."""
    from vexel.operators.knn import nearest

    pids = centroids.select(F.col("pid").alias("vec_id"), F.col("centroid").alias("embedding"))
    return nearest(pids, queries, nprobe or max(1, centroids.count())).withColumnRenamed("id", "pid")


def l2_to(column: str, other: str):
    return l2_squared(doubles(F.col(column)), doubles(F.col(other)))
