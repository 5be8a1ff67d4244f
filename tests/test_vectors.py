import numpy as np
import pyspark.sql.functions as F
import pytest

from vexel.functions import vectors as v
from vexel.operators import codes, ivf, knn


def value(spark, column, **data):
    return spark.createDataFrame([tuple(data.values())], list(data)).select(column.alias("x")).first()["x"]


def test_kernels(spark):
    a, b = [1.0, 2.0, 3.0], [4.0, 5.0, 6.0]
    assert value(spark, v.dot(F.col("a"), F.col("b")), a=a, b=b) == 32
    assert value(spark, v.l2_squared(F.col("a"), F.col("b")), a=a, b=b) == 27
    assert value(spark, v.dot(F.col("a"), F.col("b")), a=[-1.0, -2.0, -3.0], b=b) == -32
    assert value(spark, v.l2_squared(F.col("a"), F.col("b")), a=[-1.0, -2.0, -3.0], b=b) == 155
    assert value(spark, v.normalized(F.col("a")), a=[0.0, 0.0]) is None
    assert value(spark, v.hamming(F.col("a"), F.col("b")), a=[0x0F0F0F0F0F0F0F0F, 1], b=[~0x0F0F0F0F0F0F0F0F, 1]) == 64


def test_checked_vectors(spark):
    df = spark.createDataFrame([([1.0, float("nan")],)], ["a"])
    with pytest.raises(Exception, match="2 finite components"):
        df.select(v.checked(F.col("a"), 2)).collect()


def test_default_partitions():
    got = {n: ivf.default_num_partitions(n) for n in (0, 3, 100, 1000, 100_000, 10_000_000, 65536**2)}
    assert got == {0: 4, 3: 4, 100: 10, 1000: 31, 100_000: 316, 10_000_000: 3162, 65536**2: 65536}


def test_rotations_are_orthogonal():
    for m in (codes.hadamard(64), codes.random_rotation(64)):
        assert np.allclose(m @ m.T, np.eye(64), atol=1e-9)
    with pytest.raises(ValueError):
        codes.hadamard(48)


def gaussian(spark, n, dim, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32)
    return x, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


def test_nearest_is_exact_and_blocks_agree(spark, monkeypatch):
    x, df = gaussian(spark, 300, 64)
    q = df.where("vec_id % 30 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    monkeypatch.setattr(knn, "query_blocks", lambda queries, size=3, f=knn.query_blocks: f(queries, 3))
    got = {(r.query_id, r["rank"]): r.id for r in knn.nearest(df, q, 5).collect()}
    for i in range(0, 300, 30):
        d = ((x.astype(float) - x[i].astype(float)) ** 2).sum(axis=1)
        assert [got[i, k] for k in range(1, 6)] == list(np.lexsort((np.arange(300), d))[:5])


def test_nearest_of_nothing(spark):
    _, df = gaussian(spark, 5, 64)
    q = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert knn.nearest(df, q.limit(0), 3).count() == 0
    assert knn.nearest(df.limit(0), q, 3).count() == 0
    with pytest.raises(ValueError):
        knn.nearest(df, q, 0)


def test_codes_follow_their_formula(spark):
    x, df = gaussian(spark, 20, 128, 3)
    m = codes.random_rotation(128)
    rows = codes.encode(codes.rotated(df, m), 128).orderBy("id").collect()
    r = x.astype(float) @ m.T
    for i, row in enumerate(rows):
        assert row.alpha == pytest.approx((r[i] ** 2).sum())
        assert row.beta == pytest.approx(np.abs(r[i]).sum() / (np.sqrt((r[i] ** 2).sum()) + 1.9))
        bits = [(w >> b) & 1 for w in row.code for b in range(64)]
        assert bits == (r[i] >= 0).astype(int).tolist()


def test_quantized_levels(spark):
    got = value(spark, codes.quantized(F.col("r"), 2), r=[0.0, -1.0, 0.5, 3.0])
    assert (got.levels, got.total) == ([0, 1, 1, 3], 5) and got.scale == pytest.approx(1.0)
    assert value(spark, codes.quantized(F.col("r"), 8), r=[0.0, 0.0]).scale == 1.0


def test_sq8_roundtrip(spark):
    lo, hi, x = [0.0, 5.0], [10.0, 5.0], [2.5, 5.0]
    df = spark.createDataFrame([(x, lo, hi)], ["v", "lo", "hi"])
    code = codes.sq8_encode(F.col("v"), F.col("lo"), F.col("hi"))
    got = df.withColumn("c", code).select("c", codes.sq8_decode(F.col("c"), F.col("lo"), F.col("hi")).alias("d")).first()
    assert got.c == [64, 0] and got.d == pytest.approx([64 / 255 * 10, 5.0])


def test_kmeans_lowers_the_error_and_fills_partitions(spark):
    _, df = gaussian(spark, 200, 8, 5)
    first, last = ivf.kmeans(df, 6, rounds=1), ivf.kmeans(df, 6, rounds=8)
    error = lambda c: ivf.assign(df, c).agg(F.sum("distance")).first()[0]
    assert error(last) <= error(first)
    assert ivf.assign(df, last).select("pid").distinct().count() == 6


def test_a_block_of_queries_is_measured_in_small_pieces():
    import tracemalloc

    r = np.random.default_rng(0)
    q, x, ids = r.standard_normal((4096, 16)), r.standard_normal((10_000, 16)), np.arange(10_000)
    tracemalloc.start()
    top = knn.Best(len(q), 50)
    for i, j in knn.tiles(len(q), len(x)):
        top.offer(i, ids[j], *knn.near(q[i], x[j], "l2"), knn.exactly(q[i], x[j]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20  # all pairs at once took 328 MB a matrix, several of them
    for i in (0, 700, 4095):
        assert top.rows[i].tolist() == np.lexsort((ids, ((x - q[i]) ** 2).sum(axis=1)))[:50].tolist()


def test_vectors_without_a_distance_hide_no_others(spark):
    x, _ = gaussian(spark, 60, 4)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, [float("nan")] * 4), (101, [float("inf")] * 4), (102, [None, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    q = df.where("vec_id in (3, 100)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    for metric in ("l2", "dot", "cosine"):
        assert [(r.query_id, r.id <= 60) for r in knn.nearest(df, q, 3, metric=metric).collect()] == [(3, True)] * 3


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_copies_are_ranked_by_id(spark, metric):
    x, _ = gaussian(spark, 40, 24, 9)
    df = spark.createDataFrame([(i, x[i % 40].tolist()) for i in range(840)], "vec_id long, embedding array<float>")
    q = df.where("vec_id < 40").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    for r in knn.nearest(df.repartition(3), q, 15, metric=metric).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("x")).collect():
        ids = [y.id for y in r.x]
        assert ids == list(range(ids[0] % 40, 840, 40))[:15]


def test_texts_are_embedded_once(spark, sf):
    from vexel.queries import registry

    found = registry.QUERIES["text_embedding_knn"](spark, sf)
    assert "xxhash64" not in found._jdf.queryExecution().toString()  # the vectors are read back, for queries and rows
