import pyspark.sql.functions as F
import pytest

from vexel.operators import codes, fusion, ivf, knn, metrics, pruning
from vexel.plans import search as plan
from vexel.plans.tuning import recommend
from vexel.sources.files import gaussian


@pytest.fixture(scope="module")
def index(spark):
    vectors = spark.createDataFrame(
        gaussian(spark, 400, 64, seed=2).withColumn("tag", F.when(F.col("vec_id") % 3 == 0, "a").otherwise("b")).collect()
    )
    return plan.build(vectors, ivf.kmeans(vectors, 8, rounds=3), codes.random_rotation(64))


def questions(index):
    return index.rows.where("id % 40 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))


def found(df):
    return {(r.query_id, r["rank"]): r.id for r in df.collect()}


def test_all_partitions_with_full_depth_is_exact(index):
    q = questions(index)
    want = found(knn.nearest(index.rows, q, 5, id_col="id"))
    assert found(plan.search(index, q, plan.SearchOptions(k=5))) == want
    assert found(plan.search(index, q, plan.SearchOptions(k=5, nprobe=8, refine_k=400))) == want


def test_condition_filters_before_the_search(index):
    q, where = questions(index), F.col("tag") == "a"
    want = found(knn.nearest(index.rows.where(where), q, 5, id_col="id"))
    assert found(plan.search(index, q, plan.SearchOptions(k=5, nprobe=8, refine_k=400), where)) == want


@pytest.mark.parametrize("bits, floor", [(0, 0.6), (4, 0.6), (8, 0.6)])
def test_recall_of_codes(index, bits, floor):
    q = questions(index)
    got = plan.search(index, q, plan.SearchOptions(k=5, nprobe=8, refine_k=60, query_bits=bits))
    r = metrics.recall(got, knn.nearest(index.rows, q, 5, id_col="id"), 5).agg(F.avg("recall")).first()[0]
    assert r >= floor


def test_sq8_and_unrefined(index):
    q = questions(index)
    assert plan.search(index, q, plan.SearchOptions(k=5, nprobe=8, refine_k=400, sq8_refine=True)).where("rank = 1 and query_id = id").count() == 10
    assert plan.search(index, q, plan.SearchOptions(k=5, nprobe=2, refine=False)).count() == 50


def test_bad_options():
    for bad in ({"k": 0}, {"query_bits": 3}, {"sq8_refine": True, "refine": False}):
        with pytest.raises(ValueError):
            plan.SearchOptions(**bad)


def test_recommendations():
    assert recommend(5_000)["balanced"] == plan.SearchOptions(k=10, nprobe=50, refine_k=200)
    assert recommend(100)["balanced"].nprobe == 10
    assert recommend(100_000)["balanced"] == plan.SearchOptions(k=10, nprobe=50, refine_k=1000)
    assert recommend(10_000_000)["balanced"].nprobe == 100
    assert recommend(100_000)["latency"] == plan.SearchOptions(k=10, nprobe=16, refine_k=100, query_bits=8)
    assert recommend(65536**2)["recall"].nprobe == 300


def test_fusion(spark):
    lists = spark.createDataFrame([("x", r, i, 0.0) for r, i in ((1, 1), (2, 2), (3, 3))] + [("y", r, i, 0.0) for r, i in ((1, 2), (2, 3), (3, 4))], "list_id string, rank long, id long, score double")
    assert [r.id for r in fusion.top(fusion.reciprocal_rank(lists, 60.0), 4).collect()] == [2, 3, 1, 4]
    scored = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 0.5), ("y", 2, 1.0), ("y", 3, 0.5)], "list_id string, id long, score double")
    got = {r.id: r.score for r in fusion.weighted(scored, {"x": 0.5, "y": 0.5}).collect()}
    assert got == {1: 0.5, 2: 0.75, 3: 0.25}


def test_pruning_is_sound(spark):
    rows = spark.createDataFrame([(p, float(p * 10 + i), f"t{p}-{i}") for p in range(4) for i in range(10)] + [(9, 5.0, f"w{i}") for i in range(100)], "p long, score double, tag string")
    pids = rows.select(F.col("p").alias("pid")).distinct()
    numbers = pruning.number_stats(rows, "p", {"score": F.col("score")})
    for op, x, test in (("gt", 25, F.col("score") > 25), ("le", 9, F.col("score") <= 9), ("eq", 15, F.col("score") == 15), ("ne", 5, F.col("score") != 5)):
        kept = {r.pid for r in pruning.surviving(pids, numbers, "score", pruning.may_match_number(op, x)).collect()}
        assert {r.p for r in rows.where(test).select("p").distinct().collect()} <= kept
    assert {r.pid for r in pruning.surviving(pids, numbers, "score", pruning.may_match_number("gt", 25)).collect()} == {2, 3}
    strings = pruning.string_stats(rows, "p", {"tag": F.col("tag")})
    assert {r.pid for r in pruning.surviving(pids, strings, "tag", pruning.may_match_string(["w99", "t1-1"])).collect()} == {1, 9}
    assert pruning.surviving(pids, strings, "no stats", pruning.may_match_string(["x"])).count() == 5


def test_stored_index(spark, tmp_path):
    vectors = gaussian(spark, 300, 64, seed=4).withColumns({"tag": F.when(F.col("vec_id") % 3 == 0, "a").otherwise("b"), "score": F.col("vec_id").cast("double")})
    vectors = spark.createDataFrame(vectors.collect())
    fields = {"numbers": {"score": F.col("score")}, "strings": {"tag": F.col("tag")}}
    at = str(tmp_path / "index")
    plan.save(plan.train(vectors.where("vec_id < 200"), 6, rounds=3, **fields), at)
    for _ in range(2):  # a batch that is added again replaces itself
        plan.add(spark, at, vectors.where("vec_id >= 200"), "more", **fields)
    index = plan.load(spark, at)
    assert index.rows.count() == 300 and index.summaries.count() == 6
    q = questions(index)
    want = found(knn.nearest(vectors, q, 5))
    assert found(plan.search(index, q, plan.SearchOptions(k=5))) == want
    assert found(plan.search(index, q, plan.SearchOptions(k=5, nprobe=6, refine_k=300))) == want
    where = (F.col("score") >= 250) & (F.col("tag") == "a")
    prune = pruning.may("score", "ge", 250) & pruning.may("tag", "in", ["a"])
    want = found(knn.nearest(vectors.where(where), q, 5))
    for options in (plan.SearchOptions(k=5), plan.SearchOptions(k=5, nprobe=6, refine_k=300)):
        assert found(plan.search(index, q, options, where, prune=prune)) == want
    few = plan.search(index, q.limit(1), plan.SearchOptions(k=5, nprobe=1, refine=False))
    assert "PartitionFilters: [pid" in few._jdf.queryExecution().executedPlan().toString() or "pid" in few._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert plan.search(index, q, plan.SearchOptions(k=5), prune=pruning.may("score", "gt", 1e9)).count() == 0


def test_seeds_spread_over_groups(spark):
    import numpy as np

    r = np.random.default_rng(3)
    centres = r.standard_normal((12, 8)) * 50
    rows = [(i, (centres[i % 12] + r.standard_normal(8)).tolist()) for i in range(360)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    c = ivf.seeds(vectors, 12)
    assert sorted({int(((centres - x) ** 2).sum(axis=1).argmin()) for x in c}) == list(range(12))
    assert (c == ivf.seeds(vectors.repartition(3), 12)).all()
    assert len(ivf.seeds(vectors.limit(3), 12)) <= 3 and ivf.kmeans(vectors.limit(0), 4).count() == 0


def test_places_and_sums_in_order(spark):
    from vexel.operators.ordered import running

    rows = [(i, None if i % 3 == 0 else i % 3, i % 7, i % 5) for i in range(200)]
    got = running(spark.createDataFrame(rows, "i int, g int, o int, x int"), ["g"], ["o", "i"], "x").collect()
    for g in (None, 1, 2):
        mine = sorted((r for r in got if r.g == g), key=lambda r: (r.o, r.i))
        assert [r["__place"] for r in mine] == list(range(len(mine)))
        assert [r["__before"] for r in mine] == [sum(x.x for x in mine[:k]) for k in range(len(mine))]


def test_codes_are_estimated_in_small_pieces():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    q, words = r.standard_normal((4096, 64)), r.integers(-(2**62), 2**62, 10_000)
    b = pa.RecordBatch.from_pydict({"id": np.arange(10_000), "code": pa.array([[int(w)] for w in words], pa.list_(pa.int64())), "alpha": r.random(10_000), "beta": r.random(10_000)})
    score = plan.score_of(plan.SearchOptions(query_bits=4), False)
    tracemalloc.start()
    top, x = knn.Best(len(q), 10), plan.Coded(b, 64, None, None)
    for i, j in knn.tiles(len(q), len(x.ids)):
        top.offer(i, x.ids[j], x.estimates(q, i, j, score, 6))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # all pairs at once took 328 MB a matrix, several of them
    for i in (0, 700, 4095):
        d = np.round(score(q[i : i + 1], x.signs, x.alpha, x.beta)[0], 6)
        assert top.rows[i].tolist() == np.lexsort((x.ids, d))[:10].tolist()


def test_blocks_of_queries_find_the_same_codes(spark, index, monkeypatch):
    q = questions(index)
    for options in (plan.SearchOptions(k=5, refine=False, query_bits=8), plan.SearchOptions(k=5, nprobe=3, refine=False)):
        want = found(plan.search(index, q, options, digits=6))
        with monkeypatch.context() as m:
            m.setattr(plan, "query_blocks", lambda queries, size, f=plan.query_blocks: f(queries, 3))
            assert found(plan.search(index, q, options, digits=6)) == want and len(want) == 50


def test_many_candidates_are_bounded_by_counts(spark, monkeypatch):
    rows = gaussian(spark, 300, 64, seed=5)
    copies = rows.where("vec_id < 4").crossJoin(spark.range(1, 62)).select((F.col("vec_id") + 1000 * F.col("id")).alias("vec_id"), *[c for c in rows.columns if c != "vec_id"])
    vectors = spark.createDataFrame(rows.unionByName(copies).collect()).repartition(3)
    index = plan.build(vectors, ivf.kmeans(rows, 6, rounds=2), codes.random_rotation(64))
    q = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    written = []
    monkeypatch.setattr(plan, "scan_codes", lambda *a, f=plan.scan_codes, **b: written.append(a) or f(*a, **b))
    for options in (plan.SearchOptions(k=5, nprobe=4, refine_share=0.3, query_bits=4), plan.SearchOptions(k=7, nprobe=0, refine_share=0.5, sq8_refine=True), plan.SearchOptions(k=5, nprobe=5, refine_share=1.0)):
        monkeypatch.setattr(plan, "SHIPPED", 1024)
        want = found(plan.search(index, q, options, digits=6))
        assert written and len(want) == options.k * q.count()
        written.clear()
        monkeypatch.setattr(plan, "SHIPPED", 16)
        for beside in (256, 4):
            monkeypatch.setattr(plan, "BESIDE", beside)
            assert found(plan.search(index, q, options, digits=6)) == want
        assert not written  # no candidates of each query
