"""Queries over the driver's tables and the SQL that gives the same rows. Query vectors are those with ids divisible by 20."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W

from vexel.functions import vectors as v
from vexel.functions.payload import Payload
from vexel.operators import codes, fulltext, fusion, ivf, knn, metrics, pruning, text
from vexel.plans import search as plan
from vexel.session import table
from vexel.shared import cut, shared_dir
from vexel.sources import files
from vexel.sources.versions import VersionedTable

DIM, K = 64, 10
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def emb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, q): the query vectors."""
    return emb(spark, sf).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6))


def means(spark: SparkSession, sf: str) -> DataFrame:
    """(pid, centroid): component means of each label, to six digits."""
    return ivf.centroids_of(emb(spark, sf), "label", digits=6)


# SQL parts
E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
Q = "q AS (SELECT vec_id AS query_id, v AS q FROM e WHERE vec_id % 20 = 0)"
C = "c AS (SELECT pid, list(m ORDER BY pos) AS c FROM (SELECT label AS pid, pos, round(avg(x), 6) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(64)) AS pos FROM e) GROUP BY ALL) GROUP BY pid)"


def l2_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, 65), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


def knn_sql(distance: str, where: str = "true", k: int = K, order: str = "d, vec_id") -> str:
    return f"""WITH {E}, {Q}, p AS (SELECT query_id, vec_id, {distance} AS d FROM e, q WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM p)
SELECT query_id, rank, vec_id AS id, round(d, 6) AS distance FROM r WHERE rank <= {k}"""


ASSIGN = f"a AS (SELECT vec_id, label, v, arg_min(pid, (d, pid)) AS pid, min(d) AS d FROM (SELECT e.*, pid, {l2_sql('v', 'c')} AS d FROM e, c) GROUP BY vec_id, label, v)"


# --- exact search ---


@query(knn_sql(l2_sql("v", "q")))
def flat_knn(spark, sf):
    return shown(knn.nearest(emb(spark, sf), asked(spark, sf), K))


@query(knn_sql(l2_sql("v", "q"), "label IN (1, 3, 5)"))
def filtered_knn(spark, sf):
    return shown(knn.nearest(emb(spark, sf), asked(spark, sf), K, F.col("label").isin(1, 3, 5)))


@query(knn_sql("-list_dot_product(v, q)"))
def dot_topk(spark, sf):
    return shown(knn.nearest(emb(spark, sf), asked(spark, sf), K, metric="dot"))


@query(knn_sql("1 - list_cosine_similarity(v, q)"))
def cosine_topk(spark, sf):
    return shown(knn.nearest(emb(spark, sf), asked(spark, sf), K, metric="cosine"))


@query(f"WITH {E} SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_dot_product(v, v), 6) AS dot FROM e")
def norm_check(spark, sf):
    x = v.doubles(v.checked(F.col("embedding"), DIM))
    return emb(spark, sf).select("vec_id", F.round(v.norm(x), 6).alias("norm"), F.round(v.dot(x, x), 6).alias("dot"))


@query(f"WITH {E}, n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e) SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(x / n, 6) AS x FROM (SELECT vec_id, n, unnest(v) AS x, unnest(range(64)) AS pos FROM n)")
def normalize(spark, sf):
    return emb(spark, sf).select("vec_id", F.posexplode(v.normalized(v.doubles(F.col("embedding")))).alias("pos", "x")).withColumn("x", F.round("x", 6))


# --- conditions on payloads ---

J = "json_extract(props, '$.\"k\"')"
NUM = f"(json_type({J}) IN ('BIGINT', 'UBIGINT', 'DOUBLE'))"
VAL = f"TRY_CAST(json_extract_string(props, '$.\"k\"') AS DOUBLE)"


def condition(sql: str):
    return query(f"SELECT event_id FROM events WHERE coalesce({sql}, false)")


def matching(spark, sf, test: Column) -> DataFrame:
    return table(spark, sf, "events").where(test).select("event_id")


P = Payload


@condition(f"{NUM} AND {VAL} = 69")
def filter_eq(spark, sf):
    return matching(spark, sf, P("props").eq("k", 69))


@condition(f"props IS NOT NULL AND NOT coalesce({NUM} AND {VAL} = 69, false)")
def filter_ne(spark, sf):
    return matching(spark, sf, P("props").ne("k", 69))


@condition("props IS NOT NULL")
def filter_ne_missing(spark, sf):
    return matching(spark, sf, P("props").ne("no such field", 1))


@condition(f"{NUM} AND {VAL} < 20")
def filter_lt(spark, sf):
    return matching(spark, sf, P("props").lt("k", 20))


@condition(f"{NUM} AND {VAL} <= 20")
def filter_le(spark, sf):
    return matching(spark, sf, P("props").le("k", 20))


@condition(f"{NUM} AND {VAL} > 80.5")
def filter_gt(spark, sf):
    return matching(spark, sf, P("props").gt("k", 80.5))


@condition(f"{NUM} AND {VAL} >= 80")
def filter_ge(spark, sf):
    return matching(spark, sf, P("props").ge("k", 80))


@condition(f"{NUM} AND {VAL} IN (1, 5, 9)")
def filter_in_num(spark, sf):
    return matching(spark, sf, P("props").isin("k", [1, 5, 9]))


@condition("event_type IN ('click', 'view')")
def filter_in_str(spark, sf):
    made = F.to_json(F.struct("event_type"))
    return matching(spark, sf, P(made).isin("event_type", ["click", "view", 7]))


@condition(f"({NUM} AND {VAL} >= 10) AND ({NUM} AND {VAL} < 30) OR ({NUM} AND {VAL} = 99)")
def filter_and_or(spark, sf):
    p = P("props")
    return matching(spark, sf, p.ge("k", 10) & p.lt("k", 30) | p.eq("k", 99))


@condition(f"({NUM} AND {VAL} >= 10) AND (({NUM} AND {VAL} < 30) OR ({NUM} AND {VAL} = 99))")
def filter_parens(spark, sf):
    p = P("props")
    return matching(spark, sf, p.ge("k", 10) & (p.lt("k", 30) | p.eq("k", 99)))


@condition("false")
def filter_type_mismatch(spark, sf):
    return matching(spark, sf, P("props").eq("k", "69"))


@condition("value > 50")
def filter_bool_literal(spark, sf):
    made = F.to_json(F.struct((F.col("value") > 50).alias("big")))
    return matching(spark, sf, P(made).eq("big", True))


# --- inverted file ---


@query(f"WITH {E}, {C} SELECT pid, CAST(unnest(range(64)) AS INTEGER) AS pos, unnest(c) AS x FROM c")
def centroids_by_label(spark, sf):
    return means(spark, sf).select("pid", F.posexplode("centroid").alias("pos", "x"))


@query(f"WITH {E}, {C}, {ASSIGN} SELECT vec_id AS id, pid, round(d, 6) AS distance FROM a")
def ivf_assign(spark, sf):
    return shown(ivf.assign(emb(spark, sf), means(spark, sf)))


@query(f"WITH {E}, {C}, {ASSIGN} SELECT pid, count(*) AS n FROM a GROUP BY pid")
def ivf_partition_sizes(spark, sf):
    return ivf.assign(emb(spark, sf), means(spark, sf)).groupBy("pid").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {E}, {C}, {ASSIGN} SELECT pid, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS x FROM (SELECT pid, unnest(v) AS x, unnest(range(64)) AS pos FROM a) GROUP BY ALL")
def lloyd_step(spark, sf):
    return ivf.lloyd_step(emb(spark, sf), means(spark, sf)).select("pid", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH {E}, {C}, {ASSIGN} SELECT pid, arg_max(vec_id, (d, -vec_id)) AS id, round(max(d), 6) AS distance FROM a GROUP BY pid")
def empty_cluster_farthest(spark, sf):
    return shown(ivf.farthest(emb(spark, sf), means(spark, sf)))


ROUTE = f"rt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, pid) AS rank FROM (SELECT query_id, q, pid, {l2_sql('c', 'q')} AS d FROM q, c))"


@query(f"WITH {E}, {Q}, {C}, {ROUTE} SELECT query_id, rank, pid, round(d, 6) AS distance FROM rt WHERE rank <= 3")
def ivf_route_nprobe(spark, sf):
    return shown(ivf.route(asked(spark, sf), means(spark, sf), 3))


@query(f"WITH {E}, {Q}, {C}, {ASSIGN}, {ROUTE} SELECT query_id, count(*) AS candidates FROM rt JOIN a USING (pid) WHERE rank <= 3 GROUP BY query_id")
def ivf_probe_scan(spark, sf):
    probes = ivf.route(asked(spark, sf), means(spark, sf), 3).select("query_id", "pid")
    sizes = ivf.assign(emb(spark, sf), means(spark, sf)).groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    return probes.join(sizes, "pid").groupBy("query_id").agg(F.sum("n").alias("candidates"))


# --- codes ---

H = "h AS (SELECT i, list(CASE WHEN bit_count(CAST(i & j AS BIGINT)) % 2 = 1 THEN -0.125 ELSE 0.125 END ORDER BY j) AS h FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(64)) AS j) GROUP BY i)"
R = "r AS (SELECT vec_id, label, v, list(list_dot_product(v, h) ORDER BY i) AS r FROM e, h GROUP BY vec_id, label, v)"
CODE = "k AS (SELECT *, list_sum(list_transform(r, lambda x: x * x)) AS alpha, list_sum(list_transform(r, lambda x: abs(x))) AS s, list_transform(r, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS bits FROM r)"
EST = "(a.alpha + b.alpha - 2 * (a.s / (sqrt(a.alpha) + 1.9)) * (b.s / (sqrt(b.alpha) + 1.9)) * (64 - 2 * list_sum(list_transform(range(1, 65), lambda i: CASE WHEN a.bits[i] = b.bits[i] THEN 0 ELSE 1 END))) / 64)"


def turned(spark, sf) -> DataFrame:
    return codes.rotated(emb(spark, sf), codes.hadamard(DIM))


def coded(spark, sf) -> DataFrame:
    return codes.encode(turned(spark, sf), DIM)


def scanned(spark, sf, score) -> DataFrame:
    """The K lowest scores of each query over the codes of all rows."""
    return plan.scan_codes(coded(spark, sf), asked(spark, sf), codes.hadamard(DIM), K, score, digits=6)


@query(f"WITH {E}, {H}, {R} SELECT vec_id AS id, CAST(unnest(range(64)) AS INTEGER) AS pos, round(unnest(r), 6) AS x FROM r")
def hadamard_rotate(spark, sf):
    return turned(spark, sf).select("id", F.posexplode("r").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH {E}, {H}, {R}, {CODE} SELECT vec_id AS id, list_sum(bits) AS ones, array_to_string(bits, '') AS bits, round(alpha, 6) AS alpha, round(s / (sqrt(alpha) + 1.9), 6) AS beta FROM k")
def rabitq_encode(spark, sf):
    rows = coded(spark, sf)
    bits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(F.element_at("code", 1), b).cast("string")), "")
    return rows.select("id", F.bit_count(F.element_at("code", 1)).cast("long").alias("ones"), bits.alias("bits"), F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"))


@query(f"""WITH {E}, {H}, {R}, {CODE}, p AS (SELECT b.vec_id AS query_id, a.vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN a.bits[i] = b.bits[i] THEN 0 ELSE 1 END)) AS d FROM k a, k b WHERE b.vec_id % 20 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p) SELECT query_id, rank, vec_id AS id, CAST(d AS DOUBLE) AS distance FROM o WHERE rank <= 10""")
def hamming_topk(spark, sf):
    return scanned(spark, sf, lambda q, signs, alpha, beta: (DIM - np.where(q >= 0, 1.0, -1.0) @ signs.T) / 2)


@query(f"""WITH {E}, {H}, {R}, {CODE}, p AS (SELECT b.vec_id AS query_id, a.vec_id, round({EST}, 6) AS d FROM k a, k b WHERE b.vec_id % 20 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p) SELECT query_id, rank, vec_id AS id, d AS distance FROM o WHERE rank <= 10""")
def rabitq_estimate_topk(spark, sf):
    return scanned(spark, sf, lambda q, signs, alpha, beta: plan.estimates(q, signs, alpha, beta, 0, False))


def quantize_sql(bits: int) -> str:
    n = 2**bits - 1
    return f"""WITH {E}, {H}, {R}, m AS (SELECT vec_id, r, list_max(list_transform(r, lambda x: abs(x))) AS t FROM r)
SELECT vec_id AS id, round(t / {n}.0, 6) AS scale, CAST(list_sum(list_transform(r, lambda x: round(abs(x) / t * {n}.0))) AS BIGINT) AS total FROM m"""


def quantize_query(bits: int) -> None:
    def run(spark, sf):
        q = codes.quantized(F.col("r"), bits)
        return turned(spark, sf).select("id", q.alias("z")).select("id", F.round("z.scale", 6).alias("scale"), F.col("z.total").alias("total"))

    run.__name__ = f"query_quantize_{bits}"
    query(quantize_sql(bits))(run)


for _bits in (1, 2, 4, 8):
    quantize_query(_bits)


def quantized_sql(bits: int, signed: bool = True) -> str:
    """Estimates from quantized queries: signed, or with magnitudes only."""
    sign, n = "CASE WHEN b.bits[i] = 1 THEN 1 ELSE -1 END *" if signed else "", f"{2**bits - 1}.0"
    inner = f"list_sum(list_transform(range(1, 65), lambda i: {sign} (CASE WHEN a.bits[i] = 1 THEN 1 ELSE -1 END) * round(abs(b.r[i]) / b.t * {n})))"
    return f"""WITH {E}, {H}, {R}, {CODE}, z AS (SELECT *, list_max(list_transform(r, lambda x: abs(x))) AS t FROM k),
p AS (SELECT b.vec_id AS query_id, a.vec_id, round(a.alpha + b.alpha - 2 * (a.s / (sqrt(a.alpha) + 1.9)) * (b.t / {n}) * {inner} / 64, 6) AS d FROM z a, z b WHERE b.vec_id % 20 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p) SELECT query_id, rank, vec_id AS id, d AS distance FROM o WHERE rank <= 10"""


@query(quantized_sql(4))
def quantized_estimate_topk(spark, sf):
    return scanned(spark, sf, lambda q, signs, alpha, beta: plan.estimates(q, signs, alpha, beta, 4, False))


@query(quantized_sql(4, signed=False))
def quantized_estimate_topk_unsigned(spark, sf):
    return scanned(spark, sf, lambda q, signs, alpha, beta: plan.estimates(q, signs, alpha, beta, 4, False, signed=False))


# --- 8-bit scalar quantization ---

S8 = "s AS (SELECT label AS pid, pos, min(x) AS lo, max(x) AS hi FROM (SELECT label, unnest(v) AS x, unnest(range(64)) AS pos FROM e) GROUP BY ALL)"
X8 = "x AS (SELECT vec_id, pid, pos, v[pos + 1] AS val, lo, hi, CASE WHEN hi > lo THEN round((v[pos + 1] - lo) / (hi - lo) * 255) ELSE 0 END AS code FROM e JOIN s ON s.pid = e.label)"


def eight_bit(spark, sf) -> DataFrame:
    rows = emb(spark, sf).select("vec_id", F.col("label").cast("long").alias("pid"), v.doubles(F.col("embedding")).alias("v"))
    rows = rows.join(codes.sq8_stats(emb(spark, sf), "label"), "pid")
    return rows.withColumn("code", codes.sq8_encode(F.col("v"), F.col("lo"), F.col("hi"))).withColumn("near", codes.sq8_decode(F.col("code"), F.col("lo"), F.col("hi")))


@query(f"WITH {E}, {S8} SELECT CAST(pid AS BIGINT) AS pid, CAST(pos AS INTEGER) AS pos, round(lo, 6) AS lo, round(hi, 6) AS hi FROM s")
def sq8_stats(spark, sf):
    z = codes.sq8_stats(emb(spark, sf), "label").select("pid", F.posexplode(F.arrays_zip("lo", "hi")).alias("pos", "z"))
    return z.select("pid", "pos", F.round("z.lo", 6).alias("lo"), F.round("z.hi", 6).alias("hi"))


@query(f"WITH {E}, {S8}, {X8} SELECT vec_id, CAST(sum(code) AS BIGINT) AS code_sum, CAST(max(code) AS INTEGER) AS code_max FROM x GROUP BY vec_id")
def sq8_encode(spark, sf):
    return eight_bit(spark, sf).select("vec_id", F.aggregate("code", F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"), F.array_max("code").alias("code_max"))


@query(f"WITH {E}, {S8}, {X8} SELECT vec_id, round(max(abs(val - (lo + code / 255.0 * (hi - lo)))), 6) AS error FROM x GROUP BY vec_id")
def sq8_decode_error(spark, sf):
    return eight_bit(spark, sf).select("vec_id", F.round(F.array_max(F.zip_with("v", "near", lambda a, b: F.abs(a - b))), 6).alias("error"))


@query(f"""WITH {E}, {Q}, {S8}, {X8}, n AS (SELECT vec_id, list(lo + code / 255.0 * (hi - lo) ORDER BY pos) AS v FROM x GROUP BY vec_id),
p AS (SELECT query_id, vec_id, round({l2_sql('v', 'q')}, 6) AS d FROM n, q), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p)
SELECT query_id, rank, vec_id AS id, d AS distance FROM o WHERE rank <= 10""")
def sq8_refine_topk(spark, sf):
    return knn.ranked(knn.nearest(eight_bit(spark, sf), asked(spark, sf), K + 10, vec_col="near").withColumn("distance", F.round("distance", 6)), K)


# --- approximate search ---


def index(spark, sf, **fields) -> plan.Index:
    return plan.build(emb(spark, sf), means(spark, sf), codes.hadamard(DIM), scaled=False, **fields)


#: Nine of the ten partitions, and half of the rows ranked again: these vectors have no structure by label, so fewer lose recall.
DEEP = plan.SearchOptions(k=K, nprobe=9, refine_k=100, refine_share=0.5)
#: Partitions that hold neighbours, candidates among them by estimate, and the nearest of those.
APPROX = f"""p AS (SELECT rt.query_id, a0.vec_id, round({EST}, 6) AS d FROM rt JOIN a a0 USING (pid) JOIN k a ON a.vec_id = a0.vec_id JOIN k b ON b.vec_id = rt.query_id WHERE rt.rank <= 9),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS i FROM p) WHERE i <= greatest(100, CAST(ceil(0.5 * (SELECT count(*) FROM e)) AS BIGINT))),
f AS (SELECT t.query_id, t.vec_id, {l2_sql('e.v', 'q.q')} AS d FROM t JOIN e USING (vec_id) JOIN q USING (query_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM f)"""
INDEXED = f"WITH {E}, {H}, {R}, {CODE}, {C}, {Q}, {ASSIGN}, {ROUTE}"


@query(f"{INDEXED}, {APPROX} SELECT query_id, rank, vec_id AS id, round(d, 6) AS distance FROM o WHERE rank <= 10")
def refine_topk(spark, sf):
    return shown(plan.search(index(spark, sf), asked(spark, sf), DEEP, scaled=False, digits=6))


@query(knn_sql(l2_sql("v", "q")))
def refine_full(spark, sf):
    return shown(plan.search(index(spark, sf), asked(spark, sf), plan.SearchOptions(k=K, nprobe=0, refine_k=100), scaled=False))


@query(f"""{INDEXED}, {APPROX},
g AS (SELECT q.query_id, e.vec_id, {l2_sql('e.v', 'q.q')} AS d FROM q, e), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM g),
hs AS (SELECT w.query_id, count(o.vec_id) AS hits FROM (SELECT * FROM w WHERE rank <= 10) w LEFT JOIN (SELECT * FROM o WHERE rank <= 10) o ON o.query_id = w.query_id AND o.vec_id = w.vec_id GROUP BY w.query_id)
SELECT query_id, hits, round(hits / 10.0, 6) AS recall FROM hs""")
def recall_at_k(spark, sf):
    found = plan.search(index(spark, sf), asked(spark, sf), DEEP, scaled=False, digits=6)
    return metrics.recall(found, knn.nearest(emb(spark, sf), asked(spark, sf), K), K).withColumn("recall", F.round("recall", 6))


def search_bits(bits: int) -> None:
    """Quantized queries over all partitions, without re-ranking."""

    def run(spark, sf):
        options = plan.SearchOptions(k=K, refine=False, query_bits=bits)
        return plan.search(index(spark, sf), asked(spark, sf), options, scaled=False, digits=6)

    run.__name__ = f"search_bits_{bits}"
    query(quantized_sql(bits))(run)


for _bits in (1, 2, 4, 8):
    search_bits(_bits)


@query(f"""{INDEXED}, p AS (SELECT rt.query_id, a0.vec_id, round({EST}, 6) AS d FROM rt JOIN a a0 USING (pid) JOIN k a ON a.vec_id = a0.vec_id JOIN k b ON b.vec_id = rt.query_id WHERE rt.rank <= 3),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p) SELECT query_id, rank, vec_id AS id, d AS distance FROM o WHERE rank <= 10""")
def search_unrefined(spark, sf):
    return plan.search(index(spark, sf), asked(spark, sf), plan.SearchOptions(k=K, nprobe=3, refine=False), scaled=False, digits=6)


@query(f"""WITH {E}, {C}, {Q}, {ASSIGN}, s AS (SELECT pid, pos, min(x) AS lo, max(x) AS hi FROM (SELECT pid, unnest(v) AS x, unnest(range(64)) AS pos FROM a) GROUP BY ALL),
x AS (SELECT vec_id, pos, lo, hi, CASE WHEN hi > lo THEN round((v[pos + 1] - lo) / (hi - lo) * 255) ELSE 0 END AS code FROM a JOIN s USING (pid)),
n AS (SELECT vec_id, list(lo + code / 255.0 * (hi - lo) ORDER BY pos) AS v FROM x GROUP BY vec_id),
p AS (SELECT query_id, vec_id, {l2_sql('v', 'q')} AS d FROM n, q), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p)
SELECT query_id, rank, vec_id AS id, round(d, 6) AS distance FROM o WHERE rank <= 10""")
def search_sq8(spark, sf):
    """Every row is a candidate and is ranked by its 8-bit vector."""
    return shown(plan.search(index(spark, sf), asked(spark, sf), plan.SearchOptions(k=K, refine_share=1.0, sq8_refine=True), scaled=False, digits=6))


@query(f"""WITH {E}, {C}, {Q}, {ASSIGN}, p AS (SELECT query_id, vec_id, {l2_sql('v', 'q')} AS d FROM a, q WHERE vec_id >= 100 AND label IN (1, 3) OR vec_id < 50),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p) SELECT query_id, rank, vec_id AS id, round(d, 6) AS distance FROM o WHERE rank <= 10""")
def search_pruned(spark, sf):
    """A condition on rows, and the same one over the statistics of a stored index, which may rule partitions out."""
    path = f"{scratch(spark)}/index"
    fields = {"numbers": {"vec_id": F.col("vec_id")}, "strings": {"label": F.col("label")}}
    rows = emb(spark, sf)
    plan.save(plan.build(rows.where("vec_id % 3 <> 0"), means(spark, sf), codes.hadamard(DIM), scaled=False, **fields), path)
    plan.add(spark, path, rows.where("vec_id % 3 = 0"), "1", scaled=False, **fields)
    where = (F.col("vec_id") >= 100) & F.col("label").isin(1, 3) | (F.col("vec_id") < 50)
    prune = pruning.may("vec_id", "ge", 100) & pruning.may("label", "in", ["1", "3"]) | pruning.may("vec_id", "lt", 50)
    return shown(plan.search(plan.load(spark, path), asked(spark, sf), plan.SearchOptions(k=K), where, scaled=False, prune=prune))


@query(f"""WITH {E}, {Q}, d AS (SELECT vec_id % 7 AS pid, min(vec_id) AS lo, max(vec_id) AS hi, list_sort(list(DISTINCT CAST(label AS VARCHAR))) AS labels FROM e GROUP BY 1)
SELECT CAST(pid AS BIGINT) AS pid FROM d WHERE hi >= 490 AND list_has_any(labels, ['1', '3']) OR lo < 2""")
def prune_and_or(spark, sf):
    s = pruning.summary(emb(spark, sf).withColumn("p", F.col("vec_id") % 7), "p", {"vec_id": F.col("vec_id")}, {"label": F.col("label")})
    return s.where(pruning.may("vec_id", "ge", 490) & pruning.may("label", "in", ["1", "3"]) | pruning.may("vec_id", "lt", 2)).select("pid")


# --- statistics and pruning ---


@query("SELECT CAST(user_id % 16 AS BIGINT) AS pid, 'k' AS field, min(CAST(json_extract(props, '$.k') AS DOUBLE)) AS lo, max(CAST(json_extract(props, '$.k') AS DOUBLE)) AS hi FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY 1 UNION ALL SELECT CAST(user_id % 16 AS BIGINT), 'value', min(value), max(value) FROM events WHERE value IS NOT NULL GROUP BY 1")
def partition_stats_num(spark, sf):
    rows = table(spark, sf, "events").withColumn("p", F.col("user_id") % 16)
    return pruning.number_stats(rows, "p", {"k": F.get_json_object("props", "$.k"), "value": F.col("value")})


@query("""WITH d AS (SELECT DISTINCT CAST(user_id % 16 AS BIGINT) AS pid, f, x FROM (SELECT user_id, 'event_type' AS f, event_type AS x FROM events UNION ALL SELECT user_id, 'user', CAST(user_id AS VARCHAR) FROM events) WHERE x IS NOT NULL)
SELECT pid, f AS field, CASE WHEN count(*) <= 64 THEN array_to_string(list(x ORDER BY x), ',') END AS vals, count(*) > 64 AS overflow FROM d GROUP BY pid, f""")
def partition_stats_str(spark, sf):
    rows = table(spark, sf, "events").withColumn("p", F.col("user_id") % 16)
    out = pruning.string_stats(rows, "p", {"event_type": F.col("event_type"), "user": F.col("user_id")})
    return out.select("pid", "field", F.array_join("values", ",").alias("vals"), "overflow")


@query("WITH s AS (SELECT user_id AS pid, max(value) AS hi FROM events GROUP BY user_id) SELECT CAST(pid AS BIGINT) AS pid FROM s WHERE hi > 95 OR hi IS NULL")
def prune_partitions(spark, sf):
    rows = table(spark, sf, "events")
    stats = pruning.number_stats(rows, "user_id", {"value": F.col("value")})
    return pruning.surviving(rows.select(F.col("user_id").cast("long").alias("pid")).distinct(), stats, "value", pruning.may_match_number("gt", 95))


# --- measures ---


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(CASE WHEN i = (n * 50) // 100 THEN value END) AS p50, max(CASE WHEN i = (n * 99) // 100 THEN value END) AS p99 FROM r GROUP BY event_type""")
def latency_percentiles(spark, sf):
    return metrics.rank_percentiles(table(spark, sf, "events"), "value", ["event_type"], {"p50": 50, "p99": 99})


@query("SELECT event_type, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.99), 9) AS p99 FROM events GROUP BY event_type")
def latency_percentiles_interpolated(spark, sf):
    p = metrics.interpolated_percentiles(table(spark, sf, "events"), "value", ["event_type"], {"p50": 50, "p99": 99})
    return p.select("event_type", F.round("p50", 9).alias("p50"), F.round("p99", 9).alias("p99"))


@query("""WITH r AS (SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS DOUBLE) AS d FROM events)
SELECT event_type, round(1 - 6 * sum(d * d) / (CAST(count(*) AS DOUBLE) * (CAST(count(*) AS DOUBLE) * count(*) - 1)), 6) AS rho FROM r GROUP BY event_type""")
def spearman(spark, sf):
    return metrics.spearman(table(spark, sf, "events"), "value", "ts", ["event_type"], "event_id").withColumn("rho", F.round("rho", 6))


# --- fusion ---

LISTS = f"""ls AS (SELECT 'near' AS list_id, query_id, vec_id AS id, 1 - {l2_sql('v', 'q')} AS score FROM e, q UNION ALL SELECT 'dot', query_id, vec_id, list_dot_product(v, q) FROM e, q WHERE label IN (1, 3, 5)),
rk AS (SELECT *, row_number() OVER (PARTITION BY list_id, query_id ORDER BY round(score, 6) DESC, id) AS rank FROM ls)"""


def two_lists(spark, sf) -> DataFrame:
    near = knn.nearest(emb(spark, sf), asked(spark, sf), 50).select(F.lit("near").alias("list_id"), "query_id", "id", (1 - F.col("distance")).alias("score"))
    inner = knn.nearest(emb(spark, sf), asked(spark, sf), 50, F.col("label").isin(1, 3, 5), metric="dot").select(F.lit("dot").alias("list_id"), "query_id", "id", (-F.col("distance")).alias("score"))
    return fusion.with_rank(near.unionByName(inner), ["list_id", "query_id"], [F.round("score", 6).desc(), "id"])


@query(f"WITH {E}, {Q}, {LISTS} SELECT query_id, id, round(sum(1.0 / (60 + rank)), 6) AS score FROM rk WHERE rank <= 50 GROUP BY query_id, id")
def rrf_fusion(spark, sf):
    return fusion.reciprocal_rank(two_lists(spark, sf), 60.0, ("query_id",)).withColumn("score", F.round("score", 6))


@query(f"WITH {E}, {Q}, {LISTS} SELECT query_id, id, round(sum(CASE list_id WHEN 'near' THEN 0.75 ELSE 0.25 END * score), 6) AS score FROM rk WHERE rank <= 50 GROUP BY query_id, id")
def weighted_fusion(spark, sf):
    return fusion.weighted(two_lists(spark, sf), {"near": 0.75, "dot": 0.25}, ("query_id",)).withColumn("score", F.round("score", 6))


# --- full text ---

TERMS = ["and", "the", "une"]
W_SQL = r"regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
BM = f"""w AS (SELECT doc_id, lang, {W_SQL} AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS avgdl FROM w),
t AS (SELECT doc_id, lang, CAST(len(w) AS DOUBLE) AS dl, term, CAST(len(list_filter(w, lambda x: x = term)) AS DOUBLE) AS tf FROM w, (SELECT unnest({TERMS}) AS term)),
df AS (SELECT term, CAST(sum(CASE WHEN tf > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS df FROM t GROUP BY term),
bm AS (SELECT doc_id, lang, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM t JOIN df USING (term), s GROUP BY doc_id, lang HAVING sum(tf) > 0)"""


@query(f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({W_SQL}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def inverted_index(spark, sf):
    return fulltext.inverted_index(table(spark, sf, "documents")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {BM} SELECT doc_id AS id, round(score, 6) AS score FROM bm")
def bm25_scores(spark, sf):
    return fulltext.bm25(table(spark, sf, "documents"), TERMS).withColumn("score", F.round("score", 6))


@query(f"WITH {BM} SELECT doc_id AS id, round(score, 6) AS score FROM bm WHERE lang = 'fr' ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
def fulltext_and_filter(spark, sf):
    docs = table(spark, sf, "documents")
    found = fulltext.bm25(docs, TERMS).join(docs.where("lang = 'fr'").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return fusion.top(found.withColumn("score", F.round("score", 6)), 20)


@query(f"""WITH {E}, {Q}, {BM}, a AS (SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (SELECT query_id, vec_id, {l2_sql('v', 'q')} AS d FROM e, q)),
b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm WHERE lang = 'en'),
u AS (SELECT * FROM a WHERE rank <= 50 UNION ALL SELECT query_id, id, rank FROM b, q WHERE rank <= 50),
g AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 6) AS score FROM u GROUP BY query_id, id)
SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM g) WHERE place <= 20""")
def hybrid_three_way(spark, sf):
    """Vector search, full text and a condition, fused for each query: vectors and documents share ids."""
    near = knn.nearest(emb(spark, sf), asked(spark, sf), 50).select("query_id", "id", "rank")
    words = fulltext.bm25(table(spark, sf, "documents").where("lang = 'en'"), TERMS, stats=fulltext.statistics(table(spark, sf, "documents"), TERMS)).withColumn("score", F.round("score", 6))
    words = words.orderBy(F.desc("score"), "id").limit(50).select("id", F.row_number().over(W.orderBy(F.desc("score"), "id")).cast("long").alias("rank"))
    words = asked(spark, sf).select("query_id").join(F.broadcast(words), F.lit(True))  # the same 50 beside each query
    fused = fusion.reciprocal_rank(near.unionByName(words), by=("query_id",)).withColumn("score", F.round("score", 6))
    return fusion.with_rank(fused, ["query_id"], [F.desc("score"), "id"]).where("rank <= 20").select("query_id", "id", "score")


@query(f"WITH {BM} SELECT doc_id AS id, round(score, 6) AS score FROM bm")
def bm25_stored(spark, sf):
    """The same from a stored index of terms."""
    path = f"{scratch(spark)}/terms"
    fulltext.save_index(table(spark, sf, "documents"), path)
    return fulltext.bm25_from(fulltext.load_index(spark, path), TERMS).withColumn("score", F.round("score", 6))


@query(f"WITH {BM}, n3 AS (SELECT doc_id FROM t WHERE tf > 0 AND term IN ('and', 'the') GROUP BY doc_id HAVING count(*) = 2), o AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM t JOIN df USING (term), s WHERE term IN ('and', 'the') GROUP BY doc_id) SELECT doc_id AS id, round(score, 6) AS score FROM o JOIN n3 USING (doc_id)")
def bm25_all_terms(spark, sf):
    """Documents that hold every term."""
    path = f"{scratch(spark)}/terms"
    fulltext.save_index(table(spark, sf, "documents"), path)
    return fulltext.bm25_from(fulltext.load_index(spark, path), ["and", "the"], every=True).withColumn("score", F.round("score", 6))


# --- texts ---

CH = r"c AS (SELECT doc_id, pos, regexp_replace(substr(text, CAST(pos * 224 + 1 AS BIGINT), 256), '^\s+|\s+$', '', 'g') AS chunk FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 224.0) AS BIGINT))) AS pos FROM documents WHERE length(text) > 0))"


@query(f"WITH {CH} SELECT doc_id AS id, CAST(pos AS INTEGER) AS pos, length(chunk) AS n, md5(chunk) AS h FROM c WHERE chunk <> ''")
def text_chunks(spark, sf):
    return text.chunks(table(spark, sf, "documents")).select("id", "pos", F.length("chunk").cast("long").alias("n"), F.md5("chunk").alias("h"))


@query(f"WITH {CH} SELECT md5(chunk) AS h, min((doc_id, pos))[1] AS id, CAST(min((doc_id, pos))[2] AS INTEGER) AS pos FROM c WHERE chunk <> '' GROUP BY chunk")
def chunk_dedupe(spark, sf):
    return text.first_occurrences(text.chunks(table(spark, sf, "documents")), "chunk", ["id", "pos"])


@query()
def text_embedding_knn(spark, sf):
    """Documents nearest to those with ids divisible by 20, by a hashed embedding of their texts."""
    rows = cut(text.hashed_embedding(table(spark, sf, "documents")).where("embedding is not null"))  # texts are read once, not for the queries and each block of them
    ask = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    return shown(knn.nearest(rows, ask, K, id_col="id"))


@query("SELECT query_id, count(*) AS n, list(id ORDER BY rank)[1] AS first FROM (" + knn_sql(l2_sql("v", "q")) + ") GROUP BY query_id")
def results_json(spark, sf):
    packed = files.results_as_json(knn.nearest(emb(spark, sf), asked(spark, sf), K))
    back = F.from_json("json", "results array<struct<id:bigint,distance:double>>")["results"]
    return packed.select("query_id", F.size(back).cast("long").alias("n"), F.element_at(back, 1)["id"].alias("first"))


@query("SELECT query_id, rank, id, md5(translate(substr(text, 1, 120), chr(13) || chr(10), '  ')) AS h FROM (" + knn_sql(l2_sql("v", "q")) + ") LEFT JOIN documents d ON d.doc_id = id")
def result_text_lookup(spark, sf):
    found = knn.nearest(emb(spark, sf), asked(spark, sf), K).select("query_id", "rank", "id")
    return text.lookup(found, table(spark, sf, "documents")).select("query_id", "rank", "id", F.md5("snippet").alias("h"))


# --- the table itself ---


@query(f"WITH {E}, {C}, {ASSIGN} SELECT vec_id, pid, round(sum(d) OVER (PARTITION BY pid ORDER BY vec_id), 6) AS running FROM a")
def kmeanspp_running_sum(spark, sf):
    near = ivf.assign(emb(spark, sf), means(spark, sf))
    return text.running_sum(near, "distance", ["pid"], ["id"]).select(F.col("id").alias("vec_id"), "pid", F.round("running", 6).alias("running"))


@query("SELECT n, greatest(4, least(65536, CAST(floor(sqrt(n)) AS BIGINT))) AS partitions FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label UNION ALL SELECT -1, count(*) FROM lineitem)")
def num_partitions_formula(spark, sf):
    n = emb(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("n").unionAll(table(spark, sf, "lineitem").agg(F.count(F.lit(1))))
    return n.select("n", v.default_partitions(F.col("n")).alias("partitions"))


@query("SELECT count(*) AS num_vectors, count(DISTINCT label) AS num_partitions, CAST(max(len(embedding)) AS INTEGER) AS dim FROM embeddings")
def db_stats(spark, sf):
    return emb(spark, sf).agg(F.count(F.lit(1)).alias("num_vectors"), F.countDistinct("label").alias("num_partitions"), F.max(F.size("embedding")).alias("dim"))


@query(f"WITH {E} SELECT vec_id, len(v) AS n, round(list_sum(v), 6) AS total FROM e")
def export_vectors(spark, sf):
    """Vectors as JSON lines in order of their ids, read back."""
    lines = emb(spark, sf).orderBy("vec_id").select(F.to_json(F.struct("vec_id", v.doubles(F.col("embedding")).alias("vector"))).alias("line"))
    x = F.from_json("line", "vec_id bigint, vector array<double>")
    return lines.select(x.alias("x")).select("x.vec_id", F.size("x.vector").cast("long").alias("n"), F.round(v.total(F.col("x.vector")), 6).alias("total"))


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share."""
    return f"{shared_dir(spark)}/vexel-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


@query()
def kmeans_train(spark, sf):
    return ivf.kmeans(emb(spark, sf), 16, rounds=5).select("pid", F.posexplode("centroid").alias("pos", "x"))


@query(f"WITH {E} SELECT round(list_sum(v), 4) AS total, label FROM e")
def jsonl_roundtrip(spark, sf):
    path = f"{scratch(spark)}/jsonl"
    files.write_vectors_jsonl(emb(spark, sf).select(F.col("embedding").alias("vector"), F.to_json(F.struct("label")).alias("payload")), path)
    back = files.read_vectors_jsonl(spark, path)
    return back.select(F.round(v.total(F.col("vector")), 4).alias("total"), F.get_json_object("payload", "$.label").cast("int").alias("label"))


@query("SELECT vec_id, CAST(row_number() OVER (ORDER BY label IN (1, 3), vec_id) - 1 AS BIGINT) AS id FROM embeddings")
def store_versions(spark, sf):
    t = VersionedTable(spark, f"{scratch(spark)}/table")
    rows = emb(spark, sf).select("vec_id", "label")
    t.append(rows.where("label NOT IN (1, 3)").drop("label"), "vec_id")
    t.append(rows.where("label IN (1, 3)").drop("label"), "vec_id")
    t.compact()
    return t.open().select("vec_id", "id")
