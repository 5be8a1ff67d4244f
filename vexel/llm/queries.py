"""The numbered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from vexel.llm import decontaminate, embedding_dedup, html_extract, jaccard_join, language_id, licenses, lm_score, mixing, toxicity, url_filter
from vexel.llm.common import table

WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN_SQL = r"[^\x20\x09-\x0D]+"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(table(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.default_list(spark))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '{WORD_SQL}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS k, regexp_extract_all(translate(text, {AZ}), '{WORD_SQL}') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT k, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS win
       FROM b, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 8))) AS i) t WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, list_slice(w, i, i + n - 1) AS win FROM d, ns, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) t WHERE len(w) >= n),
hit AS (SELECT dw.r, dw.i, dw.n, bw.k FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT r, k FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""


def op5_sql() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    fit = "((host = '{0}' OR suffix(host, '.{0}')) AND prefix(path, '{1}'))"
    name = " ".join(f"WHEN {fit.format(h, p)} THEN '{h}{p}'" for _, h, p in rules)
    kind = " ".join(f"WHEN {fit.format(h, p)} THEN '{k}'" for k, h, p in rules)
    listed = " OR ".join(f"host = '{x}' OR suffix(host, '.{x}')" for x in url_filter.LISTED)
    return rf"""
WITH r AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {AZ}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, CASE {name} END AS rule, CASE {kind} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM p
"""


OP9_SQL = rf"""
WITH s AS (SELECT doc_id, coalesce('0' || source, '1') AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}')) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
per AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY src),
wt AS (SELECT *, CAST((row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS DOUBLE) AS w, source_size * 3 AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM per),
lv AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM wt),
fin AS (SELECT *, max(CASE WHEN level * w <= cap THEN level END) OVER () AS final FROM lv),
tg AS (SELECT src, source_size, least(CAST(cap AS DOUBLE), coalesce(final, 'inf'::DOUBLE) * w) AS target FROM fin),
o AS (SELECT s.*, CAST(coalesce(sum(size) OVER (PARTITION BY src ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bef FROM s),
q AS (SELECT * FROM o JOIN tg USING (src)),
cp AS (SELECT src, size, target, unnest([bef, source_size + bef, 2 * source_size + bef]) AS beg FROM q WHERE size > 0),
pk AS (SELECT src, target, beg + ofs AS start, least({mixing.QUANTUM}, size - ofs) AS words FROM (SELECT *, unnest(range(0, size, {mixing.QUANTUM})) AS ofs FROM cp WHERE beg < target)),
gl AS (SELECT src, words, coalesce(sum(words) OVER (ORDER BY (start + words) / target, src, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM pk WHERE start < target),
sv AS (SELECT src, CAST(sum(least(words, (SELECT sum(size) FROM s) - b)) AS BIGINT) AS served FROM gl WHERE b < (SELECT sum(size) FROM s) GROUP BY src)
SELECT doc_id, size, source_size, target, CASE WHEN target > 0 THEN (bef + size) / target END AS virtual_finish, CAST(
  greatest(0, least(size, coalesce(served, 0) - bef)) + greatest(0, least(size, coalesce(served, 0) - source_size - bef))
  + greatest(0, least(size, coalesce(served, 0) - 2 * source_size - bef)) AS BIGINT) AS taken
FROM q LEFT JOIN sv USING (src)
"""


#: Exact: all pairs that share a shingle, and the components of the similar ones.
OP2_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '{WORD_SQL}') AS w FROM documents),
n AS (SELECT w, min(doc_id) AS node, count(*) AS copies FROM d WHERE len(w) > 0 GROUP BY w),
s AS (SELECT DISTINCT node, list_slice(w, i, i + 4) AS g FROM n, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 3))) AS i) t),
c AS (SELECT node, count(*) AS k FROM s GROUP BY node),
p AS (SELECT a.node AS u, b.node AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.node < b.node GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN c x ON x.node = u JOIN c y ON y.node = v WHERE CAST(p.k AS DOUBLE) / (x.k + y.k - p.k) >= 0.8),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT node, node AS root FROM n UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node),
cls AS (SELECT node, min(root) AS class_id FROM r GROUP BY node),
lk AS (SELECT u AS node, sum(copies) AS k FROM e JOIN n ON n.node = e.v GROUP BY u),
o AS (SELECT n.w, class_id, CAST(coalesce(lk.k, 0) + copies - 1 AS BIGINT) AS n_links FROM n JOIN cls USING (node) LEFT JOIN lk USING (node))
SELECT d.doc_id, coalesce(o.class_id, d.doc_id) AS class_id, coalesce(o.n_links, 0) AS n_links, coalesce(o.class_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN o ON d.w = o.w
"""

def links_sql(vectors: str) -> str:
    """Exact: all pairs of a label."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM {vectors}),
ok AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.v, r.root FROM r JOIN l ON l.u = r.node),
c AS (SELECT node AS vec_id, min(root) AS component_id FROM r GROUP BY node),
k AS (SELECT u AS vec_id, count(*) AS n FROM l GROUP BY u)
SELECT v.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, component_id, component_id = v.vec_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN k USING (vec_id)
"""


OP7_SQL = links_sql("embeddings")
#: Each vector, and three more that are turned towards a neighbour component by component: some stay linked with it, some don't.
PLANTED_SQL = links_sql("""(SELECT vec_id * 4 + t AS vec_id, label, list_transform(range(1, len(embedding) + 1),
  lambda i: CAST(embedding[i] AS DOUBLE) + t * 0.07 * CAST(embedding[i % len(embedding) + 1] AS DOUBLE)) AS embedding FROM embeddings, (SELECT unnest(range(4)) AS t))""")


def planted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links among the vectors and copies turned by more and more."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("t"), F.col("embedding").cast("array<double>").alias("e"))
    turned = F.transform("e", lambda x, i: x + F.col("t") * 0.07 * F.element_at("e", ((i + 1) % F.size("e") + 1).cast("int")))
    return embedding_dedup.near_vectors(e.select((F.col("vec_id") * 4 + F.col("t")).alias("vec_id"), "label", turned.alias("embedding")))


def op6_sql() -> str:
    """The canonical form in DuckDB, for the corpus and for the known texts alike."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def lines(c: str) -> str:
        t = f"translate({c}, {AZ})"
        for a, b in licenses.SPELLINGS:
            t = f"replace({t}, {quoted(a)}, {quoted(b)})"
        t = rf"regexp_replace({t}, '[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')"
        drop = f"'{licenses.COPYRIGHT}'"
        return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, {drop}))"

    values = ", ".join(f"({quoted(k)}, {str(e).lower()}, {quoted(t)})" for k, e, t in licenses.rows_known())
    return f"""
WITH k AS (SELECT l, e, md5(array_to_string({lines('t')}, ' ')) AS h FROM (VALUES {values}) v(l, e, t)),
w AS (SELECT h, min(l) AS license FROM k WHERE e GROUP BY h), n AS (SELECT DISTINCT h, l FROM k WHERE NOT e),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({lines('text')}, []) AS x FROM documents),
f AS (SELECT r, string_agg(DISTINCT l, ',' ORDER BY l) AS notices FROM (SELECT r, md5(unnest(x)) AS h FROM d) u JOIN n USING (h) GROUP BY r),
g AS (SELECT r, doc_id, CASE WHEN len(x) > 0 THEN md5(array_to_string(x, ' ')) END AS digest FROM d)
SELECT doc_id, digest, license, coalesce(notices, '') AS notices FROM g LEFT JOIN w ON g.digest = w.h LEFT JOIN f USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_jaccard_join, op3_decontaminate, op4_lm_score, op5_url_filter, op6_license_scan, op7_embedding_dedup, op8_toxicity, op9_mixing, op10_html_extract, planted_links)}


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": OP2_SQL, "op7_embedding_dedup": OP7_SQL, "planted_links": PLANTED_SQL, "op3_decontaminate": OP3_SQL, "op5_url_filter": op5_sql(), "op6_license_scan": op6_sql(), "op9_mixing": OP9_SQL}
