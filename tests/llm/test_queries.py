"""The numbered queries and the pipeline on the smallest tables."""

import os

import duckdb
import pyspark.sql.functions as F
import pytest

import corpus_pipeline as cp
from vexel.llm import queries as q
from vexel.llm.common import word_list


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(float(f"{r[i]:.8g}") if isinstance(r[i], float) else r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_rows_as_sql(spark, db, sf, name):
    df = q.queries()[name](spark, sf)
    cur = db.execute(q.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in cur.description], cur.fetchall())


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in q.queries() if n.startswith("op")) == list(range(1, 11))


def test_pipeline_stages_on_whole_inputs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= kept
        kept = docs.count()
    texts = [word_list(r.text) for r in docs.collect()]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    for i in range(len(sets)):
        for j in range(i):
            assert len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j])
    mix = cp.STAGES[-1][1](spark, docs, sf).collect()
    assert sum(r.words for r in mix) == pytest.approx(sum(len(r.text.split()) for r in docs.collect()), abs=25)


def test_run(spark, sf):
    out = cp.run(spark, sf)
    assert out.columns == ["doc_id", "source", "text", "epoch", "words", "virtual_finish"] and out.count() > 0


def test_odd_inputs_of_the_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).count() == 0
        some = docs.limit(20).withColumns({"text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")})
        assert stage(spark, some, sf).count() == (0 if name == "language_id" else 20)
        bare = docs.limit(30).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
        if name == "language_id":
            assert stage(spark, bare, sf).count() >= 28
    assert cp.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
