import hashlib
import struct

import pyspark.sql.functions as F
import pytest

from vexel.operators import text
from vexel.plans import search
from vexel.sources import files
from vexel.sources.versions import VersionedTable
from vexel.streaming.ingest import ingest


def test_fvecs_and_ivecs(spark, tmp_path):
    rows = [[1.0, 2.5, -3.0], [4.0, 5.0, 6.0]]
    (tmp_path / "a.fvecs").write_bytes(b"".join(struct.pack("<i3f", 3, *r) for r in rows))
    (tmp_path / "a.ivecs").write_bytes(b"".join(struct.pack("<i2i", 2, *r) for r in ((1, 2), (3, 4))))
    assert [r.vector for r in files.read_fvecs(spark, str(tmp_path / "a.fvecs")).orderBy("id").collect()] == rows
    assert [r.vector for r in files.read_ivecs(spark, str(tmp_path / "a.ivecs")).orderBy("id").collect()] == [[1, 2], [3, 4]]
    (tmp_path / "b.fvecs").write_bytes(b"\x03\0\0\0abc")
    with pytest.raises(Exception, match="one positive dimension"):
        files.read_fvecs(spark, str(tmp_path / "b.fvecs")).collect()


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"vector":[1,2],"payload":{"k":1}}\n\n{"vector":[3,4],"other":1}\n')
    got = files.read_vectors_jsonl(spark, str(tmp_path / "x.jsonl")).collect()
    assert [(r.vector, r.payload) for r in got] == [([1.0, 2.0], '{"k":1}'), ([3.0, 4.0], None)]
    (tmp_path / "bad.jsonl").write_text('{"vector":[1,2]\n')
    with pytest.raises(Exception):
        files.read_vectors_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_json_array(spark):
    df = spark.createDataFrame([("[[1,2],[3,4.5]]",)], ["j"])
    assert [(r.id, r.vector) for r in files.vectors_from_json_array(df, "j").collect()] == [(0, [1.0, 2.0]), (1, [3.0, 4.5])]


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        t.open()
    rows = spark.range(100).select(F.col("id").alias("key"))
    assert t.append(rows.where("key % 2 = 0"), "key") == 0
    assert t.append(rows.where("key % 2 = 1"), "key") == 1
    assert t.open(0).count() == 50 and t.open().count() == 100
    got = {r.key: r.id for r in t.open().collect()}
    assert got == {k: k // 2 + 50 * (k % 2) for k in range(100)}
    assert t.compact() == 2 and t.versions() == [0, 1, 2] and t.open().count() == 100 and t.open(0).count() == 50
    assert t.vacuum() == 2 and t.versions() == [2] and t.open().count() == 100
    with pytest.raises(ValueError):
        t.open(0)
    with pytest.raises(ValueError):
        t.append(rows.withColumn("other", F.lit(1)), "key")


def test_interrupted_writes_leave_every_row_once(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.create(spark.createDataFrame([], "key long, id long").schema) == 0 and t.open().count() == 0
    rows = spark.range(8).select(F.col("id").alias("key"))
    t.append(rows, "key")
    t.append(rows.selectExpr("key + 8 AS key"), "key")

    def stop(*_):
        raise KeyboardInterrupt

    for step in (t.compact, lambda: t.append(rows, "key")):
        with monkeypatch.context() as m:
            m.setattr(t, "_commit", stop)  # after the folder is written, before it counts
            with pytest.raises(KeyboardInterrupt):
                step()
        assert sorted(r.id for r in t.open().collect()) == list(range(16))
    t.compact()  # written, and not yet deleted
    assert sorted(r.id for r in t.open().collect()) == list(range(16))
    with pytest.raises(ValueError, match="meanwhile"):
        t._commit(2, {"folders": []})
    assert t.vacuum() == 4 and sorted(r.id for r in t.open().collect()) == list(range(16))


def test_streaming_ingest(spark, tmp_path):
    vectors = files.gaussian(spark, 60, 64)
    vectors.where("vec_id < 40").write.parquet(str(tmp_path / "in"))
    at = str(tmp_path / "index")
    search.save(search.train(vectors.where("vec_id >= 40"), 4, rounds=2), at)
    stream = spark.readStream.schema(vectors.schema).parquet(str(tmp_path / "in"))
    ingest(stream, at, str(tmp_path / "state"), id_col="vec_id").awaitTermination(120)
    assert search.load(spark, at).rows.count() == 60
    ingest(stream, at, str(tmp_path / "other state"), id_col="vec_id").awaitTermination(120)  # all micro-batches once more
    index = search.load(spark, at)
    assert index.rows.count() == 60 and index.rows.select("id").distinct().count() == 60
    q = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert search.search(index, q, search.SearchOptions(k=1, nprobe=4, refine_k=60)).where("query_id = id").count() == 3


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None), (4, "   ")], "doc_id long, text string")
    got = [(r.id, r.pos, r.chunk) for r in text.chunks(docs, 4, 1).orderBy("id", "pos").collect()]
    assert got == [(1, 0, "abcd"), (1, 1, "defg"), (1, 2, "ghij"), (1, 3, "j")]
    again = text.first_occurrences(spark.createDataFrame([(2, "x"), (1, "x"), (3, "y")], "id int, t string"), "t", ["id"])
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert {(r.h, r.id) for r in again.collect()} == {(md5("x"), 1), (md5("y"), 3)}


def test_texts_of_several_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é 红楼梦".encode())
    (tmp_path / "b.txt").write_bytes("红楼梦".encode("gbk"))
    assert {r.path[-5:]: r.text for r in files.read_texts(spark, str(tmp_path / "*.txt")).collect()} == {"a.txt": "é 红楼梦", "b.txt": "红楼梦"}


def test_hashed_embedding(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "THREE, two one!"), (3, ""), (4, None)], "doc_id long, text string")
    got = {r.id: r.embedding for r in text.hashed_embedding(docs).collect()}
    assert got[1] == got[2] and sum(x * x for x in got[1]) == pytest.approx(1) and got[3] is None and got[4] is None
