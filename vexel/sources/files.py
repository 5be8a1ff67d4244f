"""Readers and writers of vector files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession


def _vecs(spark: SparkSession, path: str, kind: str, out: str) -> DataFrame:
    """Records of a little-endian dimension and that many values; a file is read by one task, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["path"], b["content"]):
                if not raw:
                    continue
                dim = int(np.frombuffer(raw[:4], dtype="<i4")[0])
                if dim <= 0 or len(raw) % (4 + 4 * dim):
                    raise ValueError(f"{name}: records of one positive dimension are expected")
                rows = np.frombuffer(raw, dtype="<i4").reshape(-1, dim + 1)
                if (rows[:, 0] != dim).any():
                    raise ValueError(f"{name}: records of several dimensions")
                values = rows[:, 1:].copy().view(kind)
                for at in range(0, len(values), 10_000):
                    part = values[at : at + 10_000]
                    yield pd.DataFrame({"path": name, "id": np.arange(at, at + len(part)), "vector": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, id long, vector array<{out}>")


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, vector of floats)."""
    return _vecs(spark, path, "<f4", "float")


def read_ivecs(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, vector of ints)."""
    return _vecs(spark, path, "<i4", "int")


def read_vectors_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(vector, payload): one {"vector": [...], "payload": {...}} a line; payload stays JSON text. A malformed line fails the read."""
    raw = spark.read.option("mode", "FAILFAST").schema("vector array<double>, payload string").json(path)
    return raw.where("vector is not null")


def write_vectors_jsonl(rows: DataFrame, path: str) -> None:
    """Rows (vector, payload as JSON text) in the same form."""
    line = F.concat(F.lit('{"vector":'), F.to_json("vector"), F.coalesce(F.concat(F.lit(',"payload":'), "payload"), F.lit("")), F.lit("}"))
    rows.select(line.alias("value")).write.text(path)


def vectors_from_json_array(rows: DataFrame, column: str) -> DataFrame:
    """(id, vector) from a column with a JSON array of arrays."""
    parsed = F.from_json(column, "array<array<double>>")
    return rows.select(F.posexplode(parsed).alias("id", "vector")).select(F.col("id").cast("long"), "vector")


def gaussian(spark: SparkSession, n: int, dim: int, seed: int = 1) -> DataFrame:
    """(vec_id, embedding): n seeded standard normal vectors."""
    return spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[F.randn(seed * 100_003 + i).cast("float") for i in range(dim)]).alias("embedding"))


def read_texts(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("utf-8", "gbk", "gb18030")) -> DataFrame:
    """(path, text): whole files, decoded by the first encoding that fits; a file that none fits is an error."""

    def decoded(name: str, raw: bytes) -> str:
        for e in encodings:
            try:
                return raw.decode(e)
            except UnicodeDecodeError:
                continue
        raise ValueError(f"{name}: none of {encodings} fits")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [decoded(n, bytes(c)) for n, c in zip(b["path"], b["content"])]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def results_as_json(results: DataFrame) -> DataFrame:
    """(query_id, json): one {"results": [{"id", "distance"}]} for each query, in order of rank."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "distance"))), lambda r: F.struct(r["id"].alias("id"), r["distance"].alias("distance")))
    return results.groupBy("query_id").agg(F.to_json(F.struct(ordered.alias("results"))).alias("json"))
