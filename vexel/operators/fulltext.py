"""Inverted index and BM25 over a text column."""

from __future__ import annotations

import zlib

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms_of(text):
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def inverted_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, id, tf)."""
    return docs.select(F.col(id_col).alias("id"), F.explode(terms_of(F.col(text_col))).alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))


def counted(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dl, tf): length of each text and its counts of the terms; texts are read once."""
    words = terms_of(F.col(text_col))
    # explode of one array keeps the words a column of their own, so that they aren't extracted again for each term
    df = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.array(words)).alias("w"))

    def count_of(term: str) -> Column:
        return F.size(F.filter("w", lambda x: x == term)).cast("double")

    return df.select("id", F.size("w").cast("double").alias("dl"), F.array(*[count_of(t) for t in terms]).alias("tf"))


def statistics(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> dict[str, float]:
    """n, avgdl, and df0, df1, ... of the terms: one row over all texts."""
    return _statistics(counted(docs, terms, id_col, text_col), len(terms))


def _statistics(rows: DataFrame, terms: int) -> dict[str, float]:
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.element_at("tf", i + 1) > 0).cast("double")).alias(f"df{i}") for i in range(terms)]).first()
    return {k: float(x or 0) for k, x in r.asDict().items()}


def weight_of(tf: Column, dl: Column, n: float, avgdl: float, found: float | Column, k1: float, b: float) -> Column:
    idf = F.log(F.lit(1.0) + (F.lit(n) - found + 0.5) / (found + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(avgdl or 1.0)))


def bm25(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text", stats: dict[str, float] | None = None) -> DataFrame:
    """(id, score) of the documents with any of the terms; stats: those of the corpus, where docs are only part of it."""
    rows = counted(docs, terms, id_col, text_col)
    s = stats or _statistics(rows, len(terms))
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + weight_of(F.element_at("tf", i + 1), F.col("dl"), s["n"], s["avgdl"], F.lit(s[f"df{i}"]), k1, b)
    return rows.where(F.exists("tf", lambda x: x > 0)).select("id", score.alias("score"))


#: Buckets of terms in a stored index.
BUCKETS = 64


def bucket_of(term: Column) -> Column:
    return F.pmod(F.crc32(term), F.lit(BUCKETS)).cast("int")


def save_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Stores postings (bucket, term, id, tf, dl), partitioned by a hash of the term and sorted by term, and the statistics of the corpus."""
    df = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.array(terms_of(F.col(text_col)))).alias("w"))
    postings = df.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("term", "id", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    postings = postings.withColumn("bucket", bucket_of(F.col("term")))
    postings.repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    df.agg(F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.avg(F.size("w")), F.lit(0.0)).alias("avgdl")).write.mode("overwrite").parquet(f"{path}/statistics")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float]]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/statistics").first().asDict()


def bm25_from(index: tuple[DataFrame, dict[str, float]], terms: list[str], k1: float = 1.2, b: float = 0.75, every: bool = False) -> DataFrame:
    """(id, score) of the documents with any, or every, of the terms; only the terms' buckets are read."""
    postings, stats = index
    buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
    rows = postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    found = rows.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))  # one row a term
    score = weight_of(F.col("tf").cast("double"), F.col("dl").cast("double"), stats["n"], stats["avgdl"], F.col("df"), k1, b)
    out = rows.join(F.broadcast(found), "term").groupBy("id").agg(F.sum(score).alias("score"), F.count(F.lit(1)).alias("held"))
    return (out.where(F.col("held") == len(set(terms))) if every else out).select("id", "score")
