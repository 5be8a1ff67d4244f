"""Text chunks for retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from vexel.operators.fulltext import terms_of
from vexel.operators.ordered import running


def chunks(docs: DataFrame, size: int = 256, overlap: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, chunk): windows of `size` characters, `size - overlap` apart, trimmed, without empty ones."""
    step = max(1, size - overlap)
    starts = F.when(F.length(text_col) > 0, F.sequence(F.lit(0), F.length(text_col) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(starts, lambda i: F.regexp_replace(F.substring(F.col(text_col), i + 1, F.lit(size)), r"^\s+|\s+$", ""))
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(pieces).alias("pos", "chunk")).where("chunk <> ''")


def first_occurrences(rows: DataFrame, text_col: str, order: list[str]) -> DataFrame:
    """(h, order) of each different text: its MD5 digest, which is what is shuffled, and where it stands first."""
    return rows.select(F.md5(text_col).alias("h"), *order).groupBy("h").agg(F.min(F.struct(*order)).alias("f")).select("h", *[F.col(f"f.{c}").alias(c) for c in order])


def lookup(results: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shown: int = 120) -> DataFrame:
    """Results with the first characters of their texts on one line."""
    one_line = F.substring(F.translate(F.col(text_col), "\r\n", "  "), 1, shown)
    return results.join(docs.select(F.col(id_col).alias("id"), one_line.alias("snippet")), "id", "left")


def running_sum(rows: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Adds `running`, the sum of the value up to and with the row in its group's order."""
    return running(rows, by, order, value).withColumn("running", F.col("__before") + F.col(value)).drop("__before", "__place")


def hashed_embedding(docs: DataFrame, dim: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, embedding): unit vectors of signed, hashed term counts; null for a text without terms. A stand-in where no
    embedding model is at hand; any function of a text column fits in its place."""
    terms = terms_of(F.col(text_col))
    h = docs.select(F.col(id_col).alias("id"), F.transform(terms, lambda t: F.xxhash64(t)).alias("h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b["h"]:
                code = np.asarray(x if x is not None else [], dtype=np.int64).view(np.uint64)
                v = np.bincount((code % np.uint64(dim)).astype(np.int64), weights=1.0 - 2.0 * (code >> np.uint64(63)), minlength=dim)
                n = np.linalg.norm(v)
                out.append((v / n).tolist() if n > 0 else None)
            yield pd.DataFrame({"id": b["id"], "embedding": pd.Series(out, dtype=object)})

    return h.mapInPandas(run, f"id {h.schema['id'].dataType.simpleString()}, embedding array<double>")
