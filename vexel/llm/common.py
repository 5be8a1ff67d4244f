"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from vexel.shared import cut, stored

__all__ = ["cut", "stored"]

#: Lower-cased words: ASCII letters and digits, and everything beyond ASCII.
WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = re.compile(WORD_CLASS)
#: Tokens: runs without ASCII white space.
TOKEN_CLASS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null ids are in fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(-1))


def lower_az(text: str) -> str:
    """A-Z lower-cased and nothing else; positions stay."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def word_list(text: str | None) -> list[str]:
    return WORDS.findall(lower_az(text)) if text else []


def bounded_sample(df: DataFrame, label: str, per_label: int, *keys: str) -> DataFrame:
    """About `per_label` rows of each label (all where there are fewer), chosen by a hash of the key columns."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if not counts:
        return df
    parts = [x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_label / n)))]
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / float(1 << 30)
    return df.where(place < F.element_at(F.create_map(*parts), F.col(label)))


def rows_where(df: DataFrame, column: str, test: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of df whose value in the column passes; other columns pass through untouched, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(test(b.column(column).to_pylist()), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
