"""The corpus pipeline: language ID, toxicity, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. The first four return the columns of
`documents`; the last returns the mix, a row for each copy taken: doc_id, source, text, epoch, words, virtual_finish,
in order of virtual finish time.

Defined results: an empty table stays empty through all stages; a null text has no letter and goes in the first stage; without
labels, or where all are alike, no document is toxic; where no document has a language all with a letter stay; an empty benchmark
takes nothing; of rows that share id and text one stays, and rows without an id stay; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vexel.llm import decontaminate, jaccard_join, language_id, mixing, toxicity
from vexel.llm.common import stored, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (language `und`), and those that the kernels can't place in any language."""
    return language_id.keep_known(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.7 or more."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of documents linked by a five-word Jaccard similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a ten-word window of a benchmark item."""
    return decontaminate.remove_hits(docs, table(spark, sf_dir, "benchmark"), unit="documents")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources at weights 1, 2, 3, repeating, as much text as there is."""
    return mixing.emit(docs)


STAGES = [
    ("language_id", known_language),
    ("toxicity", clean),
    ("jaccard_join", distinct_texts),
    ("decontaminate", without_benchmark),
    ("mixing", mixed),
]
#: The first two stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
