"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, repeated up to `max_epochs` times, and sent in packets of at
most QUANTUM words of one document. A packet's virtual finish time is the source's cumulative words up to its end divided
by the source's target. All packets are range-sorted by that time; the mix is the packets in this order up to the total
budget, where the one that crosses it is cut. As queues drain in proportion to their targets, each source gets its target
to within a packet.

Targets share the budget by weight, stop at `max_epochs` times the source's size, and the excess goes to the others
by weight until none is above. Packets that start after their source's share is spent (virtual time 1) are never
reached, so they aren't made.

Texts are read once, for their sizes. Running totals over a source and over all packets are taken in range-sorted
partitions (operators/ordered.py), so a source of any size is dealt over many tasks. Defined results: a null text has
size 0 and takes 0; a null source is a source of its own, last in order; repeated rows are separate documents; equal places
in the shuffled order are broken by doc_id, then size; equal virtual finish times go by source; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from vexel.llm.common import TOKEN_CLASS, stored
from vexel.operators.ordered import running
from vexel.shared import join_small

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Words of a packet.
QUANTUM = 100
SEED = "mix"


def sizes(docs: DataFrame, seed: str = SEED, *more: str) -> DataFrame:
    """(doc_id, __src, size, __shuffled, __row, more): __src sorts nulls last, __shuffled gives the shuffled order, __row names the row."""
    return stored(docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("__src"),
        F.coalesce(F.regexp_count("text", F.lit(TOKEN_CLASS)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("__shuffled"),
        F.monotonically_increasing_id().alias("__row"),
        *more,
    ))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """(__src, source_size, target). Its windows run over one row for each source."""
    per = sized.groupBy("__src").agg(F.sum("size").alias("source_size"))
    rank = (F.row_number().over(W.orderBy("__src")) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), rank.cast("int") + 1))
    per = per.withColumn("cap", F.col("source_size") * max_epochs)
    order = W.orderBy(F.col("cap") / F.col("w"), "__src")
    below, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    # if the sources before this one stop at their caps, the others rise to this level
    level = (F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0))) / F.sum("w").over(rest)
    per = per.withColumn("total", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))).withColumn("level", level)
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    per = per.withColumn("final", F.max(fits).over(W.partitionBy()))
    return per.select("__src", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("final"), F.lit(float("inf"))) * F.col("w")).alias("target"))


def queued(sized: DataFrame, weights: tuple[int, ...], max_epochs: int, share: float = 1.0) -> DataFrame:
    """(doc_id, __src, size, __row, source_size, target, __begin): __begin is the words of the source's documents earlier in the queue."""
    placed = running(sized.select("doc_id", "__src", "size", "__shuffled", "__row"), ["__src"], ["__shuffled", "doc_id", "size"], "size")
    out = join_small(placed.withColumnRenamed("__before", "__begin"), targets(sized, weights, max_epochs, share), ["__src"])
    return stored(out.select("doc_id", "__src", "size", "__row", "source_size", "target", "__begin"))


def packets(queue: DataFrame, max_epochs: int, quantum: int = QUANTUM) -> DataFrame:
    """(__src, start, words, virtual_finish) of the packets that start before virtual time 1."""
    copies = queue.where("size > 0").select("__src", "size", "target", F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda e: e * F.col("source_size") + F.col("__begin"))).alias("from")).where(F.col("from") < F.col("target"))
    cuts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(quantum).cast("long"))
    sent = copies.select("__src", "size", "target", "from", F.explode(cuts).alias("at"))
    sent = sent.select("__src", "target", (F.col("from") + F.col("at")).alias("start"), F.least(F.lit(quantum), F.col("size") - F.col("at")).alias("words"))
    return sent.where(F.col("start") < F.col("target")).select("__src", "start", "words", ((F.col("start") + F.col("words")) / F.col("target")).alias("virtual_finish"))


def served(queue: DataFrame, max_epochs: int, quantum: int = QUANTUM, share: float = 1.0) -> DataFrame:
    """(__src, served): the words of each source among the packets in order of virtual finish, cut at the budget."""
    budget = queue.agg(F.floor(F.sum("size") * F.lit(float(share)))).first()[0] or 0
    ordered = running(packets(queue, max_epochs, quantum), [], ["virtual_finish", "__src", "start"], "words")
    return ordered.where(F.col("__before") < budget).groupBy("__src").agg(F.sum(F.least("words", F.lit(budget) - F.col("__before"))).alias("served"))


def taken(epochs: int, limit: Column, before: Column, size: Column, source_size: Column) -> Column:
    """Words that all copies of a document give before their source has given `limit`."""
    copies = [F.greatest(F.lit(0), F.least(size, limit - e * source_size - before)) for e in range(epochs)]
    return sum(copies[1:], copies[0])


def with_served(queue: DataFrame, max_epochs: int, share: float) -> DataFrame:
    return join_small(queue, served(queue, max_epochs, share=share), ["__src"], "left").withColumn("served", F.coalesce("served", F.lit(0)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, share: float = 1.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, virtual_finish) for each row of docs; share: the budget as a part of all words."""
    queue = queued(sizes(docs, seed), weights, max_epochs, share)
    return with_served(queue, max_epochs, share).select(
        "doc_id", "size", "source_size", "target",
        taken(max_epochs, F.col("served"), F.col("__begin"), F.col("size"), F.col("source_size")).alias("taken"),
        F.when(F.col("target") > 0, (F.col("__begin") + F.col("size")) / F.col("target")).alias("virtual_finish"),
    )


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, share: float = 1.0) -> DataFrame:
    """The mix itself, range-sorted by virtual finish time: a row for each copy of a document that is taken.

    Columns: doc_id, source, text, epoch, words, virtual_finish. A copy that the budget cuts keeps its first words, joined
    by single spaces.
    """
    sized = sizes(docs, seed, "source", "text")
    queue = queued(sized, weights, max_epochs, share)
    begin = F.col("epoch") * F.col("source_size") + F.col("__begin")
    copies = with_served(queue, max_epochs, share).select("*", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"))
    copies = copies.withColumn("words", F.greatest(F.lit(0), F.least(F.col("size"), F.col("served") - begin))).where("words > 0")
    copies = copies.select("__row", "epoch", "words", ((begin + F.col("size")) / F.col("target")).alias("virtual_finish"))
    out = sized.select("__row", "doc_id", "source", "text", "size").join(copies, "__row")
    tokens = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    first = F.array_join(F.slice(tokens, F.lit(1), F.col("words").cast("int")), " ")
    return out.select(
        "doc_id", "source", F.when(F.col("words") < F.col("size"), first).otherwise(F.col("text")).alias("text"), "epoch", "words", "virtual_finish",
    ).orderBy("virtual_finish", "doc_id", "epoch")
