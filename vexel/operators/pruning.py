"""Partition statistics of payload fields, and the partitions that a condition can't rule out."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

#: Distinct strings kept of a field in a partition; beyond that the partition is never ruled out by the field.
MOST_STRINGS = 64


def number_stats(rows: DataFrame, pid: str, fields: dict[str, Column]) -> DataFrame:
    """(pid, field, lo, hi): range of each numeric field in each partition."""
    flat = rows.select(F.col(pid).cast("long").alias("pid"), F.explode(F.array(*[F.struct(F.lit(k).alias("field"), c.cast("double").alias("x")) for k, c in fields.items()])).alias("f"))
    return flat.select("pid", "f.field", "f.x").where("x is not null").groupBy("pid", "field").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def string_stats(rows: DataFrame, pid: str, fields: dict[str, Column], most: int = MOST_STRINGS) -> DataFrame:
    """(pid, field, values, overflow): the distinct strings of each field, none and overflow if there are more than `most`."""
    flat = rows.select(F.col(pid).cast("long").alias("pid"), F.explode(F.array(*[F.struct(F.lit(k).alias("field"), c.cast("string").alias("x")) for k, c in fields.items()])).alias("f"))
    distinct = flat.select("pid", "f.field", "f.x").where("x is not null").distinct()
    few = distinct.groupBy("pid", "field").agg(F.count(F.lit(1)).alias("n"))
    kept = distinct.join(few.where(F.col("n") <= most), ["pid", "field"]).groupBy("pid", "field").agg(F.array_sort(F.collect_list("x")).alias("values"))
    return few.join(kept, ["pid", "field"], "left").select("pid", "field", "values", (F.col("n") > most).alias("overflow"))


def summary(rows: DataFrame, pid: str, numbers: dict[str, Column] | None = None, strings: dict[str, Column] | None = None) -> DataFrame:
    """(pid, numbers, strings): a row for each partition, with maps from field to (lo, hi) and to (values, overflow)."""
    pids = rows.select(F.col(pid).cast("long").alias("pid")).distinct()
    if numbers:
        n = number_stats(rows, pid, numbers).groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("lo", "hi")))).alias("numbers"))
        pids = pids.join(n, "pid", "left")
    if strings:
        t = string_stats(rows, pid, strings).groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("values", "overflow")))).alias("strings"))
        pids = pids.join(t, "pid", "left")
    for name, kind, have in (("numbers", "map<string,struct<lo:double,hi:double>>", numbers), ("strings", "map<string,struct<values:array<string>,overflow:boolean>>", strings)):
        if not have:
            pids = pids.withColumn(name, F.lit(None).cast(kind))
    return pids


def merged(summaries: DataFrame) -> DataFrame:
    """One row a partition of several summaries of it."""
    n = summaries.select("pid", F.explode("numbers").alias("field", "s")).groupBy("pid", "field").agg(F.min("s.lo").alias("lo"), F.max("s.hi").alias("hi"))
    n = n.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("lo", "hi")))).alias("numbers"))
    t = summaries.select("pid", F.explode("strings").alias("field", "s")).groupBy("pid", "field").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("s.values", F.array().cast("array<string>")))))).alias("values"), F.max("s.overflow").alias("overflow"))
    t = t.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("values", "overflow")))).alias("strings"))
    return summaries.select("pid").distinct().join(n, "pid", "left").join(t, "pid", "left")


def may(field: str, op: str, literal: float | list[str]) -> Column:
    """Over a summary: whether a partition can hold a row with `field op literal`, op "in" for strings. Combines with & and |;
    a partition without statistics of the field is never ruled out."""
    if op == "in":
        s = F.element_at("strings", field)
        test = s["overflow"] | F.arrays_overlap(s["values"], F.array(*[F.lit(x) for x in literal]))
    else:
        s, x = F.element_at("numbers", field), F.lit(float(literal))
        lo, hi = s["lo"], s["hi"]
        test = {"eq": (lo <= x) & (x <= hi), "lt": lo < x, "le": lo <= x, "gt": hi > x, "ge": hi >= x, "ne": F.lit(True)}[op]
    return F.coalesce(test, F.lit(True))


def may_match_number(op: str, literal: float) -> Column:
    """Over (lo, hi): whether a partition can hold a row with `field op literal`."""
    lo, hi, x = F.col("lo"), F.col("hi"), F.lit(float(literal))
    return {"eq": (lo <= x) & (x <= hi), "lt": lo < x, "le": lo <= x, "gt": hi > x, "ge": hi >= x, "ne": F.lit(True)}[op]


def may_match_string(literals: list[str]) -> Column:
    """Over (values, overflow): whether a partition can hold one of the strings."""
    return F.col("overflow") | F.arrays_overlap("values", F.array(*[F.lit(x) for x in literals]))


def surviving(pids: DataFrame, stats: DataFrame, field: str, test: Column) -> DataFrame:
    """The pids whose statistics of the field pass the test, and those without statistics of it."""
    out = stats.where(F.col("field") == field).where(~F.coalesce(test, F.lit(True))).select("pid")
    return pids.join(out, "pid", "left_anti")
