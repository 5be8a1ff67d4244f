"""Links inside candidate groups, and connected components, for the operators on pairs.

Nodes are 16-byte digests, so their order is random with respect to the graph.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from vexel.llm.common import cut

#: Rows of a block; a task compares two blocks at most.
BLOCK = 128


class Forest:
    """Union-find over 0..n-1 in which the smallest member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def first_linked(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the first row that it is joined with, directly or over others."""
    up = np.full(len(linked), -1)
    for i in range(len(linked)):
        reached = np.array([i]) if up[i] < 0 else []
        while len(reached):
            up[reached] = i
            reached = np.flatnonzero(linked[reached].any(axis=0) & (up < 0))
    return up


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of the edges (u, v).

    Each round every node takes its smallest neighbour's name if that is smaller, and the edges are renamed; what
    joins a node with itself goes. As names are random, the edges shrink by a constant factor a round.
    """
    edges = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    names: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = cut(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("name")))
        names.append(step)
        left = edges.join(step.select(F.col("node").alias("u"), F.col("name").alias("a")), "u")
        right = left.join(step.select(F.col("node").alias("v"), F.col("name").alias("b")), "v").where("a <> b")
        edges = cut(right.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    if not names:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = names[0].select("node", F.col("name").alias("component"))
    for step in names[1:]:  # nodes without edges in a round keep their names
        out = out.join(step.select(F.col("node").alias("component"), "name"), "component", "left").select("node", F.coalesce("name", "component").alias("component"))
    return cut(out)


def links_within(members: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame | None], np.ndarray], block: int = BLOCK) -> DataFrame:
    """(node, n_links, root, multi): partial sums for members (node, component, copies, and what `compare` needs).

    Groups of up to `block` rows are compared in one task. A larger one is dealt into blocks by hash, and each pair of
    blocks is a task of its own; there `multi` is true and the roots of the tasks have still to be joined. n_links
    counts the copies behind each linked node.
    """
    large = members.groupBy("component").count().where(F.col("count") > block).select("component", F.ceil(F.col("count") / block).cast("int").alias("g"))
    df = members.join(cut(large), "component", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    df = df.withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    df = df.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        a = pdf[pdf["own"] == lo].reset_index(drop=True)
        b = None if lo == hi else pdf[pdf["own"] == hi].reset_index(drop=True)
        if b is not None and not (len(a) and len(b)):  # a block without rows; the rows of the other are in its own task too
            return pd.DataFrame({"node": [], "n_links": [], "root": [], "multi": []})
        linked = compare(a, b)
        nodes = list(a["node"]) if b is None else [*a["node"], *b["node"]]
        if b is None:
            np.fill_diagonal(linked, False)
            counts, square = linked @ a["copies"].to_numpy(np.int64), linked | linked.T
        else:
            counts = np.concatenate([linked @ b["copies"].to_numpy(np.int64), linked.T @ a["copies"].to_numpy(np.int64)])
            square = np.zeros((len(nodes), len(nodes)), dtype=bool)
            square[: len(a), len(a) :], square[len(a) :, : len(a)] = linked, linked.T
        order = sorted(range(len(nodes)), key=nodes.__getitem__)
        top = np.empty(len(nodes), dtype=np.int64)
        top[order] = np.array(order)[first_linked(square[np.ix_(order, order)])]
        return pd.DataFrame({"node": nodes, "n_links": counts, "root": [nodes[t] for t in top], "multi": bool(pdf["g"].iloc[0] > 1)})

    kind = members.schema["node"].dataType.simpleString()
    return df.groupBy("component", "lo", "hi").applyInPandas(run, f"node {kind}, n_links long, root {kind}, multi boolean")


def gather(partial: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, links, class_id) for each node of a group, from links_within(); nodes: (node, first_id, copies)."""
    partial = cut(partial)
    per = partial.groupBy("node").agg(F.sum("n_links").alias("links"), F.min("root").alias("root"), F.max("multi").alias("multi"))
    joined = connected_components(partial.where("multi").select(F.col("node").alias("u"), F.col("root").alias("v")))
    roots = cut(per.join(joined, "node", "left").select("node", "links", F.coalesce("component", F.when(~F.col("multi"), F.col("root")), "node").alias("root")).join(nodes.select("node", "first_id"), "node"))
    classes = cut(roots.groupBy("root").agg(F.min("first_id").alias("class_id")))
    return cut(roots.join(classes, "root").select("node", "links", "class_id"))
