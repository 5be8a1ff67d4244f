"""Embedding near-dedup by sorted projection passes.

In each pass the vectors of a label are ordered lexicographically by 62 concatenated random hashes (signs of random
projections) and each is compared with its neighbours in a window. Links of all passes are united into groups; then
all vectors of a group are compared with each other, in blocks of bounded size (graph.py), so a group that is larger
than a window keeps all its links. Equal vectors are one node with a count of copies.

The passes of all vectors follow from their number; they measure how many leading bits tell a vector's window apart, which
is more where the vectors of a label share directions. Two vectors at the threshold agree on b bits with probability
(1 - angle/pi)^b, and the passes together miss such a pair with probability `miss` at most, on the average of the label's
vectors; where a label needs more for that, its crowded vectors (those whose own bits leave them a probability of over
2 * miss) are compared with each other: all of them in blocks, which misses nothing, or by the passes that the label lacks if
those are fewer than the blocks. A pair of which one vector isn't crowded was found by the first passes. Where even the
window's ends are linked, neighbours hold the group together, so those don't count.

A sorted pass is dealt over range partitions; the last vectors of each are compared with the first of the next one. What a
pass sends of a vector is its direction in 16 bits a component; windows take a link if rounding may hide one, and the links
inside a group are measured on the vectors themselves, in double precision.

Defined results: rows whose label or vector is null, whose vector is zero or empty or holds null or non-finite
components, link with nothing; vectors of different lengths don't link; rows with equal ids and vectors count as
copies; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window

from vexel.llm.common import cut
from vexel.llm.graph import Forest, connected_components, first_linked, gather, links_within

THRESHOLD = 0.98
WINDOW = 48
BITS = 62
MISS = 1e-4
#: Passes that are shuffled together.
ROUND = 8
#: Rows of a block of a crowd, and of a group.
CROWD = 2048
ROWS = 1024


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> int:
    agree = (1 - math.acos(threshold) / math.pi) ** max(1.0, math.log2(max(2, n) / window))
    return max(4, math.ceil(math.log(miss) / math.log(1 - agree)))


def passes_of(bits: np.ndarray, rows: np.ndarray, threshold: float, miss: float) -> int:
    """Passes that miss a pair at the threshold with probability `miss`, where so many rows need so many leading bits."""
    lost, weight = 1 - (1 - math.acos(threshold) / math.pi) ** bits, rows / rows.sum()
    hi = 1
    while weight @ lost**hi > miss:
        hi *= 2
    lo = hi // 2
    while hi - lo > 1:
        at = (lo + hi) // 2
        lo, hi = (at, hi) if weight @ lost**at > miss else (lo, at)
    return hi


def bits_covered(passes: int, threshold: float, miss: float) -> float:
    """The leading bits up to which so many passes miss a pair at the threshold with probability `miss` at most."""
    return math.log(1 - miss ** (1 / passes)) / math.log(1 - math.acos(threshold) / math.pi)


def label_passes(rows: DataFrame, threshold: float, miss: float) -> DataFrame:
    """(label, passes) from (label, bits, rows): how many rows of a label need so many leading bits."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"label": pdf["label"].iloc[:1], "passes": [passes_of(pdf["bits"].to_numpy(np.float64), pdf["rows"].to_numpy(np.float64), threshold, miss)]})

    found = rows.groupBy("label", "bits").agg(F.sum("rows").alias("rows"))
    return found.groupBy("label").applyInPandas(run, f"label {rows.schema['label'].dataType.simpleString()}, passes int")


def in_order(coded: DataFrame) -> DataFrame:
    return coded.repartitionByRange("number", "label", "dim", "code", "node").sortWithinPartitions("number", "label", "dim", "code", "node")


@cache
def planes(dim: int, number: int) -> np.ndarray:
    return np.random.default_rng(7919 * number + dim).standard_normal((dim, BITS))


def directions(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sketches(x: np.ndarray) -> list[bytes]:
    """Each row with components of 16 bits, scaled by its largest."""
    return [r.tobytes() for r in np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 32767).astype(np.int16)]


def sketched(column) -> np.ndarray:
    x = np.frombuffer(b"".join(column), dtype=np.int16).reshape(len(column), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def loosened(threshold: float, dim: int) -> float:
    """What two sketches reach at least where their vectors reach the threshold: rounding moves a direction by sqrt(dim) / 32767 at most."""
    return threshold - 4 * math.sqrt(dim) / 65534 - dim * 2.0**-22


def codes(nodes: DataFrame, first: int, last: int) -> DataFrame:
    """(number, label, dim, code, node, sketch): a row for each vector and each pass from first to last, where it has so many."""
    weight = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby(b["vector"].map(len)):
                x = np.array(part["vector"].tolist(), dtype=np.float64)
                part = part[["label", "node", "passes"]].assign(dim=dim, sketch=sketches(x))
                for p in range(first, min(last, int(part["passes"].max()))):
                    on = (part["passes"] > p).to_numpy()
                    yield part[on].assign(number=p, code=(x[on] @ planes(dim, p) > 0) @ weight)[["number", "label", "dim", "code", "node", "sketch"]]

    label = nodes.schema["label"].dataType.simpleString()
    return nodes.select("node", "label", "vector", "passes").mapInPandas(run, f"number int, label {label}, dim int, code long, node binary, sketch binary")


def linked_within(x: np.ndarray, threshold: float, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the rows of x that are linked, up to a window apart; a tile of rows at a time."""
    for s in range(0, len(x), 4 * window):
        linked = x[s : s + 4 * window] @ x[s : s + 5 * window].T >= threshold
        i, j = np.nonzero(np.triu(linked, 1) & ~np.triu(linked, window + 1))
        yield i + s, j + s


def windows_within(b: pd.DataFrame, threshold: float, window: int) -> pd.DataFrame:
    """(u, v): a forest over the links of sorted rows (number, label, dim, node, sketch) within a window; v is the smallest of its tree."""
    place = b[["number", "label", "dim"]].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]).any(axis=1)]))
    names = sorted(set(b["node"]))
    rank = {n: k for k, n in enumerate(names)}
    own, forest = [rank[n] for n in b["node"]], Forest(len(names))
    for s, e in zip(starts, [*starts[1:], len(b)]):
        for i, j in linked_within(sketched(b["sketch"].iloc[s:e]), loosened(threshold, int(b["dim"].iloc[s])), window):
            for k, m in zip((i + s).tolist(), (j + s).tolist()):
                forest.join(own[k], own[m])
    ends = [(n, names[r]) for k, n in enumerate(names) if (r := forest.root(k)) != k]
    return pd.DataFrame(ends, columns=["u", "v"])


def bits_needed(b: pd.DataFrame, threshold: float, window: int) -> pd.DataFrame:
    """(number, label, node, bits, counted) for sorted rows but the first and last window: the leading bits that tell a row
    from those a window before and after; counted: but not from those that it is linked with."""
    near, far = b.iloc[:-window], b.iloc[window:]
    differ = (near["code"].to_numpy() ^ far["code"].to_numpy()).astype(np.float64)
    same = (near[["number", "label", "dim"]].to_numpy() == far[["number", "label", "dim"]].to_numpy()).all(axis=1)
    bits = np.where(same, np.minimum(BITS, BITS + 1 - np.frexp(differ)[1]), 0)
    counted, at = bits.copy(), np.flatnonzero(same)
    for _, i in pd.Series(at).groupby(b["dim"].to_numpy()[at]):
        i = i.to_numpy()
        linked = np.einsum("ij,ij->i", sketched(near["sketch"].iloc[i]), sketched(far["sketch"].iloc[i])) >= threshold
        counted[i[linked]] = 0
    both = {"bits": np.maximum(bits[:-window], bits[window:]), "counted": np.maximum(counted[:-window], counted[window:])}
    return b.iloc[window:-window][["number", "label", "node"]].reset_index(drop=True).assign(**both)


def window_links(ordered: DataFrame, threshold: float, window: int, covered: float) -> tuple[DataFrame, DataFrame]:
    """From sorted codes: (u, v), a forest over the links that their windows hold, in each range partition and over its
    end; and what the windows tell: (label, bits, rows), and (u, lack) for a row that needs more bits than are covered."""
    agree = 1 - math.acos(threshold) / math.pi
    columns = ["u", "v", "part", "head", "tail", "number", "label", "bits", "rows", "lack"]

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(**{c: None for c in columns if c not in pdf})[columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, tail, seen = None, None, []
        for b in batches:
            if not len(b):
                continue
            b = b.reset_index(drop=True) if tail is None else pd.concat([tail, b], ignore_index=True)
            yield whole(windows_within(b, threshold, window))
            head = b.head(window) if head is None else head
            tail = b.tail(2 * window)
            if len(b) > 2 * window:
                need = bits_needed(b, threshold, window)
                counts = need[need["counted"] > 0].groupby(["label", "counted"]).size().rename("rows").reset_index()
                seen = [pd.concat([*seen, counts]).groupby(["label", "counted"])["rows"].sum().reset_index()]
                need = need[need["bits"] > covered]
                lack = np.log((1 - agree ** need["bits"]) / (1 - agree**covered))
                yield whole(pd.DataFrame({"u": need["node"], "number": need["number"], "lack": lack}))
        if tail is not None:
            ends = {"part": [TaskContext.get().partitionId()], "head": [pickle.dumps(head)], "tail": [pickle.dumps(tail.tail(window))]}
            yield whole(pd.DataFrame(ends))
            for counts in seen:
                yield whole(counts.rename(columns={"counted": "bits"}).assign(number=TaskContext.get().partitionId()))

    kind = ordered.schema["label"].dataType.simpleString()
    found = ordered.mapInPandas(run, f"u binary, v binary, part int, head binary, tail binary, number int, label {kind}, bits int, rows long, lack double")
    found = cut(found.distinct())  # the passes find the same trees again; other rows differ by part or number
    in_turn = Window.orderBy("part")  # one row a partition
    borders = found.where("part is not null").select("tail", F.lead("head").over(in_turn).alias("head")).where("head is not null")

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for tail, head in zip(b["tail"], b["head"]):
                yield windows_within(pd.concat([pickle.loads(tail), pickle.loads(head)], ignore_index=True), threshold, window)

    across = borders.repartition("head").mapInPandas(over, "u binary, v binary")
    return found.where("v is not null").select("u", "v").unionByName(across), found.where("rows is not null or lack is not null").select("u", "label", "bits", "rows", "lack")


def passes_links(nodes: DataFrame, first: int, last: int, threshold: float, window: int, covered: float) -> tuple[DataFrame, DataFrame]:
    """window_links() of the passes from first to last, ROUND at a time, so that what a round shuffled can go before the next."""
    rounds = [window_links(in_order(codes(nodes, k, min(k + ROUND, last))), threshold, window, covered) for k in range(first, last, ROUND)]
    return tuple(reduce(DataFrame.unionByName, x) for x in zip(*rounds))


def all_links(crowd: DataFrame, threshold: float) -> DataFrame:
    """(u, v): a forest over all links of crowd (node, label, vector, g), a label dealt into g blocks and two blocks a task."""

    def slim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby(b["vector"].map(len)):
                yield part[["node", "label", "g"]].assign(dim=dim, sketch=sketches(np.array(part["vector"].tolist(), dtype=np.float64)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node", ignore_index=True)
        x, least = sketched(pdf["sketch"]), loosened(threshold, int(pdf["dim"].iloc[0]))
        linked = np.concatenate([x[s : s + 1024] @ x.T >= least for s in range(0, len(x), 1024)])
        top = first_linked(linked)
        on = np.flatnonzero(top != np.arange(len(x)))
        return pd.DataFrame({"u": pdf["node"].to_numpy()[on], "v": pdf["node"].to_numpy()[top[on]]})

    kind = crowd.schema["label"].dataType.simpleString()
    df = crowd.select("node", "label", "vector", "g").mapInPandas(slim, f"node binary, label {kind}, g int, dim int, sketch binary")
    df = df.withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    df = df.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    return df.groupBy("label", "dim", "lo", "hi").applyInPandas(run, "u binary, v binary")


def cosine(threshold: float):
    def compare(a: pd.DataFrame, b: pd.DataFrame | None) -> np.ndarray:
        x = directions(a["vector"])
        return x @ (x if b is None else directions(b["vector"])).T >= threshold

    return compare


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS, id_col: str = "vec_id", block: int = ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of vectors (id, embedding, label)."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(F.col(id_col).alias("id"), "label", F.col("embedding").cast(kind).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    text = F.concat_ws(",", F.col("label").cast("string"), F.transform("vector", lambda x: (x.cast("double") + F.lit(0.0)).cast("string")))
    v = cut(v.withColumn("node", F.when(F.coalesce(valid, F.lit(False)), F.unhex(F.md5(text)))))
    nodes = cut(v.where("node is not null").groupBy("node").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")))
    least = passes_for(nodes.count(), threshold, window, miss)
    covered = bits_covered(least, threshold, miss)
    links, told = passes_links(nodes.withColumn("passes", F.lit(least)), 0, least, threshold, window, covered)
    need = cut(label_passes(told.where("rows is not null"), threshold, miss).where(F.col("passes") > least))
    if not need.isEmpty():
        lacking = told.where("lack is not null").groupBy("u").agg(F.sum("lack").alias("lack")).where(F.col("lack") > math.log(2)).select(F.col("u").alias("node"))
        crowd = cut(nodes.select("node", "label", "vector").join(F.broadcast(need), "label").join(lacking, "node"))
        blocks = cut(crowd.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("g")))
        crowd = crowd.join(F.broadcast(blocks), "label")
        few = F.col("g") <= F.col("passes") - least
        links = links.unionByName(cut(all_links(crowd.where(few), threshold).distinct()))
        last = crowd.where(~few).agg(F.max("passes")).first()[0]
        if last:
            links = links.unionByName(passes_links(crowd.where(~few), least, last, threshold, window, covered)[0])
    groups = connected_components(links)
    members = groups.join(nodes.select("node", "copies", "vector"), "node")
    found = gather(links_within(members, cosine(threshold), block), nodes)
    per = cut(nodes.join(found, "node", "left").select("node", F.coalesce("class_id", "first_id").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n")))
    out = v.select("id", "node").join(per, "node", "left").withColumn("c", F.coalesce("c", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.col("c").alias("component_id"), F.col("id").eqNullSafe(F.col("c")).alias("kept"))
