"""N-gram Jaccard join: MinHash bands find candidates, full shingle sets decide.

Texts are lower-cased (A-Z) and cut into words; a text's set holds its shingles of five consecutive words, or the one
shingle of all its words if it has fewer. Texts with equal word sequences are one node with a count of copies, so
copies are never paired with each other.

Each node's MinHash signature is cut into bands. Rows and bands are the pair that misses at most `miss` of the pairs
at the threshold with the fewest hashes times bands (6 rows and 36 bands for 0.8 and 2e-5). Nodes are shuffled by band
hash. Within a bucket, signatures (a byte of each hash) are compared, and two nodes are linked where they agree on no fewer
hashes than a pair at the threshold does but for `miss`. A bucket of more than
`bucket` nodes (`REFINED` once it is refined) is refined: its nodes are dealt by each of the other bands again, so a pair in it still meets with the same
probability, and pages on one template, similar but not enough, part. Where a bucket's nodes are mostly similar to its first one,
or after DEPTH bands, they are linked without comparison.

The components of those links are the candidate groups. Within a group every pair of nodes is verified on the full sets,
in blocks of bounded size (see graph.py); no pair is written out.

Defined results: a text that is null or has no words links with nothing and is its own class; rows with equal ids and
texts count as copies; an id may stand for several texts, which are told apart; equal word sequences are always
linked; null ids are allowed (a class of such rows only has a null id); an empty table gives an empty result; other
columns are ignored by `near_duplicates` and kept by `keep_one`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from vexel.llm.common import cut, free_name, word_list
from vexel.llm.graph import BLOCK, Forest, connected_components, gather, links_within
from vexel.shared import join_small

SHINGLE = 5
THRESHOLD = 0.8
MISS = 2e-5
#: Nodes of a bucket of one band, and of more bands, that are compared with each other; bands at most; rows compared at once.
BUCKET, REFINED, DEPTH, ROWS = 1024, 8192, 3, 20_000
#: Word hashes that a task remembers.
REMEMBERED = 500_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


@cache
def bands_for(threshold: float = THRESHOLD, miss: float = MISS, most_rows: int = 6) -> tuple[int, int]:
    """(rows, bands): as selective as most_rows allows, and missing a pair at the threshold with probability `miss` at most."""
    return most_rows, math.ceil(math.log(miss) / math.log(1 - threshold**most_rows))


@cache
def family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 1 << 32, (n, 1), dtype=np.uint32), rng.integers(0, 1 << 31, (n, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


class Shingler:
    def __init__(self, k: int):
        self.k, self.known = k, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        """64-bit hashes of the text's shingles, sorted and distinct."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))
        n = max(1, len(h) - self.k + 1)
        out = np.zeros(n, dtype=np.uint64)
        for i in range(min(self.k, len(h))):
            out = out * MULTIPLIER + h[i : i + n]
        out ^= out >> np.uint64(32)
        out *= MIX
        return np.unique(out ^ (out >> np.uint64(29)))


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    flip, odd = family(n)
    x, best = (shingles >> np.uint64(32)).astype(np.uint32), np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 1024):
        best = np.minimum(best, ((x[i : i + 1024] ^ flip) * odd).min(axis=1))
    return best


def band_hashes(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """(texts, bands) 64-bit hashes, different for each band."""
    parts, out = sig.reshape(len(sig), bands, rows).astype(np.uint64), np.arange(1, bands + 1, dtype=np.uint64) * MIX
    for r in range(rows):
        out = (out + parts[:, :, r]) * MULTIPLIER
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def least_agreeing(n: int, threshold: float, miss: float) -> int:
    """Of n hashes, cut to a byte, the fewest that a pair at the threshold agrees on but with probability `miss`."""
    p, k, below = threshold + (1 - threshold) / 256, 0, (1 - threshold - (1 - threshold) / 256) ** n
    term = below
    while below <= miss:
        term *= (n - k) / (k + 1) * p / (1 - p)
        k += 1
        below += term
    return k


def node_of(words: list[str]) -> bytes | None:
    return hashlib.md5(" ".join(words).encode()).digest() if words else None


def signatures(docs: DataFrame, id_col: str, k: int, rows: int, bands: int) -> DataFrame:
    """(id, digest, node, bands, sketch) for each row; digest: of the text as it is, sketch: a byte of each hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(k)
        for b in batches:
            nodes, sigs = [], []
            for t in b["text"]:
                words = word_list(t)
                nodes.append(node_of(words))
                sigs.append(signature(shingler(words), rows * bands) if words else np.zeros(rows * bands, dtype=np.uint32))
            sigs = np.array(sigs, dtype=np.uint32).reshape(len(b), rows * bands)
            sketches = (((sigs * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8))
            yield pd.DataFrame({"id": b[id_col], "digest": b["digest"], "node": nodes, "bands": list(band_hashes(sigs, rows, bands)), "sketch": [x.tobytes() for x in sketches]})

    narrow = docs.select(id_col, "text", F.xxhash64("text").alias("digest"))
    return narrow.mapInPandas(run, f"id {narrow.schema[id_col].dataType.simpleString()}, digest long, node binary, bands array<bigint>, sketch binary")


def agreeing(a, b) -> np.ndarray:
    """On how many bytes the sketches of two lists agree."""
    return (np.frombuffer(b"".join(a), dtype=np.uint8) == np.frombuffer(b"".join(b), dtype=np.uint8)).reshape(len(a), -1).sum(axis=1)


def linked(keys: np.ndarray, nodes: list[bytes], sketches: np.ndarray, least: int) -> pd.DataFrame:
    """(u, v, compared): a forest over nodes with equal keys (sorted) that agree on `least` hashes; a last row counts the pairs looked at."""
    forest, root, compared = Forest(len(keys)), np.arange(len(keys)), 0
    for d in range(1, len(keys)):
        i = np.flatnonzero(keys[d:] == keys[:-d])
        if not len(i):
            break
        i = i[root[i] != root[i + d]]
        compared += len(i)
        for at in range(0, len(i), ROWS):
            part = i[at : at + ROWS]
            for x in part[(sketches[part] == sketches[part + d]).sum(axis=1) >= least].tolist():
                forest.join(x, x + d)
        root = np.asarray(forest.up)
        while (root[root] != root).any():
            root = root[root]
    ends = np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({"u": [*[nodes[i] for i in ends], None], "v": [*[nodes[i] for i in root[ends]], None], "compared": [*[0] * len(ends), compared]})


def bucket_links(keyed: DataFrame, least: int) -> DataFrame:
    """linked() within the buckets (key, node, sketch)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def whole(b: pd.DataFrame) -> pd.DataFrame:
            return linked(b["key"].to_numpy(), b["node"].tolist(), np.frombuffer(b"".join(b["sketch"]), dtype=np.uint8).reshape(len(b), -1), least)

        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            keys = b["key"].to_numpy()
            ended = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on
            rest = b.iloc[ended:]
            if ended:
                yield whole(b.iloc[:ended])
        if rest is not None and len(rest):
            yield whole(rest)

    return keyed.repartition("key").sortWithinPartitions("key", "node").mapInPandas(run, "u binary, v binary, compared long")


def alike_buckets(rows: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """(key) of the buckets (key, node, first) of which half agree with their first node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"key": b["key"], "near": (agreeing(b["sketch"], b["other"]) >= least).astype(float)})

    firsts = rows.select("key", "first").distinct().join(sketches.withColumnsRenamed({"node": "first", "sketch": "other"}), "first").select("key", "other")
    beside = join_small(rows.join(sketches, "node"), firsts, ["key"], most=20_000)
    return beside.select("key", "sketch", "other").mapInPandas(run, "key long, near double").groupBy("key").agg(F.avg("near").alias("near")).where("near >= 0.5").select("key")


def candidate_links(nodes: DataFrame, least: int, bucket: int = BUCKET, refined: int = REFINED, depth: int = DEPTH) -> DataFrame:
    """(u, v, compared) of nodes (node, bands, sketch)."""
    sketches, out = nodes.select("node", "sketch"), []
    keyed = nodes.select("node", F.explode("bands").alias("key")).withColumn("used", F.array("key"))
    for level in range(depth):
        limit, last = refined if level else bucket, level + 1 == depth
        sizes = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where("n > 1"))
        rows = cut(keyed.join(sizes, "key"))
        out.append(cut(bucket_links(rows.where(F.col("n") <= limit).select("node", "key").join(sketches, "node"), least)))
        large = sizes.where(F.col("n") > limit).select("key", "first")
        if large.isEmpty():
            break
        rows = rows.where(F.col("n") > limit)
        alike = large.select("key") if last else cut(alike_buckets(rows, sketches, least))
        chained = (rows if last else join_small(rows, alike, ["key"], "left_semi")).where("node <> first")
        out.append(chained.select(F.col("node").alias("u"), F.col("first").alias("v"), F.lit(0).cast("long").alias("compared")))
        if last:
            break
        spread = join_small(rows, alike, ["key"], "left_anti").select("node", "used")
        more = spread.join(nodes.select("node", F.explode("bands").alias("band")), "node").where(~F.array_contains("used", F.col("band")))
        more = more.select("node", F.array_sort(F.array_append("used", F.col("band"))).alias("used"))  # the same whichever band came first
        keyed = cut(more.select("node", F.xxhash64("used").alias("key"), "used").distinct())
    return reduce(DataFrame.unionByName, out)


def similar(k: int, threshold: float):
    """Which texts of a block, or of two, have Jaccard similarity of at least threshold."""

    def compare(a: pd.DataFrame, b: pd.DataFrame | None) -> np.ndarray:
        shingler = Shingler(k)
        sets = [shingler(word_list(t)) for x in (a, b) if x is not None for t in x["text"]]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        code = np.concatenate([[0], np.cumsum(flat[1:] != flat[:-1])])
        common = np.bincount(code)[code] > 1  # the others are in no intersection
        code, owner = code[common], owner[common]
        split = len(a) if b is not None else len(sets)
        right = slice(0, split) if b is None else slice(split, len(sets))
        inter = np.zeros((split, right.stop - right.start), dtype=np.float64)
        at = 0
        while at < len(code):  # some thousand shingles at a time
            end = int(np.searchsorted(code, code[at] + 2048))
            m = np.zeros((len(sets), 2048), dtype=np.float32)
            m[owner[at:end], code[at:end] - code[at]] = 1
            inter += m[:split] @ m[right].T
            at = end
        union = sizes[:split, None] + sizes[right][None, :] - inter
        return inter / union >= threshold

    return compare


def classes(docs: DataFrame, k: int, threshold: float, miss: float, id_col: str, block: int) -> DataFrame:
    """(id, digest, class_id, n_links) for each row."""
    rows, bands = bands_for(threshold, miss)
    signed = cut(signatures(docs, id_col, k, rows, bands))
    nodes = cut(signed.where("node is not null").groupBy("node").agg(
        F.min("id").alias("first_id"), F.coalesce(F.min_by("digest", "id"), F.min("digest")).alias("digest"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    groups = connected_components(candidate_links(nodes, least_agreeing(rows * bands, threshold, miss)).where("u is not null").select("u", "v"))
    members = groups.join(nodes.drop("bands", "sketch"), "node")
    texts = docs.select(F.col(id_col).alias("first_id"), "text", F.xxhash64("text").alias("digest"))
    same = members["first_id"].eqNullSafe(texts["first_id"]) & (members["digest"] == texts["digest"])  # an id may stand for several texts
    texts = members.join(texts, same).select(members["node"], "component", "copies", "text")
    found = gather(links_within(texts, similar(k, threshold), block), nodes)
    all_nodes = cut(nodes.drop("bands", "sketch").join(found, "node", "left").select(
        "node", F.coalesce("class_id", "first_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = signed.drop("bands", "sketch").join(all_nodes, "node", "left")
    return out.select("id", "digest", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, miss: float = MISS, id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(id, class_id, n_links, kept) for each row: class_id is the smallest id in the text's component of links, n_links
    the number of other rows whose texts are similar, kept whether the row's id is class_id."""
    out = classes(docs, k, threshold, miss, id_col, block)
    return out.select(F.col("id").alias(id_col), "class_id", "n_links", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))



def keep_one(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is the smallest of their class, one for each id and text; rows without an id stay."""
    name, digest = free_name(docs, "kept"), free_name(docs, "digest")
    found = classes(docs, k, threshold, MISS, id_col, BLOCK).where("id = class_id").select(F.col("id").alias(name), F.col("digest").alias(digest)).distinct()
    kept = cut(found)
    named = docs.where(F.col(id_col).isNotNull()).withColumn(digest, F.xxhash64("text"))
    one = named.join(kept, (named[id_col] == kept[name]) & (named[digest] == kept[digest]), "left_semi").dropDuplicates([id_col, digest]).drop(digest)
    return one.unionByName(docs.where(F.col(id_col).isNull()))
