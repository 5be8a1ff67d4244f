"""Benchmark decontamination: a broadcast hash set of the test items' word windows, looked up in every window of the training texts.

Texts are lower-cased (A-Z) and cut into words. Each item gives its windows of `n` consecutive words; an item with
fewer words, but not none, is one window. Words of the items get numbers, so a document word outside their vocabulary
ends a run at once; the polynomial hash of a run's windows is looked up in the sorted hashes of the items, and every
hit is verified on the word numbers themselves.

The items are cut into pieces and dealt into shards of about `shard_windows` windows by a hash. Each shard is built once, on
the driver, and broadcast by itself; the texts pass one shard after another, and are written between two shards, so neither
the driver nor a task ever holds more than one shard, however large the benchmark is.

Defined results: a null text or one without words has no hits; null items and repeated items are allowed, equal
item_ids count once; items without an id hit like others, count as one item and have no name in the digest; an empty benchmark leaves all clean; each row of docs gives one row, repeated ids included;
other columns of docs are kept by `remove_hits` and ignored by `find_hits`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import Broadcast
from pyspark.sql import DataFrame

from vexel.llm.common import WORDS, free_name, lower_az, stored, word_list

N = 10
#: Windows in one broadcast: about 100 bytes each.
SHARD_WINDOWS = 1_000_000
#: Words of a piece of an item.
PIECE = 5_000
BASE = np.uint64(0x9E3779B97F4A7C15)

HITS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash, modulo 2^64, of each n consecutive numbers."""
    out = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
    for i in range(n):
        out = out * BASE + ids[i : i + len(out)]
    return out


class Shard:
    """The windows of some pieces of items, by length: sorted hashes of the distinct windows, the word numbers of each, and its items."""

    def __init__(self, pieces: list[tuple[str | None, list[str]]], n: int):
        self.vocabulary: dict[str, int] = {}
        self.names = sorted({k for k, _ in pieces}, key=lambda k: (k is None, k or ""))
        number = {k: i for i, k in enumerate(self.names)}
        parts: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for k, words in pieces:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.uint32)
            size = min(n, len(ids))
            rows, owners = parts.setdefault(size, ([], []))
            rows.append(np.lib.stride_tricks.sliding_window_view(ids, size))
            owners.append(np.full(len(ids) - size + 1, number[k], dtype=np.int32))
        #: size -> hashes, word numbers, where the items of a window start, items
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, (rows, owners) in parts.items():
            windows, at = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            hashes = np.zeros(len(windows), dtype=np.uint64)
            for i in range(size):
                hashes = hashes * BASE + windows[:, i]
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            held = np.unique(np.stack([place[at.ravel()], np.concatenate(owners)], axis=1), axis=0)
            self.tables[size] = hashes[order], windows[order], np.searchsorted(held[:, 0], np.arange(len(order) + 1)), held[:, 1].astype(np.int32)

    def hits(self, words: list[str], hit: np.ndarray) -> set[str | None]:
        """Marks the hit words; the items with windows in the text."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        found: set[int] = set()
        for size, (hashes, rows, start, owners) in self.tables.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            h = window_hashes(ids, size)[at]
            low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            some = np.flatnonzero(high > low)
            for i, lo, hi in zip(at[some], low[some], high[some]):
                for k in range(lo, hi):  # windows with equal hashes stand together
                    if np.array_equal(rows[k], ids[i : i + size]):
                        hit[i : i + size] = True
                        found.update(owners[start[k] : start[k + 1]].tolist())
        return {self.names[i] for i in found}


def pieces_of(benchmark: DataFrame, n: int) -> DataFrame:
    """(item, words, windows): items in pieces of PIECE words and the n - 1 after them, so that each window is in one piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b["item"], b["text"]):
                words = word_list(t)
                for at in range(0, len(words), PIECE):
                    piece = words[at : at + PIECE + n - 1]
                    if at == 0 or len(piece) >= n:
                        out.append((k, piece, max(1, len(piece) - n + 1)))
            yield pd.DataFrame(out, columns=["item", "words", "windows"])

    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    return items.mapInPandas(run, "item string, words array<string>, windows long")


def in_shards(docs: DataFrame, benchmark: DataFrame, n: int, shard_windows: int, step: Callable[[DataFrame, Broadcast, bool], DataFrame]) -> DataFrame:
    """Leads docs through `step` with one shard after another (the last is told so); what it gives is written between two."""
    sc, pieces = docs.sparkSession.sparkContext, pieces_of(benchmark, n)
    shards = max(1, -(-int(pieces.agg(F.sum("windows")).first()[0] or 0) // shard_windows))
    if shards > 1:
        pieces = stored(pieces.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(shards))))
    for i in range(shards):
        part = pieces if shards == 1 else pieces.where(F.col("shard") == i)
        rows = [(r[0], list(r[1])) for r in part.select("item", "words").collect()]  # about shard_windows windows
        sent, last = sc.broadcast(Shard(rows, n)), i == shards - 1
        docs = step(docs, sent, last)
        if not last:
            docs = stored(docs)
            sent.unpersist()
    return docs


def scan(texts, shard: Shard, hits: list[bytes | None] | None, items: list | None) -> tuple[list[list[str]], list[np.ndarray], list[set]]:
    """(words, hit, items) of each text, with what earlier shards have found: hit words as packed bits, items."""
    words = [word_list(t) for t in texts]
    hit = [np.zeros(len(w), dtype=bool) if x is None else np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(w)).astype(bool) for w, x in zip(words, hits or [None] * len(words))]
    found = [set() if x is None else set(x) for x in (items or [None] * len(words))]
    for w, h, f in zip(words, hit, found):
        if w:
            f |= shard.hits(w, h)
    return words, hit, found


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = N, shard_windows: int = SHARD_WINDOWS, id_col: str = "doc_id") -> DataFrame:
    """For each row of docs: its id, n_words, n_hit, n_items, items_sha256 and contaminated."""

    def step(df: DataFrame, sent: Broadcast, last: bool) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shard = sent.value
            for b in batches:
                words, hit, items = scan(b["text"], shard, *((b["hit"].tolist(), b["items"].tolist()) if "hit" in b else (None, None)))
                if last:
                    yield pd.DataFrame({
                        id_col: b["id"], "n_words": [len(w) for w in words], "n_hit": [int(h.sum()) for h in hit], "n_items": [len(x) for x in items],
                        "items_sha256": [hashlib.sha256(",".join(sorted(x - {None})).encode()).hexdigest() for x in items],
                        "contaminated": [bool(x) for x in items],
                    })
                else:
                    yield pd.DataFrame({"id": b["id"], "text": b["text"], "hit": [np.packbits(h).tobytes() for h in hit], "items": [list(x) for x in items]})

        kind = df.schema["id"].dataType.simpleString()
        return df.mapInPandas(run, f"{id_col} {kind}, {HITS}" if last else f"id {kind}, text string, hit binary, items array<string>")

    return in_shards(docs.select(F.col(id_col).alias("id"), "text"), benchmark, n, shard_windows, step)


def without_spans(text: str, hit: np.ndarray) -> str:
    """The text without the runs of hit words and what stands between the words of a run."""
    out, end, last = [], 0, -2
    for i, m in enumerate(WORDS.finditer(lower_az(text))):
        if hit[i]:
            out.append(text[end : m.start()] if last != i - 1 else "")
            end, last = m.end(), i
    return "".join([*out, text[end:]])


def remove_hits(docs: DataFrame, benchmark: DataFrame, unit: str = "documents", n: int = N, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """docs without the contaminated rows (unit "documents"), or with the hit runs cut out of their texts ("spans")."""
    name = free_name(docs, "__hit")

    def step(df: DataFrame, sent: Broadcast, last: bool) -> DataFrame:
        marked = df.schema[-1].name == name

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard = sent.value
            for b in batches:
                texts = b.column("text").to_pylist()
                _, hit, items = scan(texts, shard, b.column(name).to_pylist() if marked else None, None)
                if marked:
                    b = b.select(b.schema.names[:-1])
                if unit == "documents":
                    keep = [not h.any() for h in hit]
                    b, hit = b.filter(pa.array(keep, type=pa.bool_())), [h for h, k in zip(hit, keep) if k]
                elif last:
                    left = [without_spans(t, h) if h.any() else t for t, h in zip(texts, hit)]
                    at = b.schema.get_field_index("text")
                    b = b.set_column(at, b.schema.field(at), pa.array(left, type=b.schema.field(at).type))
                if not last:
                    b = b.append_column(name, pa.array([np.packbits(h).tobytes() for h in hit], type=pa.binary()))
                yield b

        return df.mapInArrow(run, docs.schema if last else docs.select("*", F.lit(None).cast("binary").alias(name)).schema)

    return in_shards(docs, benchmark, n, shard_windows, step)
