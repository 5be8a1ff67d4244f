"""LM scoring by prediction by partial matching over bytes.

Texts are lower-cased (A-Z) and cut into tokens; the model codes the tokens joined by single spaces, as UTF-8 bytes,
then one end symbol, each byte given up to five before it. Counts of all six-byte windows of the training texts are
gathered from the whole corpus: the context trie of orders 0 to 5. Escapes are estimated by method D (d distinct of
n symbols seen: escape d/2n, half a count from each of the d), and symbols seen in a longer context are excluded from the shorter ones, so each
context holds a proper distribution; the code length of a text is the sum of -log10 of its bytes' probabilities. The
blended distributions are computed once, before scoring (the pretrained part). Above them stands one adaptive order: the
twelve bytes before, if they stood earlier in the text, predict what followed them there.

Size: every context that the corpus holds counts. A byte's probability depends on its window only. Each distinct window
of the corpus is given its probability once, in shards by the last three bytes of its context, which hold all that the
longer contexts need. The SENT most frequent windows are sent to the tasks. A text's other windows are joined by key and their
probabilities added to its score; only where the adaptive order needs one of them (a repeated context that goes on another way)
is the text itself scored again, with its windows beside it.

The base is a unigram model of tokens. Its counts cover all training texts; the FREQUENT most frequent words are sent
to the tasks, and all others are joined by word.

Defined results: a null text is empty, and an empty text is the end alone; without training texts every byte has
probability 1/257; repeated rows are scored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from vexel.llm.common import fold, stored

FOLDS, HELD_OUT = 10, 0
ORDER = 5
END = 0xFF  # not a byte of UTF-8
SYMBOLS = 257
FREQUENT = 120_000
#: Windows sent to the tasks, and windows of a shard.
SENT, SHARD = 2_000_000, 200_000
#: Distinct words and windows that a task gathers before it hands counts on, and bytes of text that it counts at a time.
FLUSH_WORDS, FLUSH_WINDOWS, FLUSH_BYTES = 400_000, 4_000_000, 4_000_000
#: Texts whose tokens a task holds at a time, and bytes that it scores at a time (a longer text is scored whole).
STEP, PIECE = 128, 130_000
#: Bytes of the adaptive context.
ADAPTIVE = 12
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
ADD = 0.1


def tokens_of(text: str | None) -> list[bytes]:
    """The lower-cased tokens as UTF-8; bytes.lower() and bytes.split() know A-Z and ASCII white space only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def coded(tokens: list[bytes]) -> bytes:
    return b" ".join(tokens) + bytes([END])


def word_of(token: bytes) -> str:
    return token.decode("utf-8", "surrogatepass").encode("utf-8", "replace").decode()


def window_keys(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, text, places) of coded texts behind ORDER ends each, and the window that ends at each place, as a number."""
    b = np.frombuffer(b"".join(bytes([END]) * ORDER + r for r in raw), dtype=np.uint8)
    sizes = np.array([len(r) + ORDER for r in raw], dtype=np.int64)
    text = np.repeat(np.arange(len(raw)), sizes)
    return b, text, np.arange(len(b)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def codes_at(b: np.ndarray) -> np.ndarray:
    """The window that ends at each byte from the ORDER-th on, as a number."""
    code = np.zeros(max(0, len(b) - ORDER), dtype=np.uint64)
    for i in range(ORDER + 1):
        code = (code << np.uint64(8)) | b[i : len(b) - ORDER + i]
    return code


def windows(raw: list[bytes], learn: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the coded texts, and their counts in those that are learnt from; a window may stand twice, once with count 0."""
    out = []
    for known in (True, False):
        b, _, place = window_keys([r for r, k in zip(raw, learn) if k == known])
        key, n = np.unique(codes_at(b)[place[ORDER:] >= ORDER], return_counts=True)
        out.append((key.view(np.int64), n if known else np.zeros(len(n), dtype=np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of several parts, each key once."""
    key, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key)
    key, n = key[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[start], np.add.reduceat(n, start) if len(key) else n


def gather_counts(docs: DataFrame) -> DataFrame:
    """(word, window, n): counts of the tokens ("" is the end) and windows of all rows of docs (text, learn); windows of other rows count 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[bytes] = Counter()
        raw, learn, held, parts = [], [], 0, []

        def count() -> None:
            parts.append(windows(raw, learn))
            raw.clear()
            learn.clear()

        def out_windows() -> pd.DataFrame:
            key, n = summed(parts)
            parts.clear()
            return pd.DataFrame({"word": None, "window": key, "n": n})

        def out_words() -> pd.DataFrame:
            out = pd.DataFrame({"word": [word_of(w) for w in words], "window": None, "n": list(words.values())})
            words.clear()
            return out

        for b in batches:
            for t, known in zip(b["text"], b["learn"]):
                found = tokens_of(t)
                if known:
                    words.update(found)
                    words[b""] += 1
                raw.append(coded(found))
                learn.append(known)
                held += len(raw[-1])
                if held >= FLUSH_BYTES:
                    count()
                    held = 0
                    if sum(len(k) for k, _ in parts) >= FLUSH_WINDOWS:
                        parts[:] = [summed(parts)]
                        if len(parts[0][0]) >= FLUSH_WINDOWS // 2:
                            yield out_windows()
            if len(words) >= FLUSH_WORDS:
                yield out_words()
        if words:
            yield out_words()
        if raw:
            count()
        if parts:
            yield out_windows()

    return docs.select("text", "learn").mapInPandas(run, "word string, window long, n long").groupBy("word", "window").agg(F.sum("n").alias("n"))


def adapt(b: np.ndarray, piece: np.ndarray, place: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, free, bad): log10 probabilities when the ADAPTIVE bytes before a byte have stood earlier in the same text.

    b: bytes; piece: the text of each; place: of each byte from the ORDER-th on, its place in the text; p: log10
    probability of those by the pretrained contexts, NaN where it isn't known yet. Where the context is known, the bytes
    that followed it before are coded by method D, and any other escapes to the pretrained distribution without them.
    free: q doesn't hold p; elsewhere an unknown p counts 0 and is to be added. bad: q needs unknown p of earlier bytes.
    """
    unknown, free, bad = np.isnan(p), np.zeros(len(p), dtype=bool), np.zeros(len(p), dtype=bool)
    p = np.where(unknown, 0.0, p)
    at = np.flatnonzero(place >= ADAPTIVE + ORDER)
    if not len(at):
        return p, free, bad
    code = b.astype(np.uint64) + np.uint64(1)
    width, h = 1, code * MULTIPLIER
    h ^= h >> np.uint64(29)
    while width < ADAPTIVE:  # hash of the last `width` bytes; doubling, with overlap in the last step
        step = min(width, ADAPTIVE - width)
        moved = np.zeros_like(h)
        moved[step:] = h[:-step]
        h = (moved * MULTIPLIER + h + np.uint64(width)) * MULTIPLIER
        h ^= h >> np.uint64(31)
        width += step
    h = h[ORDER - 1 : -1][at] ^ (piece[ORDER:][at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    bits = max(10, (8 * len(h)).bit_length())
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
    first_at, here = np.empty(1 << bits, dtype=np.int32), np.arange(len(h), dtype=np.int32)
    first_at[bucket[::-1]] = here[::-1]  # the first of each bucket is written last
    earlier = first_at[bucket]
    again = earlier != here
    again[earlier[again]] = True
    some = np.flatnonzero(again)  # contexts that stand twice, and a few that share a bucket
    order = some[np.argsort(h[some], kind="stable")]
    same = h[order][1:] == h[order][:-1]
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(order) else same
    order = order[twice]
    if not len(order):
        return p, free, bad
    group = np.concatenate([[0], np.cumsum(h[order][1:] != h[order][:-1])])
    at = at[order]
    y, low = b[ORDER:][at].astype(np.int64), np.where(unknown[at], 0.0, 10.0 ** p[at])
    head = np.concatenate([[True], group[1:] != group[:-1]])
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    n = np.arange(len(group)) - first  # times that the context stood before
    pair = group * 256 + y
    by_pair = np.argsort(pair, kind="stable")
    new = np.concatenate([[True], pair[by_pair][1:] != pair[by_pair][:-1]])
    c = np.empty(len(pair), dtype=np.int64)  # times that this byte followed
    c[by_pair] = np.arange(len(pair)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    fresh = c == 0

    def before(x: np.ndarray) -> np.ndarray:
        total = np.cumsum(x) - x
        return total - total[first]

    d, gone = before(fresh.astype(np.float64)), before(np.where(fresh, low, 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        escaped = np.log10(0.5 * d / n) + p[at] - np.log10(np.maximum(1 - gone, 1e-9))
        out = np.where(n == 0, p[at], np.where(c > 0, np.log10((c - 0.5) / n), escaped))
    bad[at] = (n > 0) & (c == 0) & (before((fresh & unknown[at]).astype(np.float64)) > 0)
    free[at] = c > 0
    p[at] = out
    return p, free, bad


@dataclass
class Level:
    """Contexts of one order: the probabilities of the symbols seen in each, and what an escape to the next shorter context costs."""

    grams: np.ndarray  # context and symbol, sorted
    p: np.ndarray
    contexts: np.ndarray  # sorted
    escape: np.ndarray


def lookup(names: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, found) of x among sorted names."""
    if not len(names):
        return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(names, x), len(names) - 1)
    return at, names[at] == x


def probability(levels: list[Level], g: np.ndarray) -> np.ndarray:
    """Probabilities of windows (uint64) by contexts of up to len(levels) - 1 bytes."""
    if not levels:
        return np.full(len(g), 1 / SYMBOLS)
    p = probability(levels[:-1], g & np.uint64((1 << (8 * (len(levels) - 1))) - 1))
    at, there = lookup(levels[-1].contexts, g >> np.uint64(8))
    p[there] *= levels[-1].escape[at[there]]
    at, seen = lookup(levels[-1].grams, g)
    p[seen] = levels[-1].p[at[seen]]
    return p


def level(lower: list[Level], g: np.ndarray, n: np.ndarray) -> Level:
    """The next level above `lower`, from its windows and their counts."""
    g, at = np.unique(g, return_inverse=True)
    n = np.bincount(at, weights=n, minlength=len(g))
    contexts, at = np.unique(g >> np.uint64(8), return_inverse=True)
    total, d = np.bincount(at, weights=n, minlength=len(contexts)), np.bincount(at, minlength=len(contexts))
    left = 1 - np.bincount(at, weights=probability(lower, g & np.uint64((1 << (8 * len(lower))) - 1)), minlength=len(contexts))
    full = left <= 1e-12
    return Level(g, np.where(full[at], n, n - 0.5) / total[at], contexts, np.where(full, 0, 0.5 * d / total / np.where(full, 1, left)))


def window_scores(grams: DataFrame) -> DataFrame:
    """(key, n, p): log10 probability of every window (window, n); n may be 0."""
    lower: list[Level] = []
    few = grams.where("n > 0").groupBy(F.col("window").bitwiseAND((1 << 24) - 1).alias("g")).agg(F.sum("n").alias("n")).toPandas()  # at most 2^24
    g, n = few["g"].to_numpy(np.int64).astype(np.uint64), few["n"].to_numpy(np.float64)
    for o in range(3):
        lower.append(level(lower, g & np.uint64((1 << (8 * (o + 1))) - 1), n))
    sent = grams.sparkSession.sparkContext.broadcast(lower)
    shards = max(8, grams.count() // SHARD)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        levels, g, n = list(sent.value), pdf["window"].to_numpy(np.int64).view(np.uint64), pdf["n"].to_numpy(np.int64)
        seen = n > 0
        for o in range(3, ORDER + 1):
            levels.append(level(levels, g[seen] & np.uint64((1 << (8 * (o + 1))) - 1), n[seen]))
        p = np.log10(np.maximum(probability(levels, g), 1e-30))
        return pd.DataFrame({"key": pdf["window"], "n": n, "p": p.astype(np.float32)})

    shard = F.pmod(F.xxhash64(F.shiftrightunsigned("window", 8).bitwiseAND((1 << 24) - 1)), F.lit(shards))
    return stored(grams.groupBy(shard.alias("shard")).applyInPandas(run, "key long, n long, p float"))


class Known:
    """Probabilities of the windows sent to the tasks, found by the hashes of their keys."""

    def __init__(self, key: np.ndarray, p: np.ndarray):
        h = key.view(np.uint64) * MULTIPLIER
        order = np.argsort(h)
        self.h, self.p = np.append(h[order], np.uint64(0)), np.append(p[order], np.float32(0))
        self.start = np.searchsorted(self.h[:-1] >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of each key, NaN where it isn't known."""
        h = key * MULTIPLIER
        bucket = (h >> np.uint64(44)).astype(np.int64)
        at, end, out = self.start[bucket], self.start[bucket + 1], np.full(len(key), np.nan, dtype=np.float32)
        todo = np.arange(len(key))
        while len(todo):
            hit = (self.h[at] == h) & (at < end)
            out[todo[hit]] = self.p[at[hit]]
            on = ~hit & (at + 1 < end)
            todo, at, end, h = todo[on], at[on] + 1, end[on], h[on]
        return out


def whole_scores(raw: list[bytes], known: Known, more: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(scores, far, times) of coded texts: log10 probability, and the windows beyond `known` and `more` (sorted keys, p) whose
    log10 probabilities, so many times each, are still to be added. Where that doesn't do (see adapt), the score is NaN."""
    none = np.zeros(0, dtype=np.int64)
    out, far, times, part, owner, held = np.zeros(len(raw)), [none] * len(raw), [none] * len(raw), [], [], 0

    def flush() -> None:
        b, text, place = window_keys(part)
        at = np.flatnonzero(place >= ORDER)
        key, p = codes_at(b)[at - ORDER], np.zeros(len(b))
        p[at] = known.find(key)
        lost = np.flatnonzero(np.isnan(p[at]))
        if more is not None and len(lost):
            k, there = lookup(more[0], key[lost])
            p[at[lost[there]]] = more[1][k[there]]
        q, free, bad = adapt(b, text, place[ORDER:], p[ORDER:])
        twisted = np.zeros(len(part), dtype=bool)
        twisted[text[ORDER:][bad]] = True
        open_ = np.flatnonzero(np.isnan(p[at]) & (twisted[text[at]] | ~free[at - ORDER]))
        for i in np.unique(text[at[open_]]):
            keys, count = np.unique(key[open_[text[at[open_]] == i]], return_counts=True)
            far[owner[i]], times[owner[i]] = keys.view(np.int64), count
        sums = np.bincount(text[at], weights=q[at - ORDER], minlength=len(part))
        out[np.array(owner)] = np.where(twisted, np.nan, sums)

    for i, r in enumerate(raw):
        part.append(r)
        owner.append(i)
        held += len(r)
        if held >= PIECE:
            flush()
            part, owner, held = [], [], 0
    if part:
        flush()
    return out, far, times


def scored(b: pd.DataFrame, model: Known, logs: dict[bytes, float]) -> pd.DataFrame:
    """The rows of b with their scores, the base over the words in logs, and the other words and windows with their counts."""
    found = [tokens_of(t) for t in b["text"]]
    score, far, often = whole_scores([coded(x) for x in found], model)
    out = {"id": b["id"].tolist(), "held_out": ~b["learn"], "n_tokens": [len(x) + 1 for x in found], "n_known": [], "base": [], "score": score, "rare": [], "times": [], "far": far, "often": often}
    out["text"] = [t if bad else None for t, bad in zip(b["text"], np.isnan(score))]
    for x in found:
        each = Counter(x)
        each[b""] = 1
        known, base, rare, times = 0, 0.0, [], []
        for w, n in each.items():
            log = logs.get(w)
            if log is None:
                rare.append(word_of(w))
                times.append(n)
            else:
                known += n
                base += n * log
        out["n_known"].append(known)
        out["base"].append(base)
        out["rare"].append(rare)
        out["times"].append(times)
    return pd.DataFrame(out)


def frequent_windows(probs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, p) of the most frequent windows, `most` at most, packed in the tasks."""
    step = F.when(F.col("n") > 0, F.floor(F.log2("n") * 8)).otherwise(-1)
    sizes = sorted(probs.groupBy(step.alias("s")).count().collect(), reverse=True)
    least = [r["s"] for r, total in zip(sizes, np.cumsum([r["count"] for r in sizes])) if total <= most]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"keys": [b["key"].to_numpy(np.int64).tobytes()], "ps": [b["p"].to_numpy(np.float32).tobytes()]})

    near = probs.where(step >= least[-1]).select("key", "p").mapInPandas(pack, "keys binary, ps binary").collect() if least else []
    return np.frombuffer(b"".join(r["keys"] for r in near), dtype=np.int64), np.frombuffer(b"".join(r["ps"] for r in near), dtype=np.float32)


def twisted_scores(texts: DataFrame, probs: DataFrame, sent) -> DataFrame:
    """(row, again): scores of texts (row, text, far), with the windows beyond those sent beside each."""
    pairs = texts.select("row", F.explode("far").alias("key")).join(probs.select("key", "p"), "key")
    found = pairs.groupBy("row").agg(F.collect_list("key").alias("keys"), F.collect_list("p").alias("ps"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value[0]
        for whole in batches:
            for at in range(0, len(whole), STEP):
                b = whole.iloc[at : at + STEP]
                key, first = np.unique(np.concatenate(b["keys"].tolist()).astype(np.int64).view(np.uint64), return_index=True)
                p = np.concatenate(b["ps"].tolist())[first]
                score, far, _ = whole_scores([coded(tokens_of(t)) for t in b["text"]], model, (key, p))
                if any(len(k) for k in far):
                    raise ValueError("a window without a probability")
                yield pd.DataFrame({"row": b["row"], "again": score})

    return texts.select("row", "text").join(found, "row").mapInPandas(run, "row long, again double")


def score_texts(docs: DataFrame, frequent: int = FREQUENT, id_col: str = "doc_id", sent_windows: int = SENT) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs, learnt from the rows that aren't held out."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), "text", (fold(F.col(id_col), FOLDS) != HELD_OUT).alias("learn"))
    counts = stored(gather_counts(rows))
    words, grams = counts.where("word is not null").select("word", "n"), counts.where("window is not null").select("window", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    below = np.log10(total["n"] + ADD * (total["v"] + 1))
    top = {r["word"]: r["n"] for r in words.orderBy(F.desc("n"), "word").limit(frequent).toLocalIterator()}
    probs = window_scores(grams)
    sent = spark.sparkContext.broadcast((Known(*frequent_windows(probs, sent_windows)), top))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = sent.value
        logs = {w.encode(): float(np.log10(n + ADD) - below) for w, n in known.items()}
        for whole in batches:
            for at in range(0, len(whole), STEP):  # the tokens of few texts at a time
                yield scored(whole.iloc[at : at + STEP], model, logs)

    first = rows.mapInPandas(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<string>, times array<int>, far array<long>, often array<int>, text string")
    first = stored(first.withColumn("row", F.monotonically_increasing_id()))
    rare = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    n = F.coalesce("n", F.lit(0))
    more = (
        rare.join(words, "word", "left")
        .groupBy("row")
        .agg(F.sum(F.col("times") * (F.log10(n + ADD) - F.lit(float(below)))).alias("more"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("found"))
    )
    far = first.where("text is null").select("row", F.explode(F.arrays_zip("far", "often")).alias("k")).select("row", F.col("k.far").alias("key"), F.col("k.often").alias("often"))
    added = far.join(probs.select("key", "p"), "key").groupBy("row").agg(F.sum(F.col("often") * F.col("p").cast("double")).alias("added"))
    again = twisted_scores(first.where("text is not null"), probs, sent)
    out = first.drop("rare", "times", "far", "often", "text").join(more, "row", "left").join(added, "row", "left").join(again, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total["n"])).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        F.coalesce("again", F.col("score") + F.coalesce("added", F.lit(0.0))).alias("score"),
    )
