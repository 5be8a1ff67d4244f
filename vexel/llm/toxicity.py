"""Toxicity by weak supervision.

Voters are lexicon entries (whole words) and patterns (word beginnings of 3 to 6 letters): the ones that, in a bounded
sample of labelled rows, mark toxic texts and hardly any other, chosen greedily until each toxic text of the sample
has several voters. A generative label model estimates, by expectation-maximisation over the sample's votes, each
voter's accuracy and its correlation given the label with the voter that it goes along with most, and so turns votes into a
posterior. A linear classifier over the presence of words and word beginnings is trained on
those posteriors and scores whole texts.

The sample (`TOXIC` and `CLEAN` rows) is a documented bound; everything else reads all rows. Texts with equal words
count once in it, so a large group of copies makes no voter.

Defined results: a text that is null or has no words gets the classifier's score for no features; a row without a
label isn't learnt from; if the labels hold only one value, or there are none, all scores are 0; labels of repeated
ids: toxic if any says so; repeated documents are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from vexel.llm.common import bounded_sample, cut, fold, rows_where, word_list

TOXIC, CLEAN = 4000, 8000
PREFIXES = (3, 4, 5, 6)
#: Words and beginnings are numbered by a 31-bit hash.
MASK = (1 << 31) - 1
#: A voter is in this many toxic texts of the sample at least, with this precision at least, and in one clean text and this
#: share of its toxic ones at most.
LEAST_SUPPORT, LEAST_PRECISION, STRAY = 5, 0.9, 0.015
VOTES_EACH, MOST_VOTERS = 4, 400
#: Rates at which a voter votes in clean texts at most, alone and where its parent does.
MOST_STRAY, BESIDE = 0.002, 0.1
#: Counts by which a voter's rate beside its parent leans to its own rate.
SHRINK = 5.0
#: Features of the classifier, and of the sample among which voters are chosen.
FEATURES, ABLE = 1024, 16_384
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
REMEMBERED = 500_000


def features_of(word: str) -> list[int]:
    """Numbers of a word and its beginnings."""
    return [xxhash.xxh32_intdigest("=" + word) & MASK, *(xxhash.xxh32_intdigest(word[:k]) & MASK for k in PREFIXES if len(word) > k)]


def text_features(text: str | None) -> np.ndarray:
    return np.unique(np.array([f for w in set(word_list(text)) for f in features_of(w)], dtype=np.int32))


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    def scores(self, texts) -> list[float]:
        known: dict[str, tuple[int, ...]] = {}
        out, weights = [], self.weights
        for t in texts:
            if len(known) > REMEMBERED:
                known.clear()
            held: set[int] = set()
            for w in set(word_list(t)):
                got = known.get(w)
                if got is None:
                    got = known[w] = tuple(f for f in features_of(w) if f in weights)
                if got:
                    held.update(got)
            out.append(1 / (1 + np.exp(-np.clip(self.bias + sum(weights[f] for f in sorted(held)), -60, 60))))
        return out


def choose_voters(rows: list[np.ndarray], toxic: np.ndarray, width: int) -> np.ndarray:
    """Columns of the voters, most useful first; rows hold the columns (below width) of each text."""
    pos = np.bincount(np.concatenate([r for r, y in zip(rows, toxic) if y]), minlength=width)
    neg = np.bincount(np.concatenate([r for r, y in zip(rows, toxic) if not y] or [np.zeros(0, np.int32)]), minlength=width)
    able = (pos >= LEAST_SUPPORT) & (pos >= LEAST_PRECISION * (pos + neg)) & (neg <= 1 + STRAY * pos)
    held = [r[able[r]] for r, y in zip(rows, toxic) if y]
    flat, owner = np.concatenate(held), np.repeat(np.arange(len(held)), [len(r) for r in held])
    need, chosen, used = np.full(len(held), VOTES_EACH), [], np.zeros(width, dtype=bool)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    while len(chosen) < MOST_VOTERS and len(flat):
        live = (need[owner] > 0) & ~used[flat]
        if not live.any():
            break
        f = int(np.bincount(flat[live]).argmax())
        chosen.append(f)
        used[f] = True
        lo, hi = np.searchsorted(flat, [f, f + 1])
        need[owner[lo:hi]] -= 1
    return np.array(chosen, dtype=np.int64)


def dependence(both: np.ndarray, n: float) -> np.ndarray:
    """n times the mutual information of each two voters, from how often both vote (the diagonal: each alone) in n texts."""
    one = np.diag(both)
    i, j = one[:, None], one[None, :]
    out = np.zeros_like(both)
    for seen, a, b in ((both, i, j), (i - both, i, n - j), (j - both, n - i, j), (n - i - j + both, n - i, n - j)):
        seen = np.maximum(seen, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(seen > 1e-12, seen * np.log(seen * n / np.maximum(a * b, 1e-300)), 0)
    return out


def spanning_tree(weight: np.ndarray) -> np.ndarray:
    """Parents (-1: none) in the maximum spanning tree of a full graph; the first node is the root."""
    parent, near, best = np.full(len(weight), -1), np.zeros(len(weight), dtype=np.int64), weight[0].copy() if len(weight) else np.zeros(0)
    out = np.zeros(len(weight), dtype=bool)
    for _ in range(1, len(weight)):
        out[0] = True
        j = int(np.where(out, -np.inf, best).argmax())
        parent[j], out[j] = near[j], True
        closer = weight[j] > best
        near[closer], best[closer] = j, weight[j][closer]
    return parent


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 3, stray: float = MOST_STRAY, beside: float = BESIDE) -> np.ndarray:
    """Posterior of `toxic` for each row of votes (rows, voters; 0 or 1); start: a first posterior, such as noisy labels.

    The generative model draws the label, then the votes along a tree: each voter votes with a probability that depends on
    the label (its accuracy) and on the vote of its parent (their correlation given the label). Expectation-maximisation
    starts at `start`, which isn't looked at again; each round estimates the tree by mutual information given the label, and its tables from
    soft counts, which lean to the voter's own rate by SHRINK counts. In clean texts a voter votes at a rate of `stray` at most,
    or `beside` where its parent does, as it was chosen for that; else a group of toxic texts of its own kind could pass for clean.
    """
    post = start.astype(np.float64)
    for _ in range(rounds):
        share = {1: post, 0: 1 - post}
        both = {y: votes.T @ (votes * w[:, None]) for y, w in share.items()}
        parent = spanning_tree(sum(dependence(both[y], max(w.sum(), 1e-9)) for y, w in share.items()))
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        logit = np.full(len(votes), np.log(prior / (1 - prior)))
        above = np.where(parent[None, :] >= 0, votes[:, parent], 0)
        for y, w in share.items():
            n, alone = w.sum(), np.diag(both[y])
            rate = (alone + 0.5) / (n + 1)
            joint, up = both[y][np.arange(len(parent)), parent], alone[parent]
            voted = np.where(parent >= 0, (joint + SHRINK * rate) / (up + SHRINK), rate)
            silent = np.where(parent >= 0, (alone - joint + SHRINK * rate) / (n - up + SHRINK), rate)
            if not y:
                voted, silent = np.minimum(voted, np.where(parent >= 0, beside, stray)), np.minimum(silent, stray)
            p = np.clip(np.where(above > 0, voted, silent), 1e-6, 1 - 1e-6)
            logit += (1 if y else -1) * np.where(votes > 0, np.log(p), np.log1p(-p)).sum(axis=1)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post


def fit_linear(rows: list[np.ndarray], post: np.ndarray, voters: np.ndarray, names: np.ndarray, steps: int = 600) -> Model:
    """Logistic regression by gradient descent on the features that tell the posteriors apart best, voters included."""
    width = len(names)
    weight = np.repeat(post, [len(r) for r in rows])
    flat = np.concatenate(rows)
    pos, both = np.bincount(flat, weights=weight, minlength=width), np.bincount(flat, minlength=width)
    p, n = max(post.sum(), 1e-9), max(len(post) - post.sum(), 1e-9)
    gap = np.abs(pos / p - (both - pos) / n) * (both >= LEAST_SUPPORT)
    gap[voters] = np.inf
    most = min(FEATURES, len(voters) + int(p))  # no more other features than toxic texts
    kept = np.sort(np.argsort(-gap, kind="stable")[:most])
    column = np.full(width, -1)
    column[kept] = np.arange(len(kept))
    at = column[flat]
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[at >= 0]
    at = at[at >= 0]
    share = np.where(post > 0.5, 0.5 / max(1, (post > 0.5).sum()), 0.5 / max(1, (post <= 0.5).sum()))  # classes weigh the same
    w, bias, m, v, mb, vb = np.zeros(len(kept)), 0.0, np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0
    for step in range(1, steps + 1):
        z = bias + np.bincount(owner, weights=w[at], minlength=len(rows))
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - post) * share
        gw, gb = np.bincount(at, weights=g[owner], minlength=len(kept)) + 1e-6 * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        a, b = 1 - 0.9**step, 1 - 0.99**step
        w = w - 0.05 * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= 0.05 * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return Model({int(names[k]): float(x) for k, x in zip(kept, w) if abs(x) > 1e-6}, float(bias))


def fit(rows: list[np.ndarray], toxic: np.ndarray) -> Model | None:
    if not (0 < toxic.sum() < len(toxic)):
        return None
    names, flat = np.unique(np.concatenate(rows), return_inverse=True)
    rows = np.split(flat, np.cumsum([len(r) for r in rows])[:-1])
    voters = choose_voters(rows, toxic, len(names))
    place = np.full(len(names), -1)
    place[voters] = np.arange(len(voters))
    votes = np.zeros((len(rows), len(voters)))
    for i, r in enumerate(rows):
        j = place[r]
        votes[i, j[j >= 0]] = 1
    return fit_linear(rows, label_model(votes, np.where(toxic, 0.9, 0.05)), voters, names)


def highest(counts: DataFrame, most: int) -> DataFrame:
    """(f) of the up to `most` features with the largest gaps, whole steps of a 4096th; where the first step holds more, by number."""
    step = F.floor(F.col("gap") * 4096)
    sizes = sorted(counts.groupBy(step.alias("s")).count().collect(), reverse=True)
    least = [r["s"] for r, total in zip(sizes, np.cumsum([r["count"] for r in sizes])) if total <= most]
    return (counts.where(step >= least[-1]) if least else counts.orderBy(F.desc("gap"), "f").limit(most)).select("f")


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits on a bounded sample of the labelled rows of docs; only the numbers of its useful features come to the driver."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded_sample(known.where("toxic = 1"), "toxic", TOXIC, "doc_id").unionByName(bounded_sample(known.where("toxic = 0"), "toxic", CLEAN, "doc_id"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about TOXIC + CLEAN ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "features": [text_features(t) for t in b["text"]]})

    sample = cut(rows.select("toxic", "text").mapInPandas(run, "toxic int, features array<int>").distinct())
    of = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if len(of) < 2:
        return None
    counts = sample.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("both")).where(F.col("both") >= LEAST_SUPPORT)
    able = (F.col("pos") >= LEAST_SUPPORT) & (F.col("pos") >= LEAST_PRECISION * F.col("both")) & (F.col("both") - F.col("pos") <= 1 + STRAY * F.col("pos"))
    gap = F.abs(F.col("pos") / of[1] - (F.col("both") - F.col("pos")) / of[0])
    counts = cut(counts.select("f", gap.alias("gap"), able.alias("able")))
    useful = highest(counts.where("able"), ABLE).unionByName(highest(counts, FEATURES)).distinct()
    kept = docs.sparkSession.sparkContext.broadcast(np.sort(useful.toPandas()["f"].to_numpy(np.int32)))  # features of the sample only

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "features": [np.intersect1d(np.asarray(f, dtype=np.int32), kept.value) for f in b["features"]]})

    got = sample.mapInPandas(narrow, "toxic int, features array<int>").toPandas()
    ordered = sorted((int(y), np.asarray(f, dtype=np.int32).tobytes()) for y, f in zip(got["toxic"], got["features"]))
    return fit([np.frombuffer(f, dtype=np.int32) for _, f in ordered], np.array([y == 1 for y, _ in ordered], dtype=bool))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row, learnt from the labelled rows that aren't held out."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # FEATURES weights at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            score = np.array(sent.value.scores(b["text"].tolist()) if sent.value else np.zeros(len(b)), dtype=float)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)})

    rows = docs.select("doc_id", "text", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with a score below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def clean(texts: list) -> list[bool]:
        return [x < threshold for x in sent.value.scores(texts)] if sent.value else [True] * len(texts)

    return rows_where(docs, "text", clean)
