"""Language ID by string kernels.

The blended-spectrum presence kernel of two texts counts the byte n-grams (2 to 4, of lower-cased letters with runs of
anything else as one space) that both hold, divided by the geometric mean of the numbers each holds. Some texts of
each language are Nystroem landmarks; one-versus-rest kernel ridge regression is fitted in their feature map on a
bounded sample of labelled rows (`LANDMARKS` and `TRAIN` rows of each language). The presence rows of a batch of texts
are scored by one matrix product with the landmarks' rows, which are multiplied with the regression's coefficients
once, before.

n-grams of 3 and 4 bytes are hashed to 17 bits. Whole texts are read, in overlapping pieces of 1 MB. With many languages
each gets its part of MOST_LANDMARKS and MOST_TRAIN rows, so what the driver holds doesn't grow with their number.

Defined results: a text that is null, empty or without a letter is `und` with score 0; with no labelled rows all are
`und`; equal scores go to the language that sorts first; repeated rows are judged alike; other columns are ignored.
`keep_known` drops texts without a letter, and those that the kernels can't place: the landmarks hold less than SHARED of
their n-grams, or the best language's score is below PLACED times that of chance; with no labelled rows it keeps all texts
that have a letter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from vexel.llm.common import bounded_sample, fold, rows_where

LANDMARKS, TRAIN = 48, 400
MOST_LANDMARKS, MOST_TRAIN = 1024, 20_000
SHARED, PLACED = 0.2, 1.1
RIDGE = 1e-3
#: Steepness of the softmax that turns regression outputs (-1 to 1) into scores.
STEEPNESS = 4.0
FOLDS, HELD_OUT = 3, 1
BITS = 17
SPACE = 1 << 16, (1 << 16) + (1 << BITS), (1 << 16) + (2 << BITS)
WIDTH = SPACE[2]
PIECE = 1 << 20
BATCH = 64
#: ASCII letters stay, other ASCII becomes a space.
LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def presence(text: str, flags: np.ndarray) -> None:
    """Sets the flags of the text's n-grams."""
    words = text.lower().encode("utf-8", "replace").translate(LETTERS).split()
    raw = b" " + b" ".join(words) + b" " if words else b""
    for at in range(0, len(raw), PIECE):
        b = np.frombuffer(raw[at : at + PIECE + 3], dtype=np.uint8).astype(np.uint32)
        if len(b) < 2:
            continue
        two = (b[:-1] << np.uint32(8)) | b[1:]
        flags[two] = True
        three = (two[:-1] << np.uint32(8)) | b[2:]
        flags[SPACE[0] + ((three * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))] = True
        four = (three[:-1] << np.uint32(8)) | b[3:]
        flags[SPACE[1] + ((four * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS))] = True


def ngrams(text: str) -> np.ndarray:
    flags = np.zeros(WIDTH, dtype=bool)
    presence(text, flags)
    return np.flatnonzero(flags).astype(np.int32)


@dataclass
class Model:
    languages: list[str]
    columns: np.ndarray  # the n-grams that landmarks hold
    weights: np.ndarray  # (columns, languages): landmark rows times coefficients
    bias: np.ndarray  # (languages)

    def outputs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Regression outputs of each text, and the part of its n-grams that landmarks hold."""
        rows, norms = np.empty((len(texts), len(self.columns)), dtype=np.float32), np.empty((len(texts), 1))
        flags = np.zeros(WIDTH, dtype=bool)
        for i, t in enumerate(texts):
            flags[:] = False
            presence(t, flags)
            rows[i], norms[i] = flags[self.columns], max(1, np.count_nonzero(flags))
        return (rows @ self.weights) / np.sqrt(norms) + self.bias, rows.sum(axis=1) / norms[:, 0]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        out, shared = self.outputs(texts)
        out = out * STEEPNESS
        odds = np.exp(out - out.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        best = odds.argmax(axis=1)
        return [self.languages[i] for i in best], odds[np.arange(len(best)), best], shared


def kernel(grams: list[np.ndarray], place: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Kernel of n-gram lists with the landmarks: rows (columns, landmarks as packed bits), place: the column of an n-gram, or the last, empty one."""
    out = np.empty((len(grams), len(sizes)))
    for i, x in enumerate(grams):
        out[i] = np.unpackbits(rows[place[x]], axis=1, count=len(sizes)).sum(axis=0, dtype=np.int64)
    return out / np.sqrt(np.array([max(1, len(x)) for x in grams], dtype=np.float64)[:, None] * sizes[None, :])


def fit(grams: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    languages, seen, chosen = sorted(set(labels)), Counter(), []
    landmarks = max(1, min(landmarks, MOST_LANDMARKS // len(languages)))
    for i, k in enumerate(labels):
        seen[k] += 1
        if seen[k] <= landmarks:
            chosen.append(i)
    columns = np.unique(np.concatenate([grams[i] for i in chosen]))
    place = np.full(WIDTH, len(columns), dtype=np.int32)
    place[columns] = np.arange(len(columns))
    rows = np.zeros((len(columns) + 1, -(-len(chosen) // 8)), dtype=np.uint8)
    for j, i in enumerate(chosen):
        rows[place[grams[i]], j // 8] |= np.uint8(128 >> j % 8)
    sizes = np.array([max(1, len(grams[i])) for i in chosen], dtype=np.float64)
    values, vectors = np.linalg.eigh(kernel([grams[i] for i in chosen], place, rows, sizes))
    good = values > 1e-8 * values.max()
    half = vectors[:, good] / np.sqrt(values[good])  # Nystroem map: kernel row times half
    phi = kernel(grams, place, rows, sizes) @ half
    goal = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    share = np.array([1.0 / seen[k] for k in labels])[:, None]  # each language weighs the same
    share /= share.sum()
    phi1 = np.hstack([phi, np.ones((len(phi), 1))])
    solved = np.linalg.solve(phi1.T @ (phi1 * share) + ridge * np.diag([1.0] * phi.shape[1] + [0.0]) / len(languages), phi1.T @ (goal * share))
    part = (half @ solved[:-1]) / np.sqrt(sizes)[:, None]
    weights = np.concatenate([np.unpackbits(rows[at : at + 4096], axis=1, count=len(chosen)).astype(np.float64) @ part for at in range(0, len(columns), 4096)])[: len(columns)]
    return Model(languages, columns, weights.astype(np.float32), solved[-1].astype(np.float32))


def train(docs: DataFrame, per_label: int = TRAIN, landmarks: int = LANDMARKS) -> Model | None:
    """Fits on a bounded sample of the rows of docs with a language; only their n-gram numbers come to the driver."""
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[[has_letter(t) for t in b["text"]]]
            yield pd.DataFrame({"place": b["place"], "lang": b["lang"], "grams": [ngrams(t) for t in b["text"]]})

    languages = max(1, labelled.agg(F.countDistinct("lang")).first()[0])
    per_label = max(1, min(per_label, MOST_TRAIN // languages))
    rows = bounded_sample(labelled, "lang", per_label, "doc_id", "text").select(F.xxhash64(F.lit(7), "doc_id", "text").alias("place"), "lang", "text")
    got = rows.mapInPandas(run, "place long, lang string, grams array<int>").toPandas().sort_values(["place", "lang"], kind="stable")
    return fit([np.asarray(g) for g in got["grams"]], got["lang"].tolist(), landmarks) if len(got) else None


def judge(texts: list[str | None], model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language and score of each text, and the part of its n-grams that landmarks hold."""
    lang, score, shared = np.full(len(texts), "und", dtype=object), np.zeros(len(texts)), np.zeros(len(texts))
    able = np.flatnonzero([has_letter(t) for t in texts]) if model else np.array([], dtype=int)
    for at in range(0, len(able), BATCH):
        i = able[at : at + BATCH]
        lang[i], score[i], shared[i] = model.predict([texts[j] for j in i])
    return lang, score, shared


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row, learnt from the rows that aren't held out."""
    sent = docs.sparkSession.sparkContext.broadcast(train(training_rows(docs)))  # at most WIDTH rows of one weight for each language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lang, score, _ = judge(b["text"].tolist(), sent.value)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": lang, "score": score})

    rows = docs.select("doc_id", "text", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, placed: float = PLACED) -> DataFrame:
    """The rows of docs that have a language: a letter, and a score of at least `placed` times chance where there are two languages or more."""
    model = train(training_rows(docs))
    if model is None:
        return rows_where(docs, "text", lambda texts: [has_letter(t) for t in texts])
    sent, least = docs.sparkSession.sparkContext.broadcast(model), placed / len(model.languages) if len(model.languages) > 1 else 0.0

    def known(texts: list) -> list[bool]:
        lang, score, shared = judge(texts, sent.value)
        return [x != "und" and y >= least and z >= SHARED for x, y, z in zip(lang, score, shared)]

    return rows_where(docs, "text", known)
