"""Quality classifier: naive Bayes support vectors.

A text becomes the set of its n-grams: of characters, of token shapes (a word's
case, its closing marks, whether it repeats the word before it) and of tokens.
Indicators are scaled by the log ratio of how often an n-gram stands in either
class; a linear hinge-loss model is fitted to the scaled indicators by dual
coordinate descent, and a logistic function fitted on rows that training left
out turns margins into scores.

N-grams are hashed into ``2 ** bits`` places, so the model has a fixed size. It
is fitted on a bounded sample of labelled rows, at most ``rows_per_class`` of each
label; n-grams are extracted in Spark and the driver holds the sample's sparse
rows only. Scoring is one pass over whole texts, without a shuffle.

Defined results: null and empty texts have no n-grams and get the score of the
bare intercept; rows that repeat an id are scored alike by their own texts; with
no labelled rows of one kind the score is the constant share of good rows; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmergrid.llm.common import held_out, spread, table
from glimmergrid.llm.hashing import MIX, as_bytes, words
from glimmergrid.llm.toxicity import labelled_sample, logistic

BITS = 18
MAX_N = 4
#: Classes of bytes for token shapes: white space, lower, upper, digit, letters beyond ASCII, each other mark for itself.
SHAPES = np.arange(256, dtype=np.uint64)
SHAPES[ord("a") : ord("z") + 1] = 1
SHAPES[ord("A") : ord("Z") + 1] = 2
SHAPES[ord("0") : ord("9") + 1] = 3
SHAPES[128:] = 4
STEP = np.uint64(0x100000001B3)


def places(codes: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """Hashes codes into the ``2 ** bits`` places."""
    x = (codes + np.uint64(salt)) * MIX
    return ((x ^ (x >> np.uint64(29))) * MIX) >> np.uint64(64 - bits)


def ngrams(text: str, bits: int = BITS) -> np.ndarray:
    """The distinct places of a text's n-grams."""
    b = as_bytes(text)
    if not len(b):
        return np.zeros(0, np.int64)
    found = []
    gram = b.astype(np.uint64)
    for n in range(1, MAX_N + 1):
        found.append(places(gram, n, bits))
        if len(gram) < 2 or n == MAX_N:
            break
        gram = (gram[:-1] << np.uint64(8)) | b[n:]
    starts, ends, found_words = words(b)
    if len(starts):
        first, last = SHAPES[b[starts]], SHAPES[b[ends - 1]]
        again = np.concatenate(([False], found_words[1:] == found_words[:-1])).astype(np.uint64)
        second_last = SHAPES[b[np.maximum(starts, ends - 2)]]
        shape = ((again * np.uint64(256) + first) * np.uint64(256) + second_last) * np.uint64(256) + last
        for n in (1, 2, 3):
            if len(shape) < n:
                break
            gram = shape[: len(shape) - n + 1].copy()
            for k in range(1, n):
                gram = gram * STEP + shape[k : len(shape) - n + 1 + k]
            found.append(places(gram, 100 + n, bits))
        found.append(places(found_words, 200, bits))
    every = np.concatenate(found).astype(np.int64)
    # The last writer of a place marks it: distinct values without a sort.
    board = _board(bits)
    order = np.arange(len(every))
    board[every] = order
    return every[board[every] == order]


_kept: dict[str, np.ndarray] = {}


def _board(bits: int) -> np.ndarray:
    return _kept.setdefault(f"board{bits}", np.zeros(1 << bits, np.int64))


@dataclass
class QualityModel:
    #: Log count ratio times hinge-loss weight, by place.
    weights: np.ndarray
    intercept: float
    #: Constant and slope of the logistic function of the margin.
    scale: tuple[float, float]
    bits: int = BITS

    def margin(self, text: str) -> float:
        found = ngrams(text, self.bits)
        return float(self.weights[found].sum() / max(1.0, np.sqrt(len(found))) + self.intercept)

    def score(self, text: str | None) -> float:
        z = self.scale[0] + self.scale[1] * self.margin(text or "")
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    """Per place, the log ratio of its smoothed shares in rows of label 1 and 0."""
    counts = {c: np.full(size, smooth) for c in (0, 1)}
    for row, label in zip(rows, labels):
        counts[int(label)][row] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, size: int, cost: float = 1.0, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear model with hinge loss.

    Each step solves the dual exactly in one row's coefficient, which stays in
    [0, cost]; rows are visited in a new random order each round. The intercept
    is the weight of a constant feature.
    """
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([float(v @ v) for v in values]) + 1.0
    y = np.where(labels > 0, 1.0, -1.0)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            slope = y[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - slope / norms[i], 0.0), cost)
            if (change := new - alpha[i]) != 0.0:
                alpha[i] = new
                w[rows[i]] += change * y[i] * values[i]
                bias += change * y[i]
                most = max(most, abs(change))
        if most < 1e-3:
            break
    return w, bias


def fit_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", hold_out=held_out, rows_per_class: int = 2_000, bits: int = BITS) -> QualityModel:
    """Learns the model from a bounded sample of labelled rows."""
    sample = labelled_sample(docs, labels, label, rows_per_class, id_col, text_col, hold_out)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "order": b["order"], "grams": [ngrams(t or "", bits).astype("<i4").tobytes() for t in b["text"]]})

    got = spread(sample.select("label", F.xxhash64("id", "text").alias("order"), "text")).mapInPandas(extract, "label int, order long, grams binary").toPandas().sort_values("order")
    y = got["label"].to_numpy(int)
    size = 1 << bits
    if len(set(y)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return QualityModel(np.zeros(size), 0.0, (float(np.log(share / (1 - share))), 1.0), bits)
    rows = [np.frombuffer(g, "<i4") for g in got["grams"]]
    fits = np.arange(len(rows)) % 4 > 0 if min(np.bincount(y)) >= 8 else np.ones(len(rows), bool)
    train = np.flatnonzero(fits)
    ratios = log_count_ratios([rows[i] for i in train], y[train], size)
    values = [(ratios[r] / max(1.0, np.sqrt(len(r)))).astype(np.float32) for r in rows]
    w, bias = dual_coordinate_descent([rows[i] for i in train], [values[i] for i in train], y[train], size)
    rest = np.flatnonzero(~fits) if not fits.all() else train
    margins = np.array([w[rows[i]] @ values[i] + bias for i in rest])
    scale = logistic(np.column_stack([np.ones(len(rest)), margins]), y[rest].astype(float), ridge=0.01)
    return QualityModel(w * ratios, bias, (float(scale[0]), float(scale[1])), bits)


def score_quality(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``score`` (0 to 1, higher is better) to ``id_col`` and ``keep``. The model has a fixed size and goes out once per executor."""
    schema = docs.select(id_col, *keep).schema
    names = schema.fieldNames()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[names].assign(score=[sent.value.score(t) for t in b["__text"]])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", score double"
    return spread(docs.select(id_col, *keep, F.col(text_col).alias("__text"))).mapInPandas(scored, out)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents")
    told = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
