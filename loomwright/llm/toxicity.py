"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled

GRAMS = (4, 5, 6)
BITS = 20
#: At most so many labelled rows are learnt from, those with the smallest hash of their id.
SAMPLE = 8000
#: And so many characters: a row that would go beyond them, or is longer than a 20th of them, is not learnt from.
SAMPLE_CHARS = 40_000_000
#: Standard errors by which a log-count ratio must differ from 0 for its n-gram to be a feature.
EVIDENCE = 4.0
#: Characters looked at in one go.
WINDOW = 1 << 15


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """Hash buckets of the n-grams of a whole lower-cased text, window by window."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    most = GRAMS[-1]
    for at in range(0, len(codes), WINDOW):
        part = codes[at : at + WINDOW + most - 1].astype(np.uint64)
        h = np.zeros(len(part), np.uint64)
        for n in range(1, min(most, len(part)) + 1):
            h = h[: len(part) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + part[n - 1 :] + np.uint64(n)
            if n in GRAMS:
                yield ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.uint32)


def distinct(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    return a[np.r_[True, a[1:] != a[:-1]]] if len(a) else a


def features(text: str | None, among: np.ndarray | None = None) -> np.ndarray:
    """The distinct buckets of a text, or those for which the table ``among`` is true."""
    found = [distinct(k if among is None else k[among[k]]) for k in buckets(text)]
    return distinct(np.concatenate(found)) if found else np.zeros(0, np.uint32)


def fit(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0, l2: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, float]:
    """A weight for each bucket, and a bias: logistic regression on log-count ratios of the n-grams
    that are present, of those whose ratio stands out by EVIDENCE standard errors."""
    size = 1 << BITS
    if not len(rows) or y.min() == y.max():
        return np.zeros(size, np.float32), 4.0 if len(rows) and y[0] else -4.0
    p, q = np.full(size, smooth), np.full(size, smooth)
    for r, t in zip(rows, y, strict=True):
        (p if t else q)[r] += 1
    ratio = np.log(p / (y.sum() + 2 * smooth)) - np.log(q / (len(y) - y.sum() + 2 * smooth))
    used = np.abs(ratio) >= EVIDENCE * np.sqrt(1 / p + 1 / q)
    rows = [r[used[r]].astype(np.int64) for r in rows]
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value, weight = ratio[flat], np.where(y > 0, 1.5, 1.0) / len(y)
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam
        z = np.bincount(owner, value * w[flat], minlength=len(rows)) + b
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g, gb = np.bincount(flat, value * err[owner], minlength=size) + l2 * w, err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.02 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= rate * m / (np.sqrt(v) + 1e-8)
        b -= 10 * rate * mb / (np.sqrt(vb) + 1e-8)
    return (w * ratio * used).astype(np.float32), float(b)


def score(text: str | None, weights: np.ndarray, bias: float, used: np.ndarray | None = None) -> float:
    f = features(text, weights != 0 if used is None else used)
    z = float(weights[f].sum(dtype=np.float64)) + bias
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[np.ndarray, float]:
    """Fitted on at most ``sample`` rows of ``docs`` joined to ``labels``, in one task.

    Rows with a null text, id or label are not learnt from. Without rows of both classes the model
    says the same of every text.
    """
    fits = F.col("text").isNotNull() & (F.length("text") <= chars // 20)
    chosen = labelled(docs, labels, label, fits, sample)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, ys, seen = [], [], 0
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                if seen + len(text) <= chars:
                    seen += len(text)
                    rows.append(features(text))
                    ys.append(y)
        w, b = fit(rows, np.array(ys, np.float64))
        kept = np.flatnonzero(w)
        yield pd.DataFrame({"at": [kept.astype("<u4").tobytes()], "w": [w[kept].astype("<f4").tobytes()], "b": [b]})

    model = chosen.coalesce(1).mapInPandas(learn, "at binary, w binary, b double").first()
    if model is None:  # nothing to learn from, not even an empty partition
        return fit([], np.zeros(0))
    weights = np.zeros(1 << BITS, np.float32)
    weights[np.frombuffer(model["at"], "<u4")] = np.frombuffer(model["w"], "<f4")
    return weights, model["b"]


def scorer(docs: DataFrame, model: tuple[np.ndarray, float]) -> callable:
    """A column function that scores whole texts with ``model`` (null or empty: the bias alone)."""
    shared, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = shared.value
        used = weights != 0
        for s in batches:
            yield pd.Series([score(t, weights, bias, used) for t in s], dtype="float64")

    return of


def toxicity(docs: DataFrame, model: tuple[np.ndarray, float], text: str | Column = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the probability that each text is toxic. Repeated rows get one score each."""
    return docs.withColumn(out, scorer(docs, model)(F.col(text) if isinstance(text, str) else text))
