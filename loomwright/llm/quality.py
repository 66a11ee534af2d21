"""Quality: a byte-level convolutional network in numpy.

Windows of eight bytes, four apart, cover the whole document; each byte is embedded, learned filters
run over the windows, and each filter's largest response in every chunk of 1 kB is kept. The largest
and the mean of these over the document's chunks are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled

WIDTH, STRIDE, EMBED, FILTERS = 8, 4, 6, 32
#: Windows in a chunk, and chunks computed at a time.
CHUNK, AT_ONCE = 256, 64
#: At most so many labelled rows, those with the smallest hash of their id, and so many bytes are learnt
#: from; a row that would go beyond them, or is longer than a 20th of them, is not.
SAMPLE, SAMPLE_BYTES = 3000, 12_000_000
EPOCHS, BATCH, SEED = 8, 32, 42


class Net:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.5, (256, EMBED)), "w": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)),
            "c": np.zeros(FILTERS), "u": r.normal(0, 0.1, 2 * FILTERS), "b": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def windows(self, part: np.ndarray) -> np.ndarray:
        e = self.p["e"][part]
        n = (len(part) - WIDTH) // STRIDE + 1
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (n, WIDTH, EMBED), (STRIDE * s[0], *s), writeable=False).reshape(n, -1)

    def pooled(self, data: bytes, where: bool = False):
        """The largest response of each filter in each chunk; with ``where``, also at which window."""
        size = max(WIDTH, WIDTH + -(-max(0, len(data) - WIDTH) // STRIDE) * STRIDE)
        codes = np.frombuffer(data + bytes(size - len(data)), np.uint8)
        n = (size - WIDTH) // STRIDE + 1
        most, at = [], []
        for i in range(0, n, CHUNK * AT_ONCE):
            m = min(n - i, CHUNK * AT_ONCE)
            h = self.windows(codes[i * STRIDE : (i + m - 1) * STRIDE + WIDTH]) @ self.p["w"]
            starts = np.arange(0, m, CHUNK)
            if where:
                pad = -m % CHUNK
                full = np.pad(h, ((0, pad), (0, 0)), constant_values=-np.inf).reshape(-1, CHUNK, FILTERS)
                best = full.argmax(axis=1)
                at.append(best + i + starts[:, None])
                most.append(full.max(axis=1))
            else:
                most.append(np.maximum.reduceat(h, starts, axis=0))
        r = np.maximum(np.concatenate(most) + self.p["c"], 0)
        return (r, np.concatenate(at), codes) if where else r

    def score(self, data: bytes) -> float:
        r = self.pooled(data)
        z = float(np.r_[r.max(axis=0), r.mean(axis=0)].astype(np.float64) @ self.p["u"]) + float(self.p["b"][0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def gradient(self, data: bytes, y: float, weight: float, g: dict[str, np.ndarray]) -> None:
        r, at, codes = self.pooled(data, where=True)
        top = r.argmax(axis=0)
        f = np.r_[r.max(axis=0), r.mean(axis=0)]
        z = np.clip(f @ self.p["u"] + self.p["b"][0], -30, 30)
        d = weight * (1 / (1 + np.exp(-z)) - y)
        g["u"] += d * f
        g["b"] += d
        dr = np.repeat((d * self.p["u"][FILTERS:] / len(r))[None], len(r), axis=0)
        dr[top, np.arange(FILTERS)] += d * self.p["u"][:FILTERS]
        dr *= r > 0
        g["c"] += dr.sum(axis=0)
        ci, fi = np.nonzero(dr)
        if not len(ci):
            return
        d1 = dr[ci, fi].astype(np.float32)
        spots = codes[(at[ci, fi] * STRIDE)[:, None] + np.arange(WIDTH)]
        x = self.p["e"][spots].reshape(len(ci), -1) * d1[:, None]
        np.add.at(g["w"].T, fi, x)
        np.add.at(g["e"], spots.ravel(), (self.p["w"].T[fi] * d1[:, None]).reshape(-1, EMBED))

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS) -> Net:
        if not len(texts) or y.min() == y.max():
            self.p["u"][:] = 0
            self.p["b"][:] = -4.0 if len(texts) and not y[0] else 4.0
            return self
        share = y.mean()
        self.p["b"][:] = np.log(share / (1 - share))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        order, t = np.random.default_rng(SEED), 0
        for epoch in range(epochs):
            for batch in np.array_split(order.permutation(len(texts)), max(1, len(texts) // BATCH)):
                g = {k: np.zeros_like(x) for k, x in self.p.items()}
                for i in batch:
                    self.gradient(texts[i], y[i], 1 / len(batch), g)
                t += 1
                rate = 0.01 * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for k, x in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    x -= (rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> Net:
    """Fitted on at most ``sample`` rows of ``docs`` joined to ``labels``, in one task. Rows with a
    null text, id or label are not learnt from; without rows of both classes every score is the same."""
    fits = F.col("text").isNotNull() & (F.octet_length("text") <= most // 20)
    chosen = labelled(docs, labels, label, fits, sample)
    shapes = {k: (v.shape, v.size) for k, v in Net().p.items()}

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, ys, seen = [], [], 0
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if seen + len(data) <= most:
                    seen += len(data)
                    texts.append(data)
                    ys.append(y)
        net = Net().fit(texts, np.array(ys, np.float64))
        yield pd.DataFrame({"p": [np.concatenate([net.p[k].ravel() for k in shapes]).astype("<f4").tobytes()]})

    row = chosen.coalesce(1).mapInPandas(learn, "p binary").first()
    if row is None:  # nothing to learn from, not even an empty partition
        return Net().fit([], np.zeros(0))
    flat, net, at = np.frombuffer(row["p"], "<f4"), Net(), 0
    for k, (shape, size) in shapes.items():
        net.p[k] = flat[at : at + size].reshape(shape).copy()
        at += size
    return net


def quality(docs: DataFrame, net: Net, text: str | Column = "text", out: str = "quality") -> DataFrame:
    """``docs`` with the probability that each whole text is good (null: like an empty one).
    Repeated rows get one score each."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([net.score((t or "").encode("utf-8", "surrogatepass")) for t in s], dtype="float64")

    return docs.withColumn(out, of(F.col(text) if isinstance(text, str) else text))
