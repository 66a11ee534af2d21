"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Vectors are put into coarse cells around centroids of a sample. What a vector o differs by from its
centroid, r = o - c, is turned by one random orthogonal matrix and kept as the signs of its
coordinates, packed eight to a byte, its norm, and the inner product of the turned unit vector with
its code. From these alone <o, q> is estimated as <c, q> + |r| <code, q'> / <code, r'>, with an error of
at most

    |r| |q| epsilon sqrt((1 - <code, r'>^2) / <code, r'>^2 / (d - 1))

except with a probability that falls with exp(-epsilon^2 / 2). The vectors that seem nearest are
compared exactly, then all whose upper bound reaches the k-th largest of these products. A query
first looks into the cells with the nearest centroids; then, in rounds of ever more cells, into those
in which the farthest-reaching vectors may lie, until no cell is left with one that may reach its k-th
product so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

SEED = 42
#: Standard deviations of the estimate that its bounds allow for.
EPSILON = 3.0
#: Rows of a cell in the mean, and the most cells. The centroids are fitted on about SAMPLE rows; all rows are indexed.
CELL_ROWS, CELLS, SAMPLE = 8192, 4096, 32_768
#: Cells that each query looks into first, and how many times as many it has looked into after each further round.
FIRST, GROWTH = 2, 4
#: A vector's product with a query is at most that of its centroid and SPREAD / sqrt(d) times both norms more
#: (and never over the norms themselves): standard deviations of the angle between unlike vectors.
SPREAD = 5.0
#: Queries that meet a part of a cell in one task.
CELL_QUERIES = 4096
#: Pairs estimated at a time.
AT_ONCE = 1 << 21
#: This many times k vectors that seem nearest are compared exactly to bound the k-th nearest.
WIDE = 16
#: Pairs compared exactly at a time, and how far two ways to sum a product may lie apart, as a share of the norms.
PAIRS, ROUNDING = 1 << 15, 1e-6


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, norms and corrections <code, r'> of the rows of ``r``; 1 for a row that is zero."""
    norm = np.linalg.norm(r, axis=1)
    turned = (r / np.where(norm > 0, norm, 1)[:, None]) @ rotation(r.shape[1])
    return np.packbits(turned > 0, axis=1), norm, np.where(norm > 0, np.abs(turned).sum(axis=1) / np.sqrt(r.shape[1]), 1.0)


def estimate(codes: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """<code, q'> for each of the ``turned`` queries and each of the packed codes: for every byte of a code
    the sums of its 256 values are looked up, so that codes stay packed."""
    n, d = turned.shape
    wide = 8 * codes.shape[1]
    padded = np.zeros((n, wide), np.float32)
    padded[:, :d] = turned / np.float32(np.sqrt(d))
    signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1
    out = np.zeros((n, len(codes)), np.float32)
    for j in range(codes.shape[1]):
        out += np.take(padded[:, 8 * j : 8 * j + 8] @ signs.T, codes[:, j], axis=1)
    return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first component on, in double precision."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def search_cell(ids, codes, norms, corr, vecs, centroid, qids, queries, least, k: int, epsilon: float = EPSILON):
    """The k best candidates of a part of a cell for each query, of those that reach the query's ``least``
    product: arrays (query id, id, score)."""
    d = vecs.shape[1]
    turned = (queries @ rotation(d)).astype(np.float32)
    gain = (norms / corr).astype(np.float32)
    spread = (norms * epsilon * np.sqrt(np.maximum(0, 1 - corr**2) / corr**2 / max(1, d - 1))).astype(np.float32)
    qnorm = np.linalg.norm(queries, axis=1).astype(np.float32)
    base = (queries @ centroid).astype(np.float32)
    longest = np.linalg.norm(vecs, axis=1).max(initial=0)
    out = []
    step = max(1, AT_ONCE // max(1, len(ids)))
    for at in range(0, len(qids), step):
        asked, own = queries[at : at + step], qids[at : at + step, None] == ids
        seems = estimate(codes, turned[at : at + step]) * gain + base[at : at + step, None]
        seems[own] = -np.inf
        floor = least[at : at + step].copy()
        wide = WIDE * k
        if len(ids) > wide:  # the k-th largest exact product of those that seem nearest: the k-th nearest is no farther
            seem = np.argpartition(seems, len(ids) - wide, axis=1)[:, len(ids) - wide :]
            score = np.stack([vecs[s] @ v for s, v in zip(seem, asked, strict=True)])
            score[np.take_along_axis(own, seem, axis=1)] = -np.inf
            floor = np.maximum(floor, np.partition(score, wide - k, axis=1)[:, wide - k])
        near = floor - ROUNDING * qnorm[at : at + step] * longest
        seems += qnorm[at : at + step, None] * spread
        qi, ci = np.nonzero(seems >= near[:, None].astype(np.float32))
        kept = np.concatenate([
            np.einsum("ij,ij->i", asked[qi[i : i + PAIRS]], vecs[ci[i : i + PAIRS]]) >= near[qi[i : i + PAIRS]] for i in range(0, len(qi), PAIRS)
        ] or [np.zeros(0, bool)]) & ~own[qi, ci]
        qi, ci = qi[kept], ci[kept]
        score = exact(asked[qi], vecs[ci])
        order = np.lexsort((ids[ci], -score, qi))
        qi, ci, score = qi[order], ci[order], score[order]
        best = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
        out.append((qids[at + qi[best]], ids[ci[best]], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (qids[:0], ids[:0], np.zeros(0))


def usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int, asked: F.Column) -> DataFrame:
    """(id, asked, vec) of the rows whose vector has ``dim`` finite components, not all 0."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(asked, F.lit(False)).alias("asked"), F.col(vec_col).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & (F.size("vec") == dim) & finite & F.exists("vec", lambda x: x != 0))


def centroids(rows: DataFrame, n: int) -> np.ndarray:
    """Centroids of ``n`` / CELL_ROWS cells, CELLS at most, by k-means in one task over about SAMPLE of the
    rows (id, vec): those whose id's hash lies below a bound, an id once."""
    count = int(min(CELLS, -(-n // CELL_ROWS)))
    bound = min(1.0, SAMPLE / max(1, n)) * 2.0**30
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < bound).groupBy("id").agg(F.min("vec").alias("vec"))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        if not held:
            return
        v = np.stack(pd.concat(held).sort_values("id")["vec"].to_numpy()).astype(np.float64)
        c = v[np.random.default_rng(SEED).permutation(len(v))[:count]]
        for _ in range(8 if len(c) > 1 else 1):
            near = closest(v, c)
            n_in = np.bincount(near, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, near, v)
            c = np.where(n_in[:, None] > 0, sums / np.maximum(n_in, 1)[:, None], c)
        yield pd.DataFrame({"c": list(c)})

    found = sample.coalesce(1).mapInPandas(of, "c array<double>").collect()  # CELLS vectors at most
    return np.array([r["c"] for r in found], np.float64)


def closest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The place of the nearest of ``c`` to each row of ``v``."""
    step = max(1, AT_ONCE // max(1, len(c)))
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(v[i : i + step] @ c.T - half, axis=1) for i in range(0, len(v), step)])


def index(rows: DataFrame, cells: np.ndarray) -> DataFrame:
    """(id, asked, vec, cell, code, norm, corr) of every row, by its nearest centroid."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)  # CELLS vectors at most

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            cell = closest(v, c)
            codes, norms, corr = encode(v - c[cell])
            yield pdf.assign(cell=cell, code=[x.tobytes() for x in codes], norm=norms, corr=corr)

    kind = dict(rows.dtypes)["vec"]
    return rows.mapInPandas(of, f"id long, asked boolean, vec {kind}, cell int, code binary, norm double, corr double")


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row for which ``is_query`` holds, the k others
    with the largest inner products, ties to the smaller id; all others if there are fewer.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components
    take no part. Of rows that repeat an id each takes part, but never as a neighbour of its id; the
    least of their vectors asks. Other columns are not read. Cells with many rows or many queries are
    dealt into parts by a hash of the id, each part of rows met by each part of queries once; only k
    rows a query leave a part. Between rounds only k rows a query and the numbers of its next cells are kept.
    """
    sizes = vectors.filter(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    if sizes is None or sizes["d"] < 1:
        return spark.createDataFrame([], schema)
    d = sizes["d"]
    rows = usable(vectors, id_col, vec_col, d, is_query)
    cells = centroids(rows, rows.count())
    if not len(cells):  # no usable row
        return spark.createDataFrame([], schema)
    coded = checkpointed(index(rows, cells))
    asked = checkpointed(coded.filter("asked").groupBy(F.col("id").alias("query_id")).agg(F.min("vec").alias("query")))
    held = {r["cell"]: (r["n"], r["far"]) for r in coded.groupBy("cell").agg(F.count("*").alias("n"), F.max("norm").alias("far")).collect()}  # CELLS rows at most
    number = np.array([held.get(i, (0, 0.0))[0] for i in range(len(cells))])
    far = np.array([held.get(i, (0, 0.0))[1] for i in range(len(cells))])
    shared = spark.sparkContext.broadcast((cells, number, far * min(1.0, SPREAD / d**0.5)))
    parts = F.lit(np.maximum(1, -(-number // CELL_ROWS)).tolist())
    dealt = lambda c, count: F.pmod(F.xxhash64(c), count).cast("int")
    part_of = F.element_at(parts, F.col("cell") + 1)

    def wanted(start: int, end: int):
        """The cells in places ``start`` to ``end`` of each query's order that may hold one of its nearest; no row where there is none."""

        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c, n, reach = shared.value
            step = max(1, AT_ONCE // len(c))
            for pdf in batches:
                for at in range(0, len(pdf), step):
                    some = pdf.iloc[at : at + step]
                    q = np.stack(some["query"].to_numpy()).astype(np.float64)
                    near = np.where(n > 0, q @ c.T, -np.inf)
                    bound = near + np.linalg.norm(q, axis=1)[:, None] * reach
                    np.put_along_axis(bound, np.argsort(-near, axis=1, kind="stable")[:, :FIRST], np.inf, axis=1)
                    turn = np.argsort(-bound, axis=1, kind="stable")[:, start:end]
                    hit = (np.take_along_axis(bound, turn, axis=1) >= some["least"].to_numpy()[:, None]) & (n[turn] > 0)
                    picked = [t[h].astype(np.int32) for t, h in zip(turn, hit, strict=True)]
                    yield pd.DataFrame({"query_id": some["query_id"], "least": some["least"], "cells": picked})[hit.any(axis=1)]

        return of

    def cell(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q = q.sort_values("query_id")
        found = search_cell(
            c["id"].to_numpy(np.int64), np.frombuffer(b"".join(c["code"]), np.uint8).reshape(len(c), -1), c["norm"].to_numpy(), c["corr"].to_numpy(),
            np.stack(c["vec"].to_numpy()).astype(np.float64), shared.value[0][int(c["cell"].iloc[0])],
            q["query_id"].to_numpy(np.int64), np.stack(q["query"].to_numpy()).astype(np.float64), q["least"].to_numpy(), k, epsilon,
        )
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    each = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    best, start, end = None, 0, FIRST
    while start < len(cells):
        bounds = asked.select("query_id", "query", F.lit(float("-inf")).alias("least"))
        if best is not None:
            reached = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
            bounds = asked.join(reached, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        probes = checkpointed(bounds.mapInPandas(wanted(start, end), "query_id long, least double, cells array<int>"))
        groups = {r["cell"]: -(-r["m"] // CELL_QUERIES) for r in probes.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("m")).collect()}  # CELLS rows at most
        if not groups:  # bounds fall along each query's order: no later cell is wanted either
            break
        many = F.element_at(F.lit([groups.get(i, 0) for i in range(len(cells))]), F.col("cell") + 1)
        candidates = coded.drop("asked").filter(many > 0).withColumn("part", dealt("id", part_of)).withColumn("group", each(many))
        asking = probes.join(asked, "query_id").withColumn("cell", F.explode("cells")).drop("cells")
        asking = asking.withColumn("group", dealt("query_id", many)).withColumn("part", each(part_of))
        by = ["cell", "part", "group"]
        met = candidates.groupBy(*by).cogroup(asking.groupBy(*by)).applyInPandas(cell, "query_id long, vec_id long, score double")
        if best is not None:
            met = met.unionByName(best.drop("rank"))
        best = checkpointed(met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
        start, end = end, GROWTH * end
    return spark.createDataFrame([], schema) if best is None else best.select("query_id", "rank", "vec_id", "score")
