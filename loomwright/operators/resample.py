"""Bootstrap intervals: every row is drawn a Poisson number of times in each replicate, by a hash of its key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chances that a Poisson variable of mean 1 is at most 0, 1, ... 11.
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 12)]))
#: Rows drawn at a time.
BLOCK = 512


def draws(keys: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """How often each row (a 64-bit hash) is drawn in each replicate."""
    x = keys.astype(np.uint64)[:, None] + reps.astype(np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    uniform = (x ^ (x >> np.uint64(31))) >> np.uint64(11)
    return np.searchsorted(POISSON, uniform.astype(np.float64) / float(1 << 53), side="right").astype(np.float64)


def resampled_sums(df: DataFrame, key: str, by: str, values: list[str], reps: int = 2000, seed: int = 42) -> DataFrame:
    """(by, rep, n, and the sum of each of ``values``) of every replicate.

    Tasks add up their own rows for all replicates, and only those sums are shuffled. What is drawn
    hangs on the key and the seed alone, not on how rows are dealt. Rows with a null value are left out.
    """
    hashed = df.dropna(subset=values).select(F.col(by).alias("_by"), F.xxhash64(F.lit(seed), F.col(key)).alias("_h"), *[F.col(v).cast("double").alias(v) for v in values])
    number = np.arange(reps)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for group, rows in pdf.groupby("_by", dropna=False):
                sums = np.zeros((len(values) + 1, reps))
                x = np.c_[np.ones(len(rows)), rows[values].to_numpy(np.float64)].T
                h = rows["_h"].to_numpy(np.int64).view(np.uint64)
                for i in range(0, len(rows), BLOCK):
                    sums += x[:, i : i + BLOCK] @ draws(h[i : i + BLOCK], number)
                out = {"_by": [None if pd.isna(group) else group] * reps, "rep": number.astype(np.int32), "n": sums[0]}
                yield pd.DataFrame(out | {v: s for v, s in zip(values, sums[1:], strict=True)})

    kind = dict(hashed.dtypes)["_by"]
    schema = f"_by {kind}, rep int, n double, " + ", ".join(f"`{v}` double" for v in values)
    parts = hashed.mapInPandas(add, schema)
    return parts.groupBy(F.col("_by").alias(by), "rep").agg(*[F.sum(c).alias(c) for c in ("n", *values)])


def _interval(reps: DataFrame, by: str, what: F.Column) -> DataFrame:
    ends = F.percentile(what, F.array(F.lit(0.025), F.lit(0.975)))
    return reps.groupBy(by).agg(ends.alias("_e")).select(by, F.round(F.col("_e")[0], 3).alias("lo"), F.round(F.col("_e")[1], 3).alias("hi"))


def bootstrap_mean(df: DataFrame, key: str, by: str, value: str, reps: int = 2000, seed: int = 42) -> DataFrame:
    """(by, lo, hi): the 95 percent interval of each group's mean."""
    return _interval(resampled_sums(df, key, by, [value], reps, seed), by, F.col(value) / F.nullif(F.col("n"), F.lit(0.0)))


def bootstrap_kappa(pairs: DataFrame, key: str, by: str, a: str, b: str, reps: int = 2000, seed: int = 42) -> DataFrame:
    """(by, lo, hi) of Cohen's kappa of two 0/1 columns; replicates in which chance agreement is 1 count as 1."""
    rows = pairs.select(key, by, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).withColumn("_same", (F.col("_a") == F.col("_b")).cast("double"))
    share = {c: F.col(c) / F.nullif(F.col("n"), F.lit(0.0)) for c in ("_a", "_b", "_same")}
    chance = share["_a"] * share["_b"] + (1 - share["_a"]) * (1 - share["_b"])
    kappa = F.when(chance == 1, 1.0).otherwise((share["_same"] - chance) / F.nullif(1 - chance, F.lit(0.0)))
    return _interval(resampled_sums(rows, key, by, ["_a", "_b", "_same"], reps, seed), by, kappa)
