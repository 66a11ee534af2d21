"""Forecasts of many series, each fitted by itself."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .star import lag_features

GRID = np.array(list(product((0.05, 0.2, 0.4, 0.6, 0.8), (0.0, 0.05, 0.2), (0.05, 0.2, 0.5, 0.8))))


#: Starts of the search for weights, its rounds, and its first step.
STARTS, ROUNDS, STEP = 4, 24, 0.1
LEAST = 1e-4


def smoothed(ys: list[np.ndarray], weights: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One-step squared error, level, trend and season at the end of each series for each of its weights
    (series x weights x 3), all at once. Series have two periods or more."""
    a, b, g = np.moveaxis(weights, 2, 0)
    size = np.array([len(y) for y in ys])
    y = np.array([np.pad(v, (0, size.max() - len(v))) for v in ys])
    first, second = y[:, :period].mean(axis=1), y[:, period : 2 * period].mean(axis=1)
    slope = (second - first) / period
    from_middle = np.arange(period) - (period - 1) / 2
    season = np.repeat((y[:, :period] - first[:, None] - slope[:, None] * from_middle).T[:, :, None], a.shape[1], axis=2)
    trend = np.repeat(slope[:, None], a.shape[1], axis=1)
    level = first[:, None] + trend * (period - 1) / 2
    lost = np.zeros_like(level)
    for t in range(period, y.shape[1]):
        live = (t < size)[:, None]
        now, s = y[:, t, None], season[t % period]
        lost += np.where(live, (now - level - trend - s) ** 2, 0.0)
        new = a * (now - s) + (1 - a) * (level + trend)
        trend = np.where(live, b * (new - level) + (1 - b) * trend, trend)
        season[t % period] = np.where(live, g * (now - new) + (1 - g) * s, s)
        level = np.where(live, new, level)
    return lost, level, trend, season


def fitted_weights(ys: list[np.ndarray], period: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(series x 3 weights, one-step squared errors): from each series' best points of GRID on, a step up or
    down one weight at a time while that helps, then half the step; never worse than the grid."""
    lost = smoothed(ys, np.repeat(GRID[None], len(ys), axis=0), period)[0]
    best = np.argsort(lost, axis=1, kind="stable")[:, :STARTS]
    at, error = GRID[best], np.take_along_axis(lost, best, axis=1)
    step = np.full(error.shape, STEP)
    moves = np.concatenate([np.eye(3), -np.eye(3)])
    for _ in range(ROUNDS):
        tried = np.clip(at[:, :, None] + step[:, :, None, None] * moves, LEAST, 1 - LEAST)
        found = smoothed(ys, tried.reshape(len(ys), -1, 3), period)[0].reshape(tried.shape[:3])
        pick = found.argmin(axis=2)
        least = np.take_along_axis(found, pick[..., None], axis=2)[..., 0]
        better = least < error
        at = np.where(better[..., None], np.take_along_axis(tried, pick[..., None, None], axis=2)[:, :, 0], at)
        error, step = np.where(better, least, error), np.where(better, step, step / 2)
    pick = error.argmin(axis=1)[:, None]
    return np.take_along_axis(at, pick[..., None], axis=1)[:, 0], np.take_along_axis(error, pick, axis=1)[:, 0]


def holt_winters_all(ys: list[np.ndarray], horizon: int, period: int = 12) -> list[np.ndarray]:
    """Additive level, trend and season of each series, with the smoothing weights that a bounded search
    finds for it; the last value repeated for series under two periods."""
    out = [np.full(horizon, y[-1] if len(y) else np.nan) for y in ys]
    long = [i for i, y in enumerate(ys) if len(y) >= 2 * period]
    if long:
        chosen = [ys[i] for i in long]
        weights, _ = fitted_weights(chosen, period)
        _, level, trend, season = smoothed(chosen, weights[:, None], period)
        for row, i in enumerate(long):
            out[i] = np.array([level[row, 0] + (h + 1) * trend[row, 0] + season[(len(ys[i]) + h) % period][row, 0] for h in range(horizon)])
    return out


def holt_winters(y: np.ndarray, horizon: int, period: int = 12) -> np.ndarray:
    return holt_winters_all([y], horizon, period)[0]


def ridge_recursive(y: np.ndarray, horizon: int, lags: tuple[int, ...] = (1, 2, 3, 12), weight: float = 1e-3) -> np.ndarray:
    """Ridge regression on lags and the means of the 3 and 12 values before, its forecasts fed back."""
    if len(y) < 2 * max(lags):
        return np.full(horizon, y[-1] if len(y) else np.nan)
    scale = np.abs(y).mean() or 1.0
    seen = list(y / scale)
    row = lambda v: [*(v[-k] for k in lags), np.mean(v[-3:]), np.mean(v[-12:]), 1.0]
    x = np.array([row(seen[:t]) for t in range(max(lags), len(seen))])
    w = np.linalg.solve(x.T @ x + weight * np.eye(x.shape[1]), x.T @ np.array(seen[max(lags):]))
    for _ in range(horizon):
        seen.append(float(np.dot(row(seen), w)))
    return np.array(seen[len(y):]) * scale


MODELS = {"holt_winters": holt_winters_all, "ridge_recursive": lambda ys, horizon: [ridge_recursive(y, horizon) for y in ys]}


def backtest_models(series: DataFrame, by: str, horizon: int = 12) -> DataFrame:
    """(by, model, mape) over the last ``horizon`` rows of each series (by, month, total). Each series is an
    array in one row, and the series of a batch are fitted together; its months are what bounds it."""
    rows = series.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("month", "total"))), lambda x: x.getField("total").cast("double")).alias("y"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ys = [np.array(y, np.float64) for y in pdf["y"]]
            for model, f in MODELS.items():
                off = []
                for y, said in zip(ys, f([y[:-horizon] for y in ys], horizon)):
                    held = y[-horizon:]
                    ok = held != 0
                    off.append(float(np.abs((held[ok] - said[: len(held)][ok]) / held[ok]).mean() * 100) if ok.any() else None)
                yield pd.DataFrame({by: pdf[by], "model": model, "mape": off})

    return rows.mapInPandas(each, f"{by} string, model string, mape double")


FEATURES = ("lag_1", "lag_2", "lag_3", "lag_12", "mean_3", "mean_12")


def boosted_recursive(series: DataFrame, by: str, horizon: int = 12) -> DataFrame:
    """(by, mape) of one boosted model of all series (by, month, total) over each one's last ``horizon``
    rows, its forecasts fed back as lags.

    Values are shares of their series' mean over the known rows. Series with under 13 known rows give none.
    A series travels as the array of its last twelve values, so that a step is one projection.
    """
    back = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("month")))
    ranked = series.select(by, "month", "total").withColumn("_r", back)
    known = ranked.filter(F.col("_r") > horizon).drop("_r")
    scale = known.groupBy(by).agg(F.avg("total").alias("_scale"), F.count("*").alias("_n")).filter("_scale <> 0 and _n > 12")
    shares = known.join(scale, by).select(by, "month", (F.col("total") / F.col("_scale")).alias("total"))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    rows = lag_features(shares, by).na.drop(subset=list(FEATURES))
    model = GBTRegressor(featuresCol="_features", labelCol="total", predictionCol="_next", maxIter=50, maxDepth=4, seed=42).fit(assembler.transform(rows))
    last = F.slice(F.transform(F.sort_array(F.collect_list(F.struct("month", "total"))), lambda x: x.getField("total")), -12, 12)
    state = shares.groupBy(by).agg(last.alias("_seen")).withColumn("_said", F.array().cast("array<double>"))
    at = lambda k: F.element_at("_seen", -k)
    mean = lambda n: sum((at(k) for k in range(2, n + 1)), at(1)) / n
    for _ in range(horizon):
        lags: dict[str, Column] = {"lag_1": at(1), "lag_2": at(2), "lag_3": at(3), "lag_12": at(12), "mean_3": mean(3), "mean_12": mean(12)}
        said = model.transform(assembler.transform(state.withColumns(lags)))
        state = said.select(by, F.concat(F.slice("_seen", 2, 11), F.array("_next")).alias("_seen"), F.concat("_said", F.array("_next")).alias("_said"))
    held = ranked.filter(F.col("_r") <= horizon)
    met = held.join(state, by).join(scale.select(by, "_scale"), by)
    error = F.abs((F.col("total") - F.element_at("_said", F.lit(horizon + 1) - F.col("_r")) * F.col("_scale")) / F.nullif(F.col("total"), F.lit(0.0)))
    return met.groupBy(by).agg((F.avg(error) * 100).alias("mape"))
