"""Exact percentiles against sorting in memory."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import quantiles
from loomwright.operators.metrics import psi

DISC, CONT = {"d0": 0.0, "d50": 0.5, "d95": 0.95, "d100": 1.0}, {"c10": 0.1, "c50": 0.5, "c90": 0.9}


def plain(values):
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    n = len(v)
    disc = [float(v[max(math.ceil(p * n), 1) - 1]) for p in DISC.values()]
    cont = []
    for p in CONT.values():
        at = p * (n - 1)
        lo, hi = float(v[math.floor(at)]), float(v[math.ceil(at)])
        cont.append(lo if lo == hi else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi)
    return disc + cont


def rows():
    rng = random.Random(1)
    groups = {
        "normal": [rng.gauss(0, 1) for _ in range(3000)], "ties": [float(rng.randint(0, 3)) for _ in range(2500)], "one": [7.25] * 1500, "few": [3.0, 1.0, 2.0],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(2000)], "hot": [5.0] * 1900 + [rng.random() for _ in range(400)],
        "odd": [float("inf"), float("-inf"), float("nan"), 0.0, -0.0] * 300, None: [float(i) for i in range(1200)],
    }
    return groups, [(g, v, 0) for g, vs in groups.items() for v in vs] + [("few", None, 0), ("nulls", None, 0)]


@pytest.mark.parametrize("small", [50, 1000, quantiles.SMALL])
def test_quantiles_are_those_of_sorted_rows(spark, small):
    groups, data = rows()
    df = spark.createDataFrame(data, "g string, v double, _n int").repartition(5)
    got = {r["g"]: [r[c] for c in (*DISC, *CONT)] for r in quantiles.exact_quantiles(df, ["g"], "v", DISC, CONT, small).collect()}
    assert got.pop("nulls") == [None] * 7
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.array_equal(got[g], plain(vs), equal_nan=True), g


def test_whole_numbers_beyond_doubles(spark):
    base = (1 << 53) + 1
    df = spark.createDataFrame([(base + i,) for i in range(400)] + [(-base,)], "v long")
    whole = {((), 1): -base, ((), 2): base, ((), 401): base + 399}
    assert quantiles.selected(df, {(): [1, 2, 401]}, {(): (401, -base, base + 399)}, [], "v", 3) == whole


def test_no_groups_and_no_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("v"))
    assert quantiles.exact_quantiles(df, [], "v", {"m": 0.5}, {"c": 0.5}, 10).collect()[0][:] == (2499.0, 2499.5)
    assert quantiles.exact_quantiles(df.limit(0), [], "v", {"m": 0.5}).collect()[0][:] == (None,)
    assert quantiles.exact_quantiles(df.limit(0).withColumn("g", F.lit(1)), ["g"], "v", {"m": 0.5}).collect() == []


def test_two_columns_of_groups(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("a"), F.when(F.col("id") % 3 > 0, "x").alias("b"), F.col("id").alias("v"))
    got = {(r["a"], r["b"]): r["m"] for r in quantiles.exact_quantiles(df, ["a", "b"], "v", {"m": 0.5}, small=100).collect()}
    for (a, b), m in got.items():
        vs = [i for i in range(4000) if i % 2 == a and ("x" if i % 3 else None) == b]
        assert m == vs[math.ceil(len(vs) / 2) - 1]


def test_a_round_settles_many_rows_and_no_task_holds_a_group(spark, monkeypatch):
    """A million rows: cells are counted in tasks, and what is sorted at last is far under a group."""
    df = spark.range(1_000_000).select((F.sin("id") * 1e6).alias("v"))
    rounds, seen = [], quantiles.counted
    monkeypatch.setattr(quantiles, "counted", lambda *a: rounds.append(seen(*a)) or rounds[-1])
    m = quantiles.exact_quantiles(df, [], "v", {"m": 0.5}, small=2000).first()["m"]
    v = np.sort(np.sin(np.arange(1_000_000)) * 1e6)
    assert abs(m - v[499_999]) < 1e-6 and 1 <= len(rounds) <= 6


def test_psi_over_selected_cuts(spark):
    base, recent = spark.range(30_000).select(F.col("id").cast("double").alias("v")), spark.range(30_000).select((F.col("id") * 1.5).alias("v"))
    same = psi(base, base, "v").first()
    assert same["psi"] == 0 and same["status"] == "estavel" and psi(base, recent, "v").first()["status"] == "severo"
