"""Timers of masked streams, batches written once, keyed merges, fitted forecasts and compared tables."""

import glob
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import compare, forecast
from loomwright.sources import merge
from loomwright.streaming import ledger, masking

FRAGMENT = "stream_id long, pos long, piece string, last boolean"


def test_a_silent_stream_is_let_go(spark, tmp_path):
    """Stream 1 never ends. A second batch, of another stream alone, comes after its time: the timer fires."""
    add = lambda n, rows: spark.createDataFrame(rows, FRAGMENT).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    add(0, [(1, 0, "mail ana@", False), (1, 1, "b.com", False), (2, 0, "cpf 123.456.", False)])
    stream = spark.readStream.schema(FRAGMENT).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run = lambda: masking.mask_available(stream, str(tmp_path / "out"), str(tmp_path / "state"), quiet=500)
    run()
    time.sleep(1.0)
    add(1, [(3, 0, "olá", True)])
    run()
    said = {r["stream_id"]: r["text"] for r in spark.read.schema("stream_id long, text string").parquet(str(tmp_path / "out")).collect()}
    assert said == {1: "mail [EMAIL]", 2: "cpf 123.456.", 3: "olá"}
    assert sum(1 for _ in glob.glob(str(tmp_path / "state/offsets/[0-9]*"))) >= 2
    # nothing is held any more: what comes for stream 1 now stands alone
    add(2, [(1, 9, "novo", True)])
    run()
    later = [r["text"] for r in spark.read.schema("stream_id long, text string").parquet(str(tmp_path / "out")).filter("stream_id = 1").collect()]
    assert sorted(later) == ["mail [EMAIL]", "novo"]


def test_a_batch_run_again_is_written_once(spark, tmp_path):
    rows, path = spark.range(100).withColumn("k", F.col("id") % 3), str(tmp_path / "t")
    assert ledger.write_once(rows, 0, path, "q", "k") and not ledger.write_once(rows, 0, path, "q", "k")
    assert ledger.write_once(rows, 1, path, "q", "k") and ledger.write_once(rows, 0, path, "other", "k")
    back = ledger.ingested(spark, path, "id long, k long")
    assert back.count() == 300 and back.filter("query = 'q'").groupBy("id").count().filter("count <> 2").isEmpty()
    assert sorted(r[:] for r in ledger.entries(spark, path).collect()) == [("other", 0, 100), ("q", 0, 100), ("q", 1, 100)]


def test_a_batch_that_failed_before_its_entry_is_not_read_and_written_over(spark, tmp_path):
    path = str(tmp_path / "t")
    ledger.write_once(spark.range(10), 0, path, "q")
    spark.range(7).write.parquet(f"{path}/query=q/batch=1")  # the rows of a batch whose entry was never written
    assert ledger.ingested(spark, path, "id long").count() == 10
    assert ledger.write_once(spark.range(20), 1, path, "q")
    assert ledger.ingested(spark, path, "id long").count() == 30


def test_a_stream_whose_progress_is_lost_adds_nothing(spark, tmp_path):
    spark.range(50).repartition(5).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for checkpoint in ("a", "b"):  # the second starts from the first batch again
        ledger.ingest(stream(), str(tmp_path / "t"), str(tmp_path / checkpoint), "q").awaitTermination(120)
    back = ledger.ingested(spark, str(tmp_path / "t"), "id long")
    assert back.count() == 50 and back.select("batch").distinct().count() == 5


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/_bucket=*/*.parquet")}


def test_merge_keeps_untouched_buckets_and_the_newest_rows(spark, tmp_path):
    path, schema = str(tmp_path / "m"), "id long, v string, at long"
    first = [(i, f"old {i}", 5) for i in range(400)] + [(3, "older", 1), (3, "newest of two", 9), (None, "no key", 1)]
    assert merge.merge(spark.createDataFrame(first, schema), path, "id", "at", 32, exists=False) == 32
    before = files(path)
    assert merge.merge(spark.createDataFrame([(7, "new", 6), (7, "newer", 7), (8, "late news", 4), (9, "same age", 5), (1000, "added", None)], schema), path, "id", "at", 32) <= 4
    got = {r["id"]: (r["v"], r["at"]) for r in merge.keyed(spark, path).collect()}
    want = {i: (f"old {i}", 5) for i in range(400)} | {3: ("newest of two", 9), 7: ("newer", 7), 9: ("same age", 5), 1000: ("added", None)}
    assert got == want and merge.keyed(spark, path).count() == len(want)
    kept = set(before.items()) & set(files(path).items())
    assert len({os.path.dirname(f) for f, _ in kept}) >= 28
    assert merge.merge(spark.createDataFrame([], schema), path, "id", "at", 32) == 0 and merge.keyed(spark, path).count() == len(want)


def made_series(n, size, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(size)
    return [1000 + rng.uniform(-3, 8) * t + rng.uniform(10, 300) * np.sin(2 * np.pi * t / 12 + i) + rng.normal(0, rng.uniform(1, 80), size) for i in range(n)]


def plain_error(y, w, p=12):
    a, b, g = w
    first = y[:p].mean()
    trend = (y[p : 2 * p].mean() - first) / p
    season = [y[i] - first - trend * (i - (p - 1) / 2) for i in range(p)]
    level, lost = first + trend * (p - 1) / 2, 0.0
    for t in range(p, len(y)):
        s = season[t % p]
        lost += (y[t] - level - trend - s) ** 2
        new = a * (y[t] - s) + (1 - a) * (level + trend)
        trend, season[t % p], level = b * (new - level) + (1 - b) * trend, g * (y[t] - new) + (1 - g) * s, new
    return lost


def test_weights_are_never_worse_than_the_grid_and_series_do_not_touch():
    ys = made_series(6, 90, 1) + made_series(3, 40, 2) + made_series(2, 24, 3)
    weights, lost = forecast.fitted_weights(ys)
    better = 0
    for y, w, e in zip(ys, weights, lost):
        grid = min(plain_error(y, g) for g in forecast.GRID)
        assert np.isclose(plain_error(y, w), e) and e <= grid * (1 + 1e-12)
        better += e < grid * 0.999
        alone, one = forecast.fitted_weights([y])
        assert np.allclose(alone[0], w) and np.isclose(one[0], e)
        assert np.allclose(forecast.holt_winters(y, 5), forecast.holt_winters_all(ys, 5)[[v is y for v in ys].index(True)])
    assert better >= 5
    assert forecast.holt_winters(np.array([1.0, 2.0]), 3).tolist() == [2.0] * 3 and np.isnan(forecast.holt_winters(np.zeros(0), 2)).all()


def test_tables_compared(spark):
    rows = [(i % 50, float(i % 7) / 3, f"t{i % 5}", None if i % 11 else i) for i in range(500)]
    schema = "k long, x double, s string, m long"
    left = spark.createDataFrame(rows + [(999, float("nan"), None, None)], schema)
    shaken = [(k, x + 2e-8 * (-1) ** i, s, m) for i, (k, x, s, m) in enumerate(rows)]
    same = spark.createDataFrame(shaken[::-1] + [(999, float("nan"), None, None)], schema).select("s", "x", "m", "k")
    report, cells = compare.compare(left, same)
    assert report.first().asDict() == {"n_left": 501, "n_right": 501, "n_same": 501, "only_left": 0, "only_right": 0} and cells.count() == 0
    other = spark.createDataFrame(shaken[1:] + shaken[1:2] + [(999, float("nan"), "x", None)], schema)
    report, cells = compare.compare(left, other)
    assert report.first().asDict() == {"n_left": 501, "n_right": 501, "n_same": 499, "only_left": 2, "only_right": 2}
    assert {(r["column"], r["left"], r["right"]) for r in cells.collect() if r["place"] == 1} >= {("s", "null", "x")}
    with pytest.raises(ValueError, match="one side alone"):
        compare.compare(left, other.drop("m"))


def test_numbers_about_a_cells_edge_are_equal(spark):
    a = spark.createDataFrame([(0.4999999999,), (1.5,), (2.0,)], "x double")
    b = spark.createDataFrame([(0.5000000001,), (1.5000000001,), (3.0,)], "x double")
    assert compare.compare(a, b, digits=0)[0].first()["n_same"] == 2 and compare.compare(a.limit(0), b.limit(0))[0].first()["n_same"] == 0
