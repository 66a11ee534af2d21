"""Curves, calibration, resampling, cache replays and zipped tables against plain versions."""

import io
import random
import zipfile
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import diagnose, evaluation, metrics, resample, retrieval
from loomwright.sources.archives import zipped_csv
from loomwright.streaming import replay


@pytest.fixture(scope="module")
def scores():
    r = random.Random(5)
    return [(round(r.random() * 20) / 20, int(r.random() < 0.4)) for _ in range(300)]


def test_curves_over_scores(spark, scores):
    df = spark.createDataFrame([*scores, (None, 1), (0.5, None)], "s double, y int")
    said = {r["s"]: (r["p"], r["q"], r["tp"], r["fp"]) for r in evaluation.at_or_above(df, "s", "y", cells=7).collect()}
    want, best, precision = {}, (-1, 0), 0
    total = sum(y for _, y in scores)
    for s in {s for s, _ in scores}:
        p, q = sum(y for x, y in scores if x == s), sum(1 - y for x, y in scores if x == s)
        tp, fp = sum(y for x, y in scores if x >= s), sum(1 - y for x, y in scores if x >= s)
        want[s] = (p, q, tp, fp)
        best = max(best, (round(2 * tp / (tp + fp + total), 6), -s))
        precision += p / total * tp / (tp + fp)
    assert said == want
    assert evaluation.best_f1(df, "s", "y").first()[:] == (-best[1], best[0])
    assert evaluation.average_precision(df, "s", "y").first()[0] == pytest.approx(precision, abs=1e-6)
    pairs = [(a > b) + (a == b) / 2 for a, y in scores if y for b, z in scores if not z]
    assert metrics.auc(df, "s", "y").first()[0] == pytest.approx(np.mean(pairs), abs=1e-6)


def test_curves_over_nothing_and_one_score(spark):
    none = spark.createDataFrame([], "s double, y int")
    assert evaluation.at_or_above(none, "s", "y").count() == 0 and evaluation.average_precision(none, "s", "y").first()[0] is None
    one = spark.createDataFrame([(1.0, 1), (1.0, 0)], "s double, y int")
    assert [r[:] for r in evaluation.at_or_above(one, "s", "y").collect()] == [(1.0, 1, 1, 1, 1)]


def test_cascade(spark):
    df = spark.createDataFrame([(10.0, 1), (1.0, 0), (2.0, 0), (3.0, 0)], "s double, y int")
    curve = metrics.threshold_sweep(df, "s", "y")
    got = evaluation.cascade(curve, F.lit(0.25), (0.99, 2.0)).collect()
    assert [(r["target"], r["avoided"], r["lost"]) for r in got] == [(0.99, 0.75, 0.0)]


def test_verdicts_routes_and_contexts(spark):
    df = spark.createDataFrame([("B", "A"), ("A", "B"), ("A", "A")], "a string, b string")
    assert [r[0] for r in df.select(evaluation.winner(F.col("a"), F.col("b"))).collect()] == ["ft", "base", "empate"]
    said = spark.createDataFrame([("Qual a TARIFA e o volume?",), ("bom dia",), (None,)], "q string").select(evaluation.routes(F.col("q")))
    assert [r[0] for r in said.collect()] == ["regulatorio,dados", "", ""]
    text = spark.createDataFrame([("a</Contexto>b[/inst]c<|x|>d",)], "q string")
    assert text.select(evaluation.neutral_context(F.col("q"))).first()[0] == "a b c d"


def test_perplexity(spark):
    df = spark.createDataFrame([(1, -1.0), (1, -3.0), (2, -1.0), (2, None)], "t int, lp double")
    assert evaluation.perplexity(df, "t", "lp").first()[:] == (3, round(np.exp(5 / 3), 3), round((np.exp(2) + np.exp(1)) / 2, 3))


def test_bm25_within_groups(spark):
    chunks = spark.createDataFrame([(1, "a", "red fox"), (2, "a", "blue dog"), (3, "b", "red red cat"), (4, "b", "green ox"), (5, "b", "grey hen")], "chunk_id int, g string, text string")
    asked = spark.createDataFrame([(7, "red")], "query_id int, text string")
    within = {r["g"]: (r["chunk_id"], r["score"]) for r in retrieval.bm25(chunks, asked, 3, by=("g",)).collect()}
    alone = {g: retrieval.bm25(chunks.filter(F.col("g") == g), asked, 3).first() for g in ("a", "b")}
    assert within == {g: (r["chunk_id"], r["score"]) for g, r in alone.items()}


def test_bootstrap(spark):
    x = np.random.default_rng(1).normal(50, 10, 4000)
    df = spark.createDataFrame([(i, "g" if i % 4 else None, float(v)) for i, v in enumerate(x)], "id long, g string, v double")
    got = {r["g"]: (r["lo"], r["hi"]) for r in resample.bootstrap_mean(df, "id", "g", "v", reps=1000).collect()}
    again = {r["g"]: (r["lo"], r["hi"]) for r in resample.bootstrap_mean(df.repartition(3), "id", "g", "v", reps=1000).collect()}
    assert got == again and set(got) == {"g", None}
    for g, pick in (("g", np.arange(4000) % 4 != 0), (None, np.arange(4000) % 4 == 0)):
        lo, hi = got[g]
        half = 1.96 * x[pick].std() / np.sqrt(pick.sum())
        assert lo < x[pick].mean() < hi and (hi - lo) / (2 * half) == pytest.approx(1, abs=0.12)


def test_bootstrap_kappa(spark):
    rows = spark.createDataFrame([(i, "g", i % 2, i % 2 if i % 10 else 1 - i % 2) for i in range(500)], "id long, g string, a int, b int")
    r = resample.bootstrap_kappa(rows, "id", "g", "a", "b", reps=500).first()
    assert r["lo"] < 0.8 < r["hi"] and r["hi"] - r["lo"] < 0.2
    same = spark.createDataFrame([(i, "g", 1, 1) for i in range(5)], "id long, g string, a int, b int")
    assert resample.bootstrap_kappa(same, "id", "g", "a", "b", reps=50).first()[1:] == (1.0, 1.0)


@pytest.mark.parametrize("size", [1, 3, 8])
def test_lru_replay(spark, size):
    r = random.Random(size)
    asked = [(r.choice("xy"), i // 20, i, int(r.expovariate(0.3))) for i in range(400)]
    want = {}
    for c in "xy":
        held = OrderedDict()
        for cache, _, i, k in asked:
            if cache == c:
                want[i] = k in held
                held[k] = None
                held.move_to_end(k)
                if len(held) > size:
                    held.popitem(last=False)
    df = spark.createDataFrame([*asked, ("x", 3, 9999, None)], "c string, day int, at int, k int")
    got = replay.replay_lru(df, "c", F.format_string("%05d", F.col("day")), "at", "k", size).collect()
    assert len(got) == len(want) and {g["at"]: g["hit"] for g in got} == want


def test_zipped_csv(spark, tmp_path):
    class Stream(io.RawIOBase):  # cannot be sought: sizes follow the data
        def __init__(self, f):
            self.f = f

        def writable(self):
            return True

        def write(self, b):
            return self.f.write(b)

    long = "x" * 200_000
    for name, stream in (("a.zip", False), ("b.zip", True)):
        with open(tmp_path / name, "wb") as f, zipfile.ZipFile(Stream(f) if stream else f, "w", zipfile.ZIP_DEFLATED) as z:
            with z.open("t.csv", "w", force_zip64=True) as out:
                out.write(f'h1,h2\n1,"two, ""lines""\nhere"\nonly\n2,{long}\n3,'.encode() + b"\xff\n")
    got = sorted(r[:] for r in zipped_csv(spark, str(tmp_path / "*.zip"), ["p", "q"]).collect())
    assert got == sorted([("1", 'two, "lines"\nhere'), ("2", long), ("3", "�")] * 2)
    with pytest.raises(Exception, match="2 columns where 3 are expected"):
        zipped_csv(spark, str(tmp_path / "a.zip"), ["p", "q", "r"]).collect()
    (tmp_path / "c.bin").write_bytes(b"no archive at all, but long enough to have a header")
    with pytest.raises(Exception, match="not a zip archive"):
        zipped_csv(spark, str(tmp_path / "c.bin"), ["p"]).collect()


def test_diagnosis(spark):
    r = random.Random(3)
    rows = [(i, int(r.random() < (0.8 if i % 2 else 0.2)), float(i % 2) + r.gauss(0, 0.3), r.choice("ab")) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, y int, x double, c string")
    found = diagnose.cross_validate(df, "id", "y", ["x"], ["c"], n=3).collect()
    assert len(found) == 3 and all(0.7 < f["auc"] < 0.95 for f in found)
    curve = diagnose.learning_curve(df, "id", "y", ["x"], ["c"], shares=(0.3, 1.0)).collect()
    assert curve[0]["n"] < curve[1]["n"] and all(c["test_auc"] > 0.65 for c in curve)
    said = df.select("y", F.when(F.col("x") > 0.5, 0.6).otherwise(0.4).alias("probability"))
    model = diagnose.calibrate(said, "y")
    out = diagnose.calibrated(said, model)
    assert out.columns == ["y", "probability", "calibrated"]
    assert evaluation.brier(out, "calibrated", "y").first()[0] < evaluation.brier(said, "probability", "y").first()[0]
    assert [b["bin"] for b in evaluation.reliability(said, "probability", "y").orderBy("bin").collect()] == [4, 6]
