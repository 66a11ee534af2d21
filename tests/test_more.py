"""Files, streams, forecasts, clauses and classifiers on small hand-made input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import clauses, forecast, learn, metrics
from loomwright.sources import files
from loomwright.streaming import masking

TEXT = "fale com ana.souza@exemplo.com ou (61) 99999-8888 sobre o CPF 123.456.789-09 " * 6


def test_latin1(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("km;tipo\n506,5;\"Colisão\n;x\n".encode("latin-1"))
    rows = files.read_csv_latin1(spark, str(tmp_path), ["km", "tipo"]).collect()
    assert {(r["km"], r["tipo"]) for r in rows} == {("506,5", '"Colisão'), ("", "x")}
    with pytest.raises(ValueError, match="unexpected columns"):
        files.read_csv_latin1(spark, str(tmp_path), ["a", "b"])


def test_conll_squad_labels(spark, tmp_path):
    (tmp_path / "c").write_text("A B-X\nb I-X\n\nc O\n")
    rows = files.read_conll(spark, str(tmp_path / "c")).orderBy("sentence").collect()
    assert [(r["tokens"], r["tags"]) for r in rows] == [(["A", "b"], ["B-X", "I-X"]), (["c"], ["O"])]
    (tmp_path / "s.json").write_text('{"data":[{"title":"t","paragraphs":[{"context":"abc","qas":[{"id":"1","question":"q","is_impossible":false,"answers":[{"text":"b","answer_start":1}]}]}]}]}')
    docs, asked = files.read_squad(spark, str(tmp_path / "s.json"))
    assert docs.first()["context"] == "abc" and asked.first()["answers"][0]["answer_start"] == 1
    (tmp_path / "l.csv").write_text("id;relevante\n1.0;1\n2;0\n3;\n4;x\n")
    assert {(r["id"], r["label"]) for r in files.read_labels(spark, str(tmp_path / "l.csv")).collect()} == {("1", 1), ("2", 0)}


def test_partitioned(spark, tmp_path):
    files.write_partitioned(spark.range(10).withColumn("ano", F.col("id") % 2), str(tmp_path / "p"), "ano")
    assert spark.read.parquet(str(tmp_path / "p")).filter("ano = 1").count() == 5


@pytest.mark.parametrize("size", [3, 5, 50])
def test_mask_cuts(size):
    held, out = "", ""
    for i in range(0, len(TEXT), size):
        held += TEXT[i : i + size]
        cut = masking.safe_cut(held)
        out, held = out + masking.mask(held[:cut]), held[cut:]
    assert out and out + masking.mask(held) == masking.mask(TEXT)


def test_mask_stream(spark, tmp_path):
    parts = [(7, i // 5, TEXT[i : i + 5], i + 5 >= len(TEXT)) for i in range(0, len(TEXT), 5)]
    half = len(parts) // 2
    for n, rows in enumerate((parts[:half], parts[half:])):
        spark.createDataFrame(rows, "stream_id long, pos long, piece string, last boolean").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema("stream_id long, pos long, piece string, last boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    masking.mask_available(stream, str(tmp_path / "out"), str(tmp_path / "k"))
    files = sorted((tmp_path / "out").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    pieces = [r["text"] for f in files for r in spark.read.parquet(str(f)).collect()]
    assert "".join(pieces) == masking.mask(TEXT) and len(pieces) > 1


def test_neighbouring_fragments_are_joined():
    import pyarrow as pa

    rows = [(1, 0, "a", None), (1, 1, None, False), (1, 2, "b", True), (1, 4, "d", False), (2, 5, "e", None), (2, 5, "f", False), (None, 6, "g", False), (None, 7, "h", True), (2**60, 0, "i", False), (2**60 + 1, 1, "j", None), (3, None, "k", None)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(9, 9, "no", True), *rows]), (pa.int64(), pa.int32(), pa.string(), pa.bool_()))], ["stream_id", "pos", "piece", "last"]).slice(1)
    got = [tuple(r.values()) for out in masking.joined(iter([batch.slice(0, 0), batch])) for r in out.to_pylist()]
    assert got == [(1, 0, "ab", True), *((*r[:3], bool(r[3])) for r in rows[3:])]


def test_a_whole_stream_asks_for_state_once():
    """Every call of state is an exchange with the executor: a stream that comes whole asks for what is held, and no more."""
    calls = []

    class State:
        kept = None

        def __getattr__(self, name):
            calls.append(name)
            if name == "update":
                return lambda value: setattr(self, "kept", value)
            return lambda *a: self.kept if name == "get" else self.kept is not None if name == "exists" else []

    m, clock = masking.Masker(1000), type("Clock", (), {"getCurrentProcessingTimeInMs": lambda self: 0})()
    m.handle, m.held = State(), State()
    pieces = lambda a, z: iter([(7, i, TEXT[i * 5 : i * 5 + 5], i == n - 1) for i in reversed(range(a, z))] + [(7, a, None, None)])
    n = -(-len(TEXT) // 5)
    assert [r["text"] for r in m.handleInputRows((7,), pieces(0, n), clock)] == [masking.mask(TEXT)] and calls == ["get"]
    first = [r["text"] for r in m.handleInputRows((7,), pieces(0, n // 2), clock)]
    assert m.held.kept and "registerTimer" in calls
    rest = [r["text"] for r in m.handleInputRows((7,), pieces(n // 2, n), clock)]
    assert "".join(first + rest) == masking.mask(TEXT) and calls[-1] == "clear"


def test_forecasts():
    t = np.arange(120)
    y = 1000 + 8 * t + 200 * np.sin(2 * np.pi * t / 12)
    off = lambda p: np.abs((y[108:] - p) / y[108:]).mean()
    assert off(forecast.holt_winters(y[:108], 12)) < off(np.full(12, y[107]))
    assert off(forecast.ridge_recursive(y[:108], 12)) < off(np.full(12, y[107]))


def test_clauses():
    text = "Preamble\n" + "".join(f"{i}. Clause {'word ' * 6}\n" for i in range(1, 6))
    found = clauses.spans(text, 60, 0)
    assert "".join(text[a:b] for a, b in found) == text and all(b - a <= 60 for a, b in found)
    assert clauses.spans("", 60, 0) == [] and clauses.spans("a" * 100, 60, 10) == [(0, 60), (50, 100)]


def test_fleiss(spark):
    votes = [(i, c) for i, c in enumerate((2, 0, 1)) for _ in range(3)]
    assert metrics.fleiss_kappa(spark.createDataFrame(votes, "i int, c int"), "i", "c").first()["kappa"] == 1.0


def test_classifier(spark):
    df = spark.range(200).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 * 3 + F.col("id") % 7 / 10).alias("x"), F.lit("a").alias("c"))
    out = learn.fit(df, "y", ["x"], ["c"]).transform(df)
    assert out.filter("prediction = y").count() == 200
    assert learn.rare_together(df, "c").select("c").distinct().count() == 1
