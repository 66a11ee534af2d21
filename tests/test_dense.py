"""Inner products in blocks of questions against a plain ranking."""

import random

import pytest

from loomwright.operators import retrieval


@pytest.mark.parametrize("asked", [2, retrieval.ASKED])
@pytest.mark.parametrize("key", [str, int])
def test_blocks_rank_as_all_pairs(spark, monkeypatch, asked, key):
    rng = random.Random(2)
    vectors = [(key(100 + i), [rng.choice([-1.0, 0.0, 0.5]) for _ in range(5)]) for i in range(80)]
    questions = [(i, [rng.choice([-1.0, 1.0, 0.25]) for _ in range(5)]) for i in range(9)]
    monkeypatch.setattr(retrieval, "ROWS", 16)
    kind = "string" if key is str else "long"
    df = spark.createDataFrame(vectors + [(key(900), None), (key(901), [1.0])], f"chunk_id {kind}, v array<float>").repartition(3)
    got = retrieval.dense(df, spark.createDataFrame(questions + [(99, None)], "query_id long, q array<float>"), 7, asked).collect()
    want = []
    for q, a in questions:
        scores = sorted((-round(sum(x * y for x, y in zip(a, v)), 6), c) for c, v in vectors)[:7]
        want += [(q, c, -s, r + 1) for r, (s, c) in enumerate(scores)]
    assert sorted((r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in got) == sorted(want)


def test_no_questions_and_no_vectors(spark):
    v, q = spark.createDataFrame([(1, [1.0])], "chunk_id long, v array<double>"), spark.createDataFrame([(1, [1.0])], "query_id long, q array<double>")
    assert retrieval.dense(v.limit(0), q, 3).count() == retrieval.dense(v, q.limit(0), 3).count() == 0


def test_letters_are_counted_in_one_pass(spark):
    import time

    from pyspark.sql import functions as F

    texts = [None, "", "YZ 9", "abcA xİKÉ", "é日b", "Letters " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts * 8)), "i int, t string").select("i", retrieval.letters(F.col("t")).alias("v"))
    began = time.monotonic()
    got = {r["i"]: r["v"] for r in df.collect()}
    assert time.monotonic() - began < 30  # each letter once for each share, as before, takes minutes
    for i, t in enumerate(texts * 8):
        counts = [(t or "").lower().count(chr(97 + j)) for j in range(24)]
        norm = sum(c * c for c in counts) ** 0.5
        assert got[i] == [c / norm if norm else 0.0 for c in counts]


def test_vectors_of_a_small_file_are_made_on_all_cores(spark, tmp_path):
    spark.createDataFrame([(i, f"word {i}") for i in range(40)], "chunk_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/t")
    chunks = spark.read.parquet(f"{tmp_path}/t")
    assert chunks.rdd.getNumPartitions() == 1
    assert retrieval.embedded(chunks).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
