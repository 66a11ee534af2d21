"""Places of passages and their overlaps against string search."""

import random

import pytest

from loomwright.operators import passages


def plain(texts, items):
    return sorted((k, i, a, a + len(p)) for k, t in texts for i, p in items if t and p for a in range(len(t) - len(p) + 1) if t.startswith(p, a))


def made():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 5)))
    texts = [(i, "".join(word() for _ in range(rng.randint(0, 30)))) for i in range(40)] + [(7, "aaaaaa"), (7, "aaaaaa"), (50, None), (51, ""), (52, "日本👍日本")]
    items = [(i, word()) for i in range(60)] + [(90, "a"), (91, "aa"), (92, "aa"), (93, ""), (94, None), (95, "👍日"), (96, "aa")]
    return texts, items


@pytest.mark.parametrize("shard", [1, 40, passages.SHARD])
def test_every_place_of_every_passage(spark, shard):
    texts, items = made()
    got = passages.places(spark.createDataFrame(texts, "k long, t string").repartition(3), spark.createDataFrame(items, "i long, p string"), "k", "t", "i", "p", shard)
    assert sorted(r[:] for r in got.collect()) == plain(texts, items)


def test_nothing_to_look_for(spark):
    texts, none = spark.createDataFrame([(1, "a")], "k long, t string"), spark.createDataFrame([], "i long, p string")
    assert passages.places(texts, none, "k", "t", "i", "p").collect() == []
    assert passages.places(texts.limit(0), spark.createDataFrame([(1, "a")], "i long, p string"), "k", "t", "i", "p").collect() == []


def test_many_places_leave_in_pieces(spark):
    texts = spark.createDataFrame([(1, "a" * 120_000)], "k long, t string")
    got = passages.places(texts, spark.createDataFrame([(1, "a")], "i long, p string"), "k", "t", "i", "p")
    assert got.count() == 120_000 == got.distinct().count()


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_overlaps_by_bins(spark, size):
    rng = random.Random(9)
    spans = [(rng.randint(0, 3), a := rng.randint(0, 60), a + rng.randint(0, 30)) for _ in range(60)]
    windows = [(rng.randint(0, 3), a := rng.randint(0, 60), a + rng.randint(0, 20), n) for n in range(60)]
    got = passages.overlapping(spark.createDataFrame(spans, "k long, start int, end int"), spark.createDataFrame(windows, "k long, from int, to int, n int"), "k", size)
    want = sorted((k, a, z, f, t, n) for k, a, z in spans for j, f, t, n in windows if k == j and a < t and f < z and a < z and f < t)
    assert sorted((r["k"], r["start"], r["end"], r["from"], r["to"], r["n"]) for r in got.collect()) == want


def test_texts_of_a_batch_are_walked_one_by_one():
    """The strings of a whole batch, which larger tables fill, are not made at once."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"k": list(range(4000)), "t": ["filler word " * 500] * 4000})
    tracemalloc.start()
    rows = sum(len(out) for out in passages.walk(SimpleNamespace(value=["absent", "er w"]), "test", "k", "t", 1000)(iter([batch.slice(0, 10), batch])))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert rows == 4010 * 500 and peak < 8 << 20
