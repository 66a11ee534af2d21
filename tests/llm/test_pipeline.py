"""The pipeline and its stages against plain versions, on awkward tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from loomwright.llm import lines, mixing, simhash, toxicity
from test_operators import brute_lines, brute_print

NAMES = "doc_id long, text string, lang string, source string, n_chars long, gone string, copies int, doc string, component_id long"


def rows():
    r = random.Random(4)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    boiler = "all rights reserved by the owners of this site"
    out = []
    for i in range(1, 241):
        text = " ".join(r.choices(words, k=r.randint(8, 60))) + f" {i}"
        if i % 5 == 1:
            text = f"{i} " + " ".join(r.choices("you utter moron idiot scum filth".split(), k=60))
        if i % 3 == 0:
            text += "\n" + boiler
        out.append((i, text, f"s{i % 4}" if i % 3 else "s0"))
    out += [(270, out[1][1], "s9"), (271, out[1][1], "s8"), (272, boiler, "s1"), (273, None, "s1"), (274, "", None), (275, "word " * 5000, "s2"), (275, "word " * 5000, "s2"), (None, "x y z", "s2"), (276, " \n ", "s3")]
    return [(i, t, "en", s, None if t is None else len(t), "g", 7, "d", 3) for i, t, s in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows(), NAMES).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 1)) for i in range(1, 241)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], NAMES).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def ids(df):
    return sorted((r["doc_id"] or 0) for r in df.collect())


def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_keep_the_columns(spark, folder, none):
    for f in (folder, none):
        for name, stage in pipe.STAGES[:-1]:
            out = stage(spark, docs(spark, f), f)
            assert out.columns == docs(spark, f).columns, name
            assert [t for _, t in out.dtypes] == [t for _, t in docs(spark, f).dtypes], name
    assert all(stage(spark, docs(spark, none), none).count() == 0 for _, stage in pipe.STAGES)


def test_drop_toxic(spark, folder):
    d = docs(spark, folder)
    model = toxicity.train(d.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0), spark.read.parquet(f"{folder}/labels.parquet"))
    kept = ids(pipe.drop_toxic(spark, d, folder))
    assert kept == sorted((x[0] or 0) for x in rows() if toxicity.score(x[1], *model) < 0.5)
    assert not [i for i in kept if 0 < i <= 240 and i % 5 == 1] and len([i for i in kept if 0 < i <= 240 and i % 5 != 1]) == 192


def test_drop_lines(spark, folder):
    want = []
    plain = brute_lines([(x[0], x[1], x[3]) for x in rows()], lines.MIN_SITES, 5)
    before = sorted((repr(x[0]), x[1]) for x in rows())
    for (i, t), (_, old) in zip(plain, before, strict=True):
        if t == old or t.split():
            want.append((i, t))
    got = pipe.drop_lines(spark, docs(spark, folder), folder).collect()
    assert sorted((repr(r["doc_id"]), r["text"]) for r in got) == want
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)


def test_drop_near_copies(spark, folder):
    held = [(x[0], brute_print(x[1] or "")) for x in rows()]
    parent = {i: i for i, _ in held if i}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, fa in held:
        for b, fb in held:
            if a and b and (fa ^ fb).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = sorted((x[0] or 0) for x in rows() if x[0] is None or root(x[0]) == x[0])
    assert ids(pipe.drop_near_copies(spark, docs(spark, folder), folder)) == want


def test_mix_sources(spark, folder):
    d = docs(spark, folder)
    got, again = ids(pipe.mix_sources(spark, d, folder)), ids(pipe.mix_sources(spark, d.repartition(5), folder))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(d.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    assert got == again and set(copies.values()) <= {0, 1, 2} and got.count(0) == 1
    size = {}
    for x in rows():
        if x[0]:
            size.setdefault(x[3], []).append((x[0], len((x[1] or "").split())))
    for x in mixing.source_targets(spark.createDataFrame([(s, sum(n for _, n in v)) for s, v in size.items()], "source string, source_size long")).collect():
        taken = sum(n * got.count(i) / (2 if i == 275 else 1) for i, n in size[x["source"]])
        assert abs(taken - x["target"]) <= 2 * max(n for _, n in size[x["source"]])


def test_run(spark, folder, none):
    out = pipe.run(spark, folder)
    place = {}
    for r in out.collect():
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in place.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024
    d = docs(spark, folder)
    for _, stage in pipe.STAGES[:-1]:
        d = stage(spark, d, folder).checkpoint()
    last = pipe.pack_sequences(spark, d, folder)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(repr, out.select(*columns).collect())) == sorted(map(repr, last.select(*columns).collect()))
    assert pipe.run(spark, none).count() == 0
