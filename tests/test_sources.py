"""Archives read a member to a task, and sentences of files cut into splits, against plain readers."""

import csv
import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from loomwright.sources import archives, files


def test_members_are_partitions(spark, tmp_path):
    big = [(str(i), f'v "{i}"\nline, {i}') for i in range(12_345)]
    for name, compression in (("a.zip", zipfile.ZIP_DEFLATED), ("b.zip", zipfile.ZIP_STORED)):
        with zipfile.ZipFile(tmp_path / name, "w", compression) as z:
            z.mkdir("folder")
            for m, rows in (("one.csv", big), ("two.csv", [("x", "é"), ("only",), ("a", "b", "c")]), ("empty.csv", [])):
                with z.open(m, "w", force_zip64=True) as f:
                    out = io.TextIOWrapper(f, "utf-8", newline="")
                    csv.writer(out).writerows([("h1", "h2"), *rows])
                    out.close()
    df = archives.read_zipped_csv(spark, str(tmp_path), ["p", "q"])
    assert df.rdd.getNumPartitions() == 6
    assert sorted((r["p"], r["q"]) for r in df.collect()) == sorted([*big, ("x", "é")] * 2)
    bad = archives.read_zipped_csv(spark, str(tmp_path / "a.zip"), ["p", "q"], rejected=True).collect()
    assert [(r["_archive"], r["_member"], r["number"], r["fields"]) for r in bad] == [("a.zip", "two.csv", 2, ["only"]), ("a.zip", "two.csv", 3, ["a", "b", "c"])]


def test_what_is_no_good_archive(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"no archive at all, but long enough to have a header")
    with zipfile.ZipFile(tmp_path / "g.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m.csv", "h1,h2\n" + "1,2\n" * 5000)
    data = bytearray((tmp_path / "g.zip").read_bytes())
    at = data.rindex(b"PK\x01\x02")
    struct.pack_into("<I", data, at + 16, 12345)
    (tmp_path / "crc.zip").write_bytes(data)
    for name, said in (("x.bin", "not a zip archive"), ("none*.zip", "no archive"), ("crc.zip", "not those that were stored")):
        with pytest.raises(Exception, match=said):
            archives.read_zipped_csv(spark, str(tmp_path / name), ["p", "q"]).collect()
    with pytest.raises(Exception, match="2 columns where 1 are expected"):
        archives.read_zipped_csv(spark, str(tmp_path / "g.zip"), ["p"]).collect()
    whole = (tmp_path / "g.zip").read_bytes()
    with pytest.raises(ValueError, match="ends early"):
        list(archives.inflated(io.BytesIO(whole[:60])))


def test_written_archives_come_back(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").cast("string").alias("a"), F.when(F.col("id") % 5 > 0, F.concat(F.lit('q"\n'), F.col("id"))).alias("b")).repartition(3)
    archives.write_zipped_csv(df, str(tmp_path / "z"), 100)
    back = archives.read_zipped_csv(spark, str(tmp_path / "z"), ["a", "b"])
    assert back.rdd.getNumPartitions() >= 10
    assert sorted((r["a"], r["b"]) for r in back.collect()) == sorted((r["a"], r["b"] or "") for r in df.collect())


def plain_conll(text):
    out, held, some = [], [], False
    for line in [*text.replace("\r\n", "\n").split("\n"), ""]:
        if not line.strip(" \t"):
            if some:
                out.append(held)
            held, some = [], False
        else:
            some = True
            words = line.split()
            if len(words) > 1 and not line[0].isspace():
                held.append((words[0], words[-1]))
    return [(n, [w for w, _ in s], [t for _, t in s]) for n, s in enumerate(out) if s]


@pytest.mark.parametrize("size", ["64", "257", "100000"])
def test_sentences_over_splits(spark, tmp_path, size):
    rng = random.Random(8)
    texts = {
        "a.txt": "".join(rng.choice(["tok O\n", "Word B-X\n", "longer_token_here I-X\n", "\n", "\n", "  \n", "alone\n", "a x B-Y\r\n", " lead O\n"]) for _ in range(300)),
        "b.txt": "w O\n" * 120, "c.txt": "\n\n\nx O\n\n", "d.txt": "", "e.txt": "no_end B-Z\nlast I-Z",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = files.read_conll(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, text in texts.items():
        assert sorted((r["sentence"], r["tokens"], r["tags"]) for r in rows if r["file"] == name) == plain_conll(text), name
