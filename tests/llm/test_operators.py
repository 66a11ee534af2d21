"""The training-data operators against brute force, on small and awkward inputs."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwright.llm import ann, chat, jpeg, lines, lm, mixing, packing, quality, simhash, toxicity

LONG = "word " * 30000
DOCS = [
    (1, "a b c d e f", "s0"), (2, "a b c d e f", "s1"), (3, None, None), (4, "", "s1"), (5, LONG, "s0"), (5, LONG, "s0"),
    (None, "x y z", "s2"), (6, "Ünï 漢字 \x1c z", "s2"), (7, " \n\n ", ""), (8, "idiot scum", "s3"),
]
SCHEMA = "doc_id long, text string, source string, id int, fp string, node int, piece string, block int"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, repeated rows, clashing extra columns."""
    return spark.createDataFrame([(*d, 1, "f", 2, "p", 3) for d in DOCS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, n=0):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(n)], "doc_id long, quality int, toxic int")


def brute_print(text):
    w = text.encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprint():
    for t in ("", "one", "a b c d e f g", LONG[:9000], "A a\tb\x0bC d E"):
        assert simhash.fingerprint(t) == brute_print(t)


def test_simhash_shards_are_bounded(spark, monkeypatch):
    """No shard holds more variants than it may, however alike the fingerprints; all links are found."""
    monkeypatch.setattr(simhash, "MEAN_SHARD", 1 << 12)
    monkeypatch.setattr(simhash, "FULL_SHARD", 1 << 13)
    r = random.Random(9)
    base = r.getrandbits(64)
    near = [base ^ sum(1 << k for k in r.sample(range(10), r.randint(0, 10))) for _ in range(60)]
    fps = sorted(set(near + [r.getrandbits(64) for _ in range(60)]))
    df = spark.createDataFrame([(int(f),) for f in np.array(fps, np.uint64).view(np.int64)], "fp long")
    dealt, order = simhash.shards(df, 2)
    held = {}
    for x in dealt.collect():
        bits = x["bits"]
        off = ((x["fp"] ^ x["key"]) & (2**64 - 1) & simhash.bits_of(order[:bits])).bit_count()
        n = simhash.ball(tuple(order[bits:]), 2)[1][2 - off]
        held[bits, x["key"]] = held.get((bits, x["key"]), 0) + n
    assert sum(held.values()) == 2081 * len(fps) and max(held.values()) <= 1 << 13 and len({b for b, _ in held}) > 1
    test_simhash_links_like_all_pairs(spark)


def test_simhash_links_like_all_pairs(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = base + [b ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 6))) for b in base for _ in range(3)]
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    place = {f: i for i, f in enumerate(signed)}
    got = {}
    for x in simhash.components(simhash.links(df, 4)).collect():
        got.setdefault(x["component"], set()).add(place[x["node"]])
    got = {i: min(c) for c in got.values() for i in c}
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    assert {i: root(i) for i in range(len(fps))} == {i: got.get(i, i) for i in range(len(fps))}


def test_simhash_edges(spark, docs, empty):
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 0), (1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (5, 5), (6, 6), (7, 3), (8, 8)]
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(docs).columns == docs.columns


def test_simhash_links_through_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, text, k: docs.withColumn("fp", F.col("text").cast("long")))
    rows = [(7, "0"), (None, "15"), (3, "255"), (None, "-1"), (2, str(1 << 40 | 0xFFFFF << 12))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["fp"]: r["component_id"] for r in simhash.near_duplicates(d).collect()}
    assert [got[int(t)] for _, t in rows] == [3, 3, 3, None, 2]


def test_lines(spark, empty):
    line = "this line is on many sites"
    rows = [(i, f"own {i}\n  {line}\t\nend", f"s{i % 12}") for i in range(24)] + [(99, None, "s1"), (98, "", "s1"), (97, line, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in lines.dedup_lines(d, min_sites=10).collect()}
    assert got[0]["n_removed"] == 0 and got[0]["text"] == rows[0][1]
    assert all(got[i]["text"] == f"own {i}\nend" for i in range(1, 24))
    assert got[99]["text"] is None and got[99]["n_lines"] == 0 and got[98]["text"] == "" and got[97]["text"] == ""
    assert all(r["n_removed"] == 0 for r in lines.dedup_lines(d, min_sites=13).collect())
    assert lines.dedup_lines(empty).count() == 0


def brute_lines(rows, sites, words):
    """Texts of (doc_id, text, source) less the lines of other documents that as many sources show."""
    held = {}
    for i, t, s in rows:
        for pos, line in enumerate(t.split("\n") if t is not None and i is not None else []):
            if len(line.split()) >= words:
                held.setdefault(" ".join(line.split(" ")).strip(), []).append((i, pos, s))
    gone = set()
    for places in held.values():
        if len({s for *_, s in places} - {None}) >= sites:
            gone |= {(i, p) for i, p, _ in places} - {min((i, p) for i, p, _ in places)}
    return sorted((repr(i), t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)) for i, t, s in rows)


def test_lines_like_brute_force(spark):
    """A third of all rows on one source, one line nearly everywhere, repeated rows, long texts, clashing names."""
    r = random.Random(11)
    known = [" ".join(r.choices("abcdefgh", k=r.choice([4, 5, 60]))) for _ in range(40)]
    rows = [(i, "\n".join([*r.choices(known, k=3), f"own line number {i} of it", known[0]][: r.randint(1, 5)]), "s0" if i % 3 else f"s{i % 9}") for i in range(300)]
    rows += rows[:5] + [(None, known[0], "s1"), (400, None, "s2"), (401, "", None), (402, "\n".join(known * 200), "s3"), (403, known[1], None)]
    d = spark.createDataFrame([(*x, 1, "n", 5, "k") for x in rows], "doc_id long, text string, source string, n_lines int, gone string, n int, key string").repartition(4)
    got = lines.dedup_lines(d)
    assert got.columns == ["doc_id", "text", "source", "gone", "n", "key", "n_lines", "n_removed"]
    assert sorted((repr(x["doc_id"]), x["text"]) for x in got.collect()) == brute_lines(rows, lines.MIN_SITES, 5)


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(DOCS) and all(0 <= r["copies"] <= 2 for r in got)
    assert {r["size"] for r in got if r["doc_id"] == 5} == {30000} and mixing.count_words(LONG * 50) == 1_500_000
    assert mixing.mix(empty).count() == 0
    r = random.Random(2)
    rows = [(i, "w " * r.randint(1, 60), f"s{i % 7 if i % 3 else 0}") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    by = {}
    for x in got:
        t = by.setdefault(x["source"], [x["target"], 0, x["source_size"]])
        t[1] += x["taken"]
    assert math.isclose(sum(t[0] for t in by.values()), 1.5 * sum(t[2] for t in by.values()))
    assert all(abs(t[0] - t[1]) <= 61 and t[0] <= 2 * t[2] + 1e-6 for t in by.values())
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(d.repartition(5)).collect()))


def test_packing(spark, docs, empty):
    got = packing.pack(docs).collect()
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    enc = packing.encoder(packing.tokenizer_path())
    total = sum(len(enc.defined(t or "")) // 4 + 1 if t else 1 for _, t, _ in DOCS)
    assert sum(r["length"] for r in got) == total and len(held) == -(-total // 1024)
    one = np.r_[np.frombuffer(enc.defined("a b c d e f"), "<u4"), 2].astype("<u4").tobytes()
    assert {r["ids_crc32"] for r in got if r["doc_id"] in (1, 2)} == {zlib.crc32(one)}
    assert packing.pack(empty).count() == 0


def test_best_fit_is_near_best_fit_decreasing(spark):
    """Every document once, gapless, and as few sequences as best fit decreasing but for one in a hundred."""
    r = random.Random(3)
    sizes = [r.randint(30, 100) for _ in range(2000)] + [1] * 400
    counts = spark.createDataFrame([(s, sizes.count(s)) for s in sorted(set(sizes))], "length long, n long")
    held, seen = {}, {}
    for x in packing.best_fit(counts, 100).collect():
        seen.setdefault(x["length"], []).extend(range(x["first"], x["first"] + x["n"]))
        for i in range(x["n"]):
            held.setdefault(x["sequence"] + i // x["per"], []).append((x["offset"] + i % x["per"] * x["length"], x["length"]))
    assert {s: sorted(v) for s, v in seen.items()} == {s: list(range(sizes.count(s))) for s in set(sizes)}
    for parts in held.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 100
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(100 - s)
    assert len(held) <= 1.01 * len(gaps) + 1


def test_texts_without_ends_of_words():
    enc = packing.encoder(packing.tokenizer_path())
    for t in (" " * 1_200_000 + "x", "ab" * 20_000 + " c", "\n" * 1_200_000, "a b " * 9000):
        assert enc.encode(t) == enc.defined(t)


def test_same_ids_by_both_libraries():
    enc, r = packing.encoder(packing.tokenizer_path()), random.Random(4)
    letters = [chr(i) for i in [*range(0x1C), *range(32, 128), *range(0xA1, 0x250)]] + [" "] * 40 + ["\n"] * 9
    for t in ["<|endoftext|>", "don't  x", "a\x1cb", "漢字", *("".join(r.choices(letters, k=50)) for _ in range(500))]:
        assert enc.encode(t) == enc.defined(t)


def test_nearest(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(400, 16)).astype(np.float32)
    v[50:60] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {}
    for x in ann.nearest(df, F.col("vec_id") % 20 == 0, 10).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    assert set(got) == set(range(0, 400, 20))
    w, hits = v.astype(np.float64), 0
    for q, found in got.items():
        s = w @ w[q]
        want = [i for i in sorted(range(400), key=lambda i: (-s[i], i)) if i != q][:10]
        found.sort()
        assert [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        hits += len({f[1] for f in found} & set(want))
    assert hits / (10 * len(got)) >= 0.9
    assert ann.nearest(df.filter("false"), F.lit(True)).count() == 0
    assert ann.nearest(df.filter("vec_id = 1001"), F.lit(True)).count() == 0


@pytest.mark.parametrize("kind", ["clusters", "no structure", "one cell has a third"])
def test_nearest_over_many_cells(spark, monkeypatch, kind):
    """Recall against brute force where the index has dozens of cells, most of them looked into or few."""
    monkeypatch.setattr(ann, "CELL_ROWS", 64)
    monkeypatch.setattr(ann, "CELL_QUERIES", 40)
    r, d = np.random.default_rng(6), 48
    v = r.normal(size=(2400, d))
    if kind != "no structure":
        v = 0.6 * v / np.sqrt(d) + (c := r.normal(size=(30, d)) / np.sqrt(d))[r.integers(0, 30, 2400)]
    if kind == "one cell has a third":
        v[:800] = c[0] + 1e-3 * r.normal(size=(800, d))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, 10).toPandas()
    hits = 0
    for q, rows in got.groupby("query_id"):
        s = v @ v[q]
        hits += len(set(rows["vec_id"]) & set([i for i in sorted(range(len(v)), key=lambda i: (-s[i], i)) if i != q][:10]))
    assert len(got) == 1200 and hits / 1200 >= 0.97


def test_toxicity(spark, docs, empty):
    rows = [(i, ("good words here " + str(i % 9)) if i % 2 else "you utter moron " + str(i % 7), "s") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bad = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.train(d, bad)
    got = toxicity.toxicity(docs.union(docs.limit(0)), model).select("doc_id", "text", "toxicity").collect()
    assert len(got) == len(DOCS) and all(0 <= r["toxicity"] <= 1 for r in got)
    assert toxicity.score("what a moron", *model) > 0.5 > toxicity.score("good words", *model)
    assert toxicity.score("x" * 200_000 + " you utter moron", *model) > 0.5
    assert 0 <= toxicity.score(None, *toxicity.train(d, labels(spark))) <= 1 and toxicity.toxicity(empty, model).count() == 0


def test_quality(spark, docs, empty):
    texts = [(b"plain words of text " * 20 if i % 2 else b"a| b| c| d| " * 20) for i in range(120)]
    net = quality.Net().fit(texts, np.array([i % 2 for i in range(120)], float), epochs=4)
    assert net.score(texts[1]) > 0.7 > net.score(texts[0])
    got = quality.quality(docs, net).collect()
    assert len(got) == len(DOCS) and all(0 <= r["quality"] <= 1 for r in got)
    data = bytes(random.Random(6).choices(range(32, 120), k=300_000))
    whole = net.pooled(data).max(axis=0)
    e = net.p["e"][np.frombuffer(data, np.uint8)]
    plain = max((e[i : i + 8].ravel() @ net.p["w"] + net.p["c"])[0] for i in range(0, len(data) - 7, 4))
    assert math.isclose(whole[0], max(plain, 0), rel_tol=1e-4)
    assert quality.quality(empty, quality.train(empty, labels(spark, 4))).count() == 0


def test_lattice_sums_all_segmentations():
    model = lm.Lattice(lm.vocabulary_path(), {})

    def brute(s):
        if not s:
            return 1.0
        out = 10 ** sum(model.byte[b] for b in s[0].encode()) * brute(s[1:])
        for n in range(1, len(s) + 1):
            lp = model.table.get(s[:n])
            if lp is not None:
                out += 10**lp * brute(s[n:])
        return out

    for w in ("the", "thing", "über", "漢"):
        assert math.isclose(10 ** model.word(w), brute("▁" + w), rel_tol=1e-9)


def test_lattice_of_long_words():
    """Segmentations with a piece across any place count, however long the word."""
    model = lm.Lattice(lm.vocabulary_path(), {})
    for unit in ("thing", "漢字です", "ab🜚"):
        s = "▁" + unit * 2000
        into = [[] for _ in range(len(s) + 1)]
        into[0] = [0.0]
        for i in range(len(s)):
            alpha = np.logaddexp.reduce(np.array(into[i]) * math.log(10)) / math.log(10)
            into[i + 1].append(alpha + sum(model.byte[b] for b in s[i].encode()))
            for j in range(i + 1, min(len(s), i + 20) + 1):
                if model.table.get(s[i:j]) is not None:
                    into[j].append(alpha + model.table[s[i:j]])
        assert math.isclose(model.word(s[1:]), np.logaddexp.reduce(np.array(into[-1]) * math.log(10)) / math.log(10), rel_tol=1e-12)


def test_pieces_of_long_words(spark, monkeypatch):
    sp, r = lm.vocabulary(lm.vocabulary_path()), random.Random(8)
    kinds = ["a", "ab", "=-", "abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", "thequickand", "日本語の漢字仮名交じり文🜚🜛\u3000", "▁ab", "🜚🜛é", "\x01a"]
    words = ["".join(r.choices(k, k=n)) for k in kinds for n in (40, 41, 99, 5000)] + ["international" * 400, "\u3000".join(["言葉"] * 2000)]
    for w in words:
        assert [i for ids in lm.pieces_of(sp, w, 40) for i in ids] == sp.encode(w)
    monkeypatch.setattr(lm, "WINDOW", 4500)
    want = {}
    for c, w in enumerate(words):
        for i in sp.encode(w):
            want[i] = want.get(i, 0) + c
    counted = spark.createDataFrame(list(zip(words, range(len(words)), strict=True)), "word string, c long")
    assert lm.piece_counts(counted, lm.vocabulary_path()) == {i: n for i, n in want.items() if n}


def plain_lattice(model, word):
    """log10 of the sum over all segmentations, place by place over the whole word."""
    s, ten = "▁" + word, math.log(10)
    into = [[] for _ in range(len(s) + 1)]
    into[0] = [0.0]
    for i in range(len(s)):
        alpha = np.logaddexp.reduce(np.array(into[i]) * ten) / ten
        into[i + 1].append(alpha + sum(model.byte[b] for b in s[i].encode()))
        for j in range(i + 1, min(len(s), i + 20) + 1):
            if model.table.get(s[i:j]) is not None:
                into[j].append(alpha + model.table[s[i:j]])
    return np.logaddexp.reduce(np.array(into[-1]) * ten) / ten


def test_language_model(spark, docs, empty, monkeypatch):
    long_word = "abc" * 3334
    rows = [*DOCS, (20, f"a {long_word} a word", "s0"), (21, f"{long_word} b", "s1")]
    more = spark.createDataFrame([(*d, 1, "f", 2, "p", 3) for d in rows], SCHEMA).repartition(3)
    train = [t or "" for i, t, _ in rows if i not in (None, 1, 20)]
    counts = {}
    for t in train:
        for w in t.encode().lower().split():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    sp = lm.vocabulary(lm.vocabulary_path())
    pieces = {sp.eos_id(): len(train)}
    for w, c in counts.items():
        for i in sp.encode(w.decode()):
            pieces[i] = pieces.get(i, 0) + c
    model, spelt = lm.Lattice(lm.vocabulary_path(), pieces), {}
    for common in (200_000, 2, 0):
        monkeypatch.setattr(lm, "COMMON", common)
        got = lm.score_texts(more, ~F.col("doc_id").isin(1, 20)).collect()
        assert len(got) == len(rows)
        texts = {i: t for i, t, _ in rows}
        for r in got:
            words = (texts[r["doc_id"]] or "").encode().lower().split()
            want = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words) + math.log10((len(train) + 1) / (n + v + 1))
            assert math.isclose(r["base_score"], want) and r["n_tokens"] == len(words) + 1 and r["train_tokens"] == n
            score = math.log10((len(train) + v * 10**model.end) / (n + v))
            for w in words:
                lattice = spelt[w] = spelt.get(w) or plain_lattice(model, w.decode())
                score += (math.log10(counts[w] + v * 10**lattice) if w in counts else math.log10(v) + lattice) - math.log10(n + v)
            assert math.isclose(r["score"], score, rel_tol=1e-9)
    assert lm.score_texts(empty, F.lit(True)).count() == 0
    assert {r["score"] for r in lm.score_texts(docs.filter("text = ''"), F.lit(False)).collect()} == {lm.Lattice(lm.vocabulary_path(), {}).end}


def test_words_and_end_sum_to_one():
    model = lm.Lattice(lm.vocabulary_path(), {5: 10, 900: 7})
    first = sum(10**lp for p, lp in model.table.items() if lp is not None and p.startswith("▁"))
    rest = sum(10**lp for p, lp in model.table.items() if lp is not None and not p.startswith("▁")) + sum(10**lp for lp in model.byte)
    assert math.isclose(10**model.end + first / (1 - rest), 1, rel_tol=1e-6)


def test_jpeg_payload(spark, docs, empty):
    for t in (None, "é\x00x" * 5000, "a" * 600_000):
        n, data = jpeg.padded(t)
        media = jpeg.store(data)
        assert b"".join(map(jpeg.payload, jpeg.images(media))) == data and len(data) % 64 == 0 and n <= len(data)
    got = jpeg.read_back(jpeg.to_media(docs)).collect()
    assert len(got) == len(DOCS) and len({r["media_sha256"] for r in got if r["doc_id"] in (3, 4)}) == 1
    assert jpeg.read_back(jpeg.to_media(empty)).count() == 0
    blocks = [-(-max(1, len((t or "").encode())) // 64) for _, t, _ in DOCS]
    shapes = sorted((r["height"], r["width"], len(r["rgb"])) for r in jpeg.tensors(jpeg.to_media(docs)).collect())
    assert shapes == sorted((8, 16 * -(-n // 4), 24 * 16 * -(-n // 4)) for b in blocks for n in [min(jpeg.BLOCKS, b - i) for i in range(0, b, jpeg.BLOCKS)])
    lost = jpeg.read_back(jpeg.to_media(docs).withColumn("media", F.lit(None).cast("binary"))).collect()
    assert len(lost) == len(DOCS) and all(r["payload_sha256"] is None and r["payload_bytes"] is None for r in lost)
    with pytest.raises(ValueError):
        jpeg.describe(jpeg.store(bytes(640))[:-40])


def test_jpeg_chroma_is_upsampled():
    """Each chroma sample of a stored image covers two columns, as a plain inverse transform has it."""
    data = np.random.default_rng(3).integers(0, 256, (8, 64)).astype(np.uint8)
    image = jpeg.Image(jpeg.store(data.tobytes()))
    planes = []
    for part in (data[:4], data[4:6], data[6:]):
        f = np.zeros((len(part), 64))
        f[:, jpeg.ZIGZAG] = part.astype(float) + 256
        u = np.arange(8)
        c = np.cos((2 * u[None] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, 0.5**0.5, 1)[:, None] / 2
        planes.append(np.concatenate([np.clip(np.rint(c.T @ x.reshape(8, 8) @ c + 128), 0, 255) for x in f], axis=1))
    y, cb, cr = planes[0], planes[1].repeat(2, 1) - 128, planes[2].repeat(2, 1) - 128
    want = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
    assert np.abs(np.clip(np.rint(want), 0, 255) - image.rgb().astype(int)).max() <= 3


def encode_general(planes, h, v):
    """A slow, plain progressive encoder with subsampled chroma: DC in two passes interleaved, AC in
    two bands with one bit left to a refinement. ``planes``: coefficient blocks by component."""
    bits = []
    put = lambda value, n: bits.extend((value >> i) & 1 for i in range(n - 1, -1, -1))

    def done():
        out = jpeg._coded(np.array(bits, np.uint8)) if bits else b""
        bits.clear()
        return out

    # every symbol has an eight-bit code, but for the last, kept free
    symbols = bytes([0, *range(1, 11), *(r << 4 | s for r in range(16) for s in range(11) if r)])
    book = lambda t: bytes([t, 0, 0, 0, 0, 0, 0, 0, len(symbols), *[0] * 8]) + symbols
    code = {s: i for i, s in enumerate(symbols)}

    def number(x):
        n = abs(x).bit_length()
        put(x if x > 0 else x + (1 << n) - 1, n) if n else None

    high, wide = 8 * v * planes[0].shape[0] // v, 8 * planes[0].shape[1]
    frame = jpeg.struct.pack(">BHHB", 8, high, wide, 3) + bytes([1, h << 4 | v, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", jpeg._marker(0xDB, b"\x00" + bytes([3] * 64)), jpeg._marker(0xC2, frame), jpeg._marker(0xC4, book(0) + book(0x10))]
    my, mx = planes[1].shape[:2]
    order = [(c, y, x) for a in range(my) for b in range(mx) for c in range(3) for y, x in ([(a * v + i, b * h + j) for i in range(v) for j in range(h)] if not c else [(a, b)])]
    for refine in (0, 1):
        out.append(jpeg._marker(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0x10 if refine else 0x01])))
        last = [0, 0, 0]
        for c, y, x in order:
            d = int(planes[c][y, x, 0])
            if refine:
                put(d & 1, 1)
            else:
                diff = (d >> 1) - last[c]
                last[c] = d >> 1
                put(code[abs(diff).bit_length()], 8)
                number(diff)
        out.append(done())
    cut = lambda x: int(x) >> 1 if x >= 0 else -(-int(x) >> 1)
    for c in range(3):
        for ss, se in ((1, 5), (6, 63)):
            out.append(jpeg._marker(0xDA, bytes([1, c + 1, 0, ss, se, 0x01])))
            for block in planes[c].reshape(-1, 64):
                run = 0
                for k in range(ss, se + 1):
                    x = cut(block[k])
                    if not x:
                        run += 1
                        continue
                    while run > 15:
                        put(code[0xF0], 8)
                        run -= 16
                    put(code[run << 4 | abs(x).bit_length()], 8)
                    number(x)
                    run = 0
                if run:
                    put(code[0], 8)
            out.append(done())
        out.append(jpeg._marker(0xDA, bytes([1, c + 1, 0, 1, 63, 0x10])))
        for block in planes[c].reshape(-1, 64):
            run, held = 0, []
            new = [k for k in range(1, 64) if abs(block[k]) == 1]
            for k in range(1, 64):
                x = int(block[k])
                if cut(x):
                    held.append(abs(x) & 1)
                elif x:
                    put(code[run << 4 | 1], 8)
                    put(x > 0, 1)
                    bits.extend(held)
                    run, held = 0, []
                else:
                    run += 1
                    if run == 16 and new and k < new[-1]:
                        put(code[0xF0], 8)
                        bits.extend(held)
                        run, held = 0, []
            if run or held:
                put(code[0], 8)
                bits.extend(held)
        out.append(done())
    return b"".join(out) + b"\xff\xd9"


def test_jpeg_general():
    r = np.random.default_rng(7)

    def blocks(y, x):
        c = (r.normal(0, 3, (y, x, 64)) * (r.random((y, x, 64)) < 0.3)).round().astype(int)
        c[..., 0] = r.integers(-40, 40, (y, x))
        return c

    planes = [blocks(4, 6), blocks(2, 3), blocks(2, 3)]
    image = jpeg.Image(encode_general(planes, 2, 2))
    for want, got in zip(planes, image.coefficients, strict=True):
        assert np.array_equal(want.reshape(-1, 64), got)
    rgb = image.rgb()
    assert rgb.shape == (32, 48, 3)
    full = []
    for p, times in zip(planes, (1, 2, 2), strict=True):
        grid = np.zeros((8 * p.shape[0], 8 * p.shape[1]))
        for y, x in np.ndindex(*p.shape[:2]):
            f = np.zeros(64)
            f[jpeg.ZIGZAG] = p[y, x] * 3
            for i, j in np.ndindex(8, 8):
                grid[8 * y + i, 8 * x + j] = sum(
                    f[8 * a + b] * (1 if a else 0.5**0.5) * (1 if b else 0.5**0.5) / 4 * math.cos((2 * i + 1) * a * math.pi / 16) * math.cos((2 * j + 1) * b * math.pi / 16)
                    for a in range(8) for b in range(8) if f[8 * a + b]
                )
        full.append(np.clip(np.rint(grid + 128), 0, 255).repeat(times, 0).repeat(times, 1))
    red = np.clip(np.rint(full[0] + 1.402 * (full[2] - 128)), 0, 255)
    assert np.abs(red - rgb[:, :, 0]).max() <= 2


def brute_chat(roles):
    best = {0: 0}
    for r in roles:
        new = {}
        for s, c in best.items():
            for o in chat.steps(r)[s]:
                new[o.to] = min(new.get(o.to, 99999), c + o.cost)
        best = new
    return min(c + 3 * len(chat.ENDING[s]) for s, c in best.items() if s)


def test_chat(spark, empty, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 3)
    r = random.Random(8)
    rows = [(i, t, r.choice(["user", "assistant", "system", None, "bot", " User"]), f"t{t}") for i in range(40) for t in range(r.choice([1, 2, 5, 14]))]
    rows += [(100, 0, "user", None), (100, 0, "user", None), (None, 1, "assistant", ""), (101, None, "user", "x")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    parts = {}
    for x in got.collect():
        parts.setdefault(x["conv_id"], []).append(x)
    for conv, xs in parts.items():
        xs.sort(key=lambda x: x["pos"])
        assert sum(x["cost"] for x in xs) == brute_chat([chat.number(x["role"]) for x in xs])
        said = [p.split("\n", 1)[0] for p in "".join(x["rendered"] for x in xs).split("<|im_start|>")[1:]]
        state = 0
        for role in said:
            assert (state, chat.ROLES.index(role)) in chat.LEGAL
            state = chat.ROLES.index(role)
        assert state == chat.ASSISTANT
    assert sum(map(len, parts.values())) == len(rows)
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(turns).count() == 0


def test_an_id_repeated_beyond_the_sample_leaves_the_others(spark):
    from loomwright.llm.common import labelled, steps_within

    rows = [(7, "hot")] * 500 + [(i, f"text {i}") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(7, 1), *((i, i % 2) for i in range(100, 160))], "doc_id long, toxic int")
    got = labelled(docs, marks, "toxic", F.lit(True), 100)
    assert {r["doc_id"] for r in got.collect()} == set(range(100, 160)) and got.rdd.getNumPartitions() == 1
    assert steps_within({3: 5, 2: 100, 1: 6, 0: 1}, 12) == [3, 1, 0] and steps_within({}, 5) == []
    assert labelled(docs.limit(0), marks, "toxic", F.lit(True), 100).count() == 0
