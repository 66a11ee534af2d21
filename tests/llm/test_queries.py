"""The registered queries against plain versions over whole small tables."""

import hashlib
import math
import os
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomwright.llm import ann, chat, jpeg, lm, packing
from loomwright.llm.queries import QUERIES
from test_operators import brute_print, plain_lattice

DATA, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(MORE), reason="no tables")


def table(name, folder=DATA):
    return pd.read_parquet(f"{folder}/{name}.parquet")


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def nearest(v, ids, asked, k):
    s = v @ v[asked].T
    return {ids[a]: [(ids[j], s[j, n]) for j in sorted(range(len(v)), key=lambda j: (-s[j, n], ids[j])) if j != a][:k] for n, a in enumerate(asked)}


def test_op1_finds_the_nearest(spark):
    t = table("embeddings", MORE)
    v, ids = np.stack(t["embedding"]).astype(float), t["vec_id"].tolist()
    want = nearest(v, ids, [i for i, x in enumerate(ids) if x % 20 == 0], 20)
    got = QUERIES["op1_nearest_codes"](spark, MORE).toPandas()
    hits, where = 0, dict(zip(ids, v))
    for q, rows in got.groupby("query_id"):
        rows = rows.sort_values("rank")
        assert rows["rank"].tolist() == list(range(1, 21)) and q not in set(rows["vec_id"])
        assert list(zip(-rows["score"], rows["vec_id"])) == sorted(zip(-rows["score"], rows["vec_id"]))
        assert all(math.isclose(s, float(where[q] @ where[i]), abs_tol=1e-9) for s, i in zip(rows["score"], rows["vec_id"]))
        hits += len(set(rows["vec_id"]) & {i for i, _ in want[q]})
    assert set(got["query_id"]) == set(want) and hits / (20 * len(want)) >= 0.95


@pytest.mark.parametrize("rows", [16, 64])
def test_op1_over_many_cells_of_the_given_table(spark, monkeypatch, rows):
    monkeypatch.setattr(ann, "CELL_ROWS", rows)
    t = table("embeddings", MORE)
    v, ids = np.stack(t["embedding"]).astype(float), t["vec_id"].tolist()
    want = nearest(v, ids, [i for i, x in enumerate(ids) if x % 20 == 0], 20)
    got = QUERIES["op1_nearest_codes"](spark, MORE).toPandas().groupby("query_id")["vec_id"].agg(set)
    assert sum(len(got[q] & {i for i, _ in near}) for q, near in want.items()) >= 0.95 * 20 * len(want)


def test_op1_ties_repeats_and_names(spark):
    v = [[1.0, 0.0]] * 6 + [[0.0, 1.0]] * 3 + [[1.0, 1.0]]
    d = spark.createDataFrame([(i, x, "c", 1) for i, x in enumerate(v)] + [(3, v[3], "c", 1)], "vec_id long, embedding array<double>, code string, block int")
    got = ann.nearest(d, F.col("vec_id") == 0, 4).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] in ([(1, 1.0), (2, 1.0), (3, 1.0), (3, 1.0)], [(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)])


def area(score, y):
    r = pd.Series(score).rank()
    p = y == 1
    return (r[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


@pytest.mark.parametrize("name, label, n, k, cut", [("op2_toxicity", "toxic", 5, 0, 0.5), ("op4_quality", "quality", 4, 2, 0.7)])
def test_classifiers_learn_from_their_folds_alone(spark, tmp_path, name, label, n, k, cut):
    """Held-out rows are told apart; turning their labels over changes no score."""
    labels, docs = table("labels", MORE), table("documents", MORE)
    got = QUERIES[name](spark, MORE).toPandas().sort_values("doc_id", ignore_index=True)
    assert got["doc_id"].tolist() == sorted(docs["doc_id"]) and got["score"].between(0, 1).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: fold(i, n) == k)).all() and (got["predicted"] == (got["score"] >= cut)).all()
    both = got.merge(labels, on="doc_id")
    held = both[both["held_out"]].reset_index(drop=True)
    assert area(held["score"], held[label]) > 0.8  # under 400 labels, of which one in eight is toxic
    turned = labels.copy()
    out = turned["doc_id"].map(lambda i: fold(i, n) == k)
    turned.loc[out, label] = 1 - turned.loc[out, label]
    docs.sample(frac=1, random_state=1).to_parquet(f"{tmp_path}/documents.parquet")
    turned.to_parquet(f"{tmp_path}/labels.parquet")
    again = QUERIES[name](spark, str(tmp_path)).toPandas().sort_values("doc_id", ignore_index=True)
    assert np.abs(again["score"] - got["score"]).max() < 1e-6


def least_repair(roles):
    """The least cost of turning roles into [system] (user assistant)+, tried over every such sequence:
    each of its messages is empty, at 3, or holds some turns that follow each other, each beyond the
    first at 1 and each of another role at 2."""
    n, best = len(roles), math.inf
    for head in ([], ["system"]):
        for pairs in range(1, n + 2):
            target = head + ["user", "assistant"] * pairs
            cost = [0] + [math.inf] * n
            for role in target:
                new = [c + 3 for c in cost]
                for i in range(1, n + 1):
                    for j in range(i):
                        new[i] = min(new[i], cost[j] + (i - j - 1) + sum(2 for r in roles[j:i] if r != role))
                cost = new
            best = min(best, cost[n])
    return best


def test_op3_repairs_at_least_cost(spark):
    turns = table("conversations")
    got = QUERIES["op3_chat_repair"](spark, DATA).toPandas()
    assert len(got) == len(turns)
    for conv, rows in turns.sort_values("turn").groupby("conv_id"):
        mine = got[got["conv_id"] == conv].sort_values("pos")
        roles = [(r or "").strip().lower() for r in rows["role"]]
        if len(roles) <= 14:
            assert mine["cost"].sum() == least_repair(roles), roles
        said = [p.split("\n", 1)[0] for p in "".join(mine["rendered"]).split("<|im_start|>")[1:]]
        body = said[1:] if said[0] == "system" else said
        assert len(body) >= 2 and body == ["user", "assistant"] * (len(body) // 2)
        assert all(t in "".join(mine["rendered"]) for t in rows["text"] if t)
    odd = [["assistant"], ["system", "system"], ["user", "user", "x"], ["assistant", "user"], ["x", "assistant", "system", "user", "user", "assistant", "assistant"]]
    d = spark.createDataFrame([(i, k, r, "t") for i, rs in enumerate(odd) for k, r in enumerate(rs)], "conv_id long, turn long, role string, text string")
    costs = {r["conv_id"]: r["c"] for r in chat.format_chats(d).groupBy("conv_id").agg(F.sum("cost").alias("c")).collect()}
    assert costs == {i: least_repair(rs) for i, rs in enumerate(odd)}


def test_op5_components(spark):
    docs = table("documents")
    fp = {i: brute_print(t or "") for i, t in zip(docs["doc_id"], docs["text"])}
    got = {r["doc_id"]: r for r in QUERIES["op5_simhash"](spark, DATA).collect()}
    parent = {i: i for i in fp}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    items = sorted(fp.items())
    for n, (a, fa) in enumerate(items):
        for b, fb in items[n + 1 :]:
            if (fa ^ fb).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{f:016x}", root(i)) for i, f in fp.items()}


def test_op6_scores(spark):
    docs = table("documents")
    counts, n = {}, 0
    for i, t in zip(docs["doc_id"], docs["text"]):
        if fold(i, 7) != 2:
            for w in [*(t or "").encode().lower().split(), b""]:
                counts[w], n = counts.get(w, 0) + 1, n + 1
    v = len(counts)
    sp, pieces = lm.vocabulary(lm.vocabulary_path()), {}
    for w, c in counts.items():
        for p in sp.encode(w.decode()) if w else [sp.eos_id()]:
            pieces[p] = pieces.get(p, 0) + c
    model, known = lm.Lattice(lm.vocabulary_path(), pieces), {}

    def logp(w):
        if w not in known:
            lattice = plain_lattice(model, w.decode()) if w else model.end
            known[w] = (math.log10(counts[w] + v * 10**lattice) if w in counts else math.log10(v) + lattice) - math.log10(n + v)
        return known[w]

    @lru_cache(None)
    def alone(w):
        return plain_lattice(model, w.decode()) if w else model.end

    texts = dict(zip(docs["doc_id"], docs["text"]))
    got = QUERIES["op6_subword_lm"](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        words = [*(texts[r["doc_id"]] or "").encode().lower().split(), b""]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(words), sum(w in counts for w in words), n, fold(r["doc_id"], 7) == 2)
        assert math.isclose(r["base_score"], sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(map(logp, words)), rel_tol=1e-9)
        assert math.isclose(r["lattice_score"], sum(map(alone, words)), rel_tol=1e-9)
        assert r["score"] > r["lattice_score"] or r["n_known"] < len(words)  # known words are likelier than their spelling


def test_op7_reads_back(spark):
    docs = table("documents")
    texts = dict(zip(docs["doc_id"], docs["text"]))
    got = QUERIES["op7_progressive_jpeg"](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        data = raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        media = jpeg.store(data)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())


def test_op8_pieces_and_places(spark):
    docs = table("documents")
    enc = packing.encoder(packing.tokenizer_path())
    got = QUERIES["op8_best_fit_packing"](spark, DATA).toPandas()
    want, total = {}, 0
    for i, t in zip(docs["doc_id"], docs["text"]):
        ids = np.r_[np.frombuffer(enc.defined(t), "<u4") if t else [], 2].astype("<u4")
        total += len(ids)
        first = len(ids) % 1024
        cuts = ([0] if first else []) + list(range(first, len(ids), 1024)) + [len(ids)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
            want[i, k] = (a, z - a, zlib.crc32(ids[a:z].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        ends = rows["offset"] + rows["length"]
        assert rows["offset"].tolist() == [0, *ends[:-1]] and ends.iloc[-1] <= 1024
    assert got["sequence_id"].nunique() <= 1.03 * -(-total // 1024) + 1


