"""BM25 over blocks against a plain ranking of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomwright.operators import impact


def plain(docs, asked, k):
    tf = {i: Counter(re.findall("[a-z0-9]+", (t or "").lower())) for i, t in docs}
    n, mean = len(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)
    df = Counter(w for c in tf.values() for w in c)
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    idf = {w: 0.25 * sum(raw.values()) / len(raw) if r < 0 else r for w, r in raw.items()}
    out = []
    for q, text in asked:
        words = Counter(w for w in re.findall("[a-z0-9]+", (text or "").lower()) if w in idf)
        scores = {}
        for i, c in tf.items():
            if any(w in c for w in words):
                scores[i] = round(sum(m * idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, m in words.items() if w in c), 6)
        out += [(q, i, s, r + 1) for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


def made(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, docs[5][1]), (n + 3, docs[5][1].upper())]


def got(df, *by):
    return sorted((*(r[c] for c in by), r["query_id"], r["chunk_id"], round(r["score"], 6), r["rank"]) for r in df.collect())


def near(a, b):
    return len(a) == len(b) and all(x[:2] == y[:2] and x[3] == y[3] and abs(x[2] - y[2]) < 2e-6 for x, y in zip(a, b))


@pytest.mark.parametrize("block", [7, 100, impact.BLOCK])
@pytest.mark.parametrize("k", [1, 10, 1000])
def test_ranking_is_that_of_all_pairs(spark, block, k):
    docs = made(300)
    asked = [(i, " ".join(t.split()[:14])) for i, t in docs[:20] if t] + [(900, "w1 w1 w1 absent"), (901, None), (902, "absent"), (903, docs[5][1])]
    chunks, questions = spark.createDataFrame(docs, "chunk_id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, text string")
    assert near(got(impact.bm25(chunks, questions, k, block=block)), plain(docs, asked, k))


def test_words_that_most_have_may_lower_scores(spark):
    """In a small vocabulary the mean is negative, so that common words lower what has them."""
    docs = [(i, "a b" if i % 4 else "a b c") for i in range(40)]
    asked = [(1, "a c"), (2, "a b")]
    for block in (3, 100):
        chunks, questions = spark.createDataFrame(docs, "chunk_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
        assert near(got(impact.bm25(chunks, questions, 5, block=block)), plain(docs, asked, 5))


def test_groups_rank_by_themselves(spark):
    docs = [(i, t, None if i % 50 == 0 else "xyz"[i % 3]) for i, t in made(150)]
    asked = [(q, "w1 w2 w7 w30") for q in (1, 2)]
    chunks = spark.createDataFrame(docs, "chunk_id long, text string, g string")
    rows = got(impact.bm25(chunks, spark.createDataFrame(asked, "query_id long, text string"), 4, by=("g",), block=11), "g")
    for g in "xyz":
        assert near([r[1:] for r in rows if r[0] == g], plain([(i, t) for i, t, h in docs if h == g], asked, 4))
    assert {r[0] for r in rows} == set("xyz")


def test_questions_in_parts_and_no_rows(spark, monkeypatch):
    docs, asked = made(80), [(f"q{i}", f"w{i} w1 w2") for i in range(12)]
    chunks, questions = spark.createDataFrame([(str(i), t) for i, t in docs], "chunk_id string, text string"), spark.createDataFrame(asked, "query_id string, text string")
    whole = got(impact.bm25(chunks, questions, 3))
    monkeypatch.setattr(impact, "ASKED", 5)
    assert whole and got(impact.bm25(chunks, questions, 3, block=20)) == whole
    assert got(impact.bm25(chunks.limit(0), questions, 3)) == got(impact.bm25(chunks, questions.limit(0), 3)) == []


def test_words_of_a_batch_are_those_of_each_text():
    texts = ["", None, "a", "b", "Ab-9c", "\u0130st \u212aelvin \u0130", "caf\u00e9 na\u00efve \u65e5x", "  end", "x" * 5000, "", "Z"]
    for some in (pa.array(texts, pa.string()), pa.array(["no", *texts, "no"], pa.string()).slice(1, len(texts)), pa.array(["", None], pa.string()), pa.array([], pa.string())):
        row, word = impact.words_of(some)
        assert list(zip(row.tolist(), word.to_pylist())) == [(i, w) for i, t in enumerate(some.to_pylist()) for w in re.findall("[a-z0-9]+", (t or "").lower())]


def test_few_documents_are_scored():
    """A question with rare words: most documents of a block are never scored to the end."""
    rng = np.random.default_rng(2)
    n = 4000
    rows = [(d, t, x) for t, share in (("common", 0.9), ("often", 0.5), ("some", 0.2), ("rare", 0.01), ("rarest", 0.006)) for d, x in enumerate(rng.random(n)) if rng.random() < share]
    left = pa.table({"chunk_id": [r[0] for r in rows], "term": [r[1] for r in rows], "impact": [0.5 + r[2] for r in rows]})
    right = pa.table({"query_id": [1] * 5, "term": ["common", "often", "some", "rare", "rarest"], "weight": [0.05, 0.2, 1.2, 4.6, 5.1]})
    (_, found, scores, scored), = impact.ranked_block(left, right, 10)
    brute = np.zeros(n)
    for d, t, x in rows:
        brute[d] += (0.5 + x) * dict(zip(right["term"].to_pylist(), right["weight"].to_pylist()))[t]
    assert scored < n / 50
    best = sorted(zip(-scores, found.to_pylist()))[:10]
    assert np.allclose([-s for s, _ in best], np.sort(brute)[::-1][:10])


def test_distractors_are_chunks_that_were_not_found(spark):
    from loomwright.operators.evaluation import annotation_kit

    chunks = spark.createDataFrame([(i,) for i in range(0, 24, 2)], "chunk_id long")
    ranking = [(q, 2 * i, i + 1) for q, n in ((1, 1), (2, 11), (3, 12), (4, 6)) for i in range(n)]
    got = annotation_kit(spark.createDataFrame(ranking, "query_id long, chunk_id long, rank int"), chunks).collect()
    assert sorted((r["query_id"], r["chunk_id"]) for r in got if not r["distractor"]) == [(q, 0) for q in (1, 2, 3, 4)]
    drawn = {r["query_id"]: r["chunk_id"] for r in got if r["distractor"]}
    assert set(drawn) == {1, 2, 4} and drawn[2] == 22 and not {(q, c) for q, c, _ in ranking} & set(drawn.items())


def counting(spark, monkeypatch):
    """The function that counts the words of batches in tasks."""
    seen = []

    class Rows:
        def mapInArrow(self, f, kinds):  # noqa: N802
            seen.append(f)

    monkeypatch.setattr(impact, "spread", lambda rows: Rows())
    impact.postings(spark.createDataFrame([], "chunk_id long, text string"))
    return seen[0]


def test_memory_does_not_grow_with_a_batch(spark, monkeypatch):
    """A batch of 10,000 texts, which larger tables fill, takes no more than its pieces do."""
    import tracemalloc

    of, text = counting(spark, monkeypatch), " ".join(f"w{i * i % 997}" for i in range(500))
    batch = pa.RecordBatch.from_pydict({"chunk_id": list(range(10_000)), "text": [text] * 10_000})
    tracemalloc.start()
    rows = sum(len(out) for out in of(iter([batch])))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert rows == 10_000 * len(set(text.split())) and peak < 40 << 20


def test_pieces_count_as_whole_batches(spark, monkeypatch):
    texts = ["", None, "a b a", "long " * 50, "", None, "c" * 90, "a"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(["no", *texts, "no"])], ["chunk_id", "text"]).slice(1, 8)
    of = counting(spark, monkeypatch)
    whole = [r for out in of(iter([batch])) for r in out.to_pylist()]
    monkeypatch.setattr(impact, "TEXTS", 10)
    some = [r for out in of(iter([batch])) for r in out.to_pylist()]
    key = lambda r: (r["chunk_id"], r["term"] or "")
    assert len({r["chunk_id"] for r in some}) == 8 and sorted(whole, key=key) == sorted(some, key=key)
