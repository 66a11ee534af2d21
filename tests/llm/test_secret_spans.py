"""Secret spans: the patterns and their digests against plain loops, the field against brute force."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from loomwright.llm import secret_spans as S
from loomwright.llm.queries import QUERIES
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"
SECRET = "9f8e7d6c5b4a39281706f5e4d3c2b1a09f8e7d6c"
PROSE = "the quick brown fox, and a number 12345 or two. " * 6


def plain_base(text):
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    assign = re.sub(r"\((p.*?)\)", lambda m: "(" + re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1]) + ")", assign, count=1)
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(s, e, k) for s, _, e, k in sorted(found)]


TEXTS = [
    "token: token:abcdefgh", "TOKEN='abc.def=='", "api_key=short api-key=abcdefgh apikey :  12345678", "paſſword=abcdefg toKen=abcdefgh", "xAKIA" + "Z9" * 8 + "a AKIAAKIA",
    "a" * 24 + "g" + "b" * 23, "secret=" + SECRET, "", "password password=123456", "日本 token=ééé tokentoken=abcdef", "AKIA" + "A" * 16 + SECRET,
]


@pytest.mark.parametrize("text", TEXTS)
def test_patterns(text):
    assert S.base_spans(text) == plain_base(text)


def made(n, clean=0):
    rng = np.random.default_rng(3)
    secret = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    return [f'{PROSE[: 40 + 7 * i % 90]} token = "{secret()}" {PROSE}' for i in range(n)] + [f"{i} {PROSE}" for i in range(clean)]


@pytest.fixture(scope="module")
def field():
    return S.fit(made(60, 60))


def test_best_path_is_that_of_all_paths():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 7):
        for _ in range(6):
            e, after = rng.normal(size=(n, 3)) + [1.0, 0, 0], rng.normal(size=(3, 3))
            score = lambda p: sum(e[i, t] for i, t in enumerate(p)) + sum(after[a, b] for a, b in zip((0, *p), (*p, 0)))  # noqa: E731, B023
            best = max(itertools.product(range(3), repeat=n), key=score)
            assert tuple(S.decode(e, after, np.zeros(n, bool))) == best
            sure = S.surely_outside(e, after)
            assert all(best[i] == S.OUTSIDE for i in np.flatnonzero(sure)) and tuple(S.decode(e, after, sure)) == best


def test_likelihood_and_its_gradients():
    rng = np.random.default_rng(1)
    e, after, tags = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), np.array([[0, 1, 2, 0], [2, 2, 0, 1]])
    score = lambda e, p: sum(e[i, t] for i, t in enumerate(p)) + sum(after[a, b] for a, b in zip((0, *p), (*p, 0)))
    value, grad_e, grad_after = S.likelihood(e, after, tags)
    want = sum(score(x, p) - np.log(sum(np.exp(score(x, q)) for q in itertools.product(range(3), repeat=4))) for x, p in zip(e, tags))
    assert np.isclose(value, want)
    for grad, part in ((grad_e, e), (grad_after, after)):
        for i in np.ndindex(part.shape):
            part[i] += 1e-5
            up = S.likelihood(e, after, tags)[0]
            part[i] -= 2e-5
            down = S.likelihood(e, after, tags)[0]
            part[i] += 1e-5
            assert np.isclose(grad[i], (up - down) / 2e-5, atol=1e-5)


def test_field_finds_what_no_pattern_names_and_leaves_prose(field):
    tagger = S.Tagger(field)
    upper = f'{PROSE} auth = "{SECRET.upper()}" {PROSE}'
    clean = PROSE * 30
    found = list(tagger.find([upper, clean, None, ""]))
    assert S.base_spans(upper) == [] and len(found[0]) == 1 and SECRET.upper() in upper[slice(*found[0][0])]
    assert found[1:] == [[], [], []]
    held_out = made(80)[60:]
    assert all(len(f) == 1 and f[0][0] < b[0][1] for f, b in zip(tagger.find(held_out), map(S.base_spans, held_out)))


def test_windows_and_company_change_nothing(field):
    text = "".join(made(12)) + f' auth = "{SECRET.upper()}"' + "é" * 400 + "\n" * 300 + "".join(made(3)) + 'key = "' + "A1 " * 300
    whole = list(S.Tagger(field, 1 << 20).find([text]))
    assert len(whole[0]) >= 16
    for window in (40, 333, 5000):
        assert list(S.Tagger(field, window).find([text])) == whole
    assert list(S.Tagger(field, 1 << 20).find(["x", text, None, "token"]))[1] == whole[0]


def test_without_examples_nothing_is_added():
    assert list(S.Tagger(S.fit([PROSE])).find([f'token = "{SECRET}"'])) == [[]] and S.fit([]).weights.shape == (1 << S.BITS, 3)


def test_added_spans_overlap_no_others():
    base = [(0, 50, "assign"), (10, 20, "hex"), (60, 70, "hex")]
    assert S.apart([(30, 40), (50, 58), (52, 61), (70, 76), (80, 84)], base) == [(50, 58, "crf"), (70, 76, "crf")]
    assert S.apart([(3, 9)], []) == [(3, 9, "crf")]


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (None, f"token={SECRET}"), (3, TEXTS[6]), (3, TEXTS[6]), (4, ("word " * 80000) + TEXTS[6]), (5, "퟿ \x00 é")] + [(i + 9, t) for i, t in enumerate(made(20, 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in ("spans", "step", "y"))).repartition(3)
    got = S.find_secrets(docs, S.train(docs)).collect()
    want = sorted((i or 0, [(s, e, k, t[s:e]) for s, e, k in plain_base(t or "")]) for i, t in rows)
    assert sorted((r["doc_id"] or 0, [(x["start"], x["end"], x["kind"], x["text"]) for x in r["spans"] if x["kind"] != S.ADDED]) for r in got) == want
    none = docs.limit(0)
    assert S.find_secrets(none, S.train(none)).count() == 0


def test_query_over_its_whole_table(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op13_secret_spans"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r["doc_id"]])
        shown = [f"{k}:{s}:{e}" for s, e, k in base]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(b[2] == k for b in base) for k in S.KINDS)
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("crf")] == shown
    assert QUERIES["op13_secret_spans"](spark, DATA).exceptAll(spark.createDataFrame(rows, QUERIES["op13_secret_spans"](spark, DATA).schema)).isEmpty()
