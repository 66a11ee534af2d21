"""Token alignment against a plain version that walks the tokens of one document."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from loomwright.llm import align

from test_queries import DATA

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def two():
    return align.pair(public_tokenizers.path(align.A_NAME), public_tokenizers.path(align.B_NAME))


def spans(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def plain(two, text):
    """(a ids, b ids, groups' text, links) of one text, pair by pair."""
    a, b = two.a.tokenizer.encode(" " + text, add_special_tokens=False).ids if text else [], two.b.encode(text) if text else []
    a_bytes, b_bytes = [two.a_bytes[i] for i in a], [two.b_bytes[i] for i in b]
    if not text or not b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
        return [], [], [], []
    pa, pb = spans(a_bytes), spans(b_bytes)
    links, first = [], 0
    for i, (s, e) in enumerate(pa):
        while pb[first][1] <= s:
            first += 1
        j = first
        while j < len(pb) and pb[j][0] < e:
            links.append((a[i], b[j]))
            j += 1
    groups, start = [], 0
    for end in sorted({e for _, e in pa} & {e for _, e in pb}):
        groups.append(tuple(",".join(str(i) for i, (s, e) in zip(ids, p) if start <= s and e <= end) for ids, p in ((a, pa), (b, pb))))
        start = end
    return a, b, groups, links


def expected(two, rows):
    done = [(i, *plain(two, t)) for i, t in rows]
    count = Counter(link for *_, links in done for link in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(n, best.get(b, 0))
    return sorted(
        (i, len(a), len(b), len(g), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
         hashlib.sha256(";".join(map("|".join, g)).encode()).hexdigest() if g else "")
        for i, a, b, g, links in done
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


TEXTS = [
    (1, "The internationalisation of tokens, naïve or 日本語 🙂."), (2, None), (3, ""), (4, "a▁b"), (5, "<|endoftext|> <s></s> <0x41>"), (6, "tabs\t\tand\n\n  spaces   "),
    (7, "repeat repeat repeat"), (7, "repeat repeat repeat"), (8, "x" * 300 + " " + "é" * 200), (9, " "), (10, "\x00\x01 nul"), (11, "repeat " * 3000),
]


@pytest.mark.parametrize("common", [align.COMMON, 20, 0])
def test_rows_are_those_of_a_walk_over_tokens(spark, two, common):
    df = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], SCHEMA + ", pair string").repartition(3)
    assert rows_of(align.alignment(df, common=common)) == expected(two, TEXTS)


def test_an_unspelt_text_has_no_tokens(spark, two):
    got = {r[0]: r[1:] for r in rows_of(align.alignment(spark.createDataFrame(TEXTS, SCHEMA)))}
    assert got[2] == got[3] == got[4] == (0, 0, 0, 0, 0, 0, "")


def test_null_ids_and_no_rows(spark):
    assert rows_of(align.alignment(spark.createDataFrame([], SCHEMA))) == []
    assert align.alignment(spark.createDataFrame([(None, "a b")], SCHEMA)).first()["doc_id"] is None


def test_groups_of_many_documents_at_once_are_those_of_each(spark, two, monkeypatch):
    monkeypatch.setattr(align, "SLAB", 50)
    rows = align.aligned(spark.createDataFrame(TEXTS, SCHEMA), public_tokenizers.path(align.A_NAME), public_tokenizers.path(align.B_NAME), with_groups=True).collect()
    want = {i: ";".join(map("|".join, plain(two, t)[2])) for i, t in TEXTS}
    assert {r["doc_id"]: r["groups"] for r in rows} == want


def test_counts_held_back_are_whole(spark):
    rows = [(i, np.array([5, 9, 70000 + i % 3], "<u4").tobytes(), np.array([1, 2, 3], "<u4").tobytes()) for i in range(40)]
    got = align.pair_counts(spark.createDataFrame(rows, "uid long, pairs binary, times binary").repartition(2), held=4)
    assert {r["pair"]: r["n"] for r in got.collect()} == {5: 40, 9: 80, 70000: 42, 70001: 39, 70002: 39}


def test_query_is_the_walk_over_the_given_table(spark, two):
    from loomwright.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op11_align_tokens"](spark, DATA)) == expected(two, rows)
