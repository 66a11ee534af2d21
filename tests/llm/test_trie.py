"""The prefix tree against a plain version that keeps all prefixes in a dictionary."""

import hashlib
import random
import re
import zlib

import pytest
from loomwright.llm import trie
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members, ends = {}, {}
    for c in sorted(whole):
        ends.setdefault(tuple(whole[c]), []).append(c)
        for d in range(len(whole[c]) + 1):
            members.setdefault(tuple(whole[c][:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = leaves.get(path, 0) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        saved[path] = saved.get(path, 0) + (len(members[path]) - 1) * words
        if path:
            up = path[:-1]
            kids[up], leaves[up], saved[up] = kids.get(up, 0) + 1, leaves.get(up, 0) + leaves[path], saved.get(up, 0) + saved[path]
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -1, len(m), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest())
        for p, m in members.items()
    )


def got(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in trie.prefix_tree(df).collect())


def random_rows(seed, convs, longest, texts):
    rng = random.Random(seed)
    return [(c, rng.choice([t, t, None]) if t == 0 else t, rng.choice(["user", None]), rng.choice(texts)) for c in convs for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("rows", [
    random_rows(1, range(0, 90), 6, ["a b", "c", None]),
    random_rows(2, range(7, 60, 3), 9, ["a", ""]),  # firsts of families are absent, so some have no turns
    [(c, t, "user", f"t {t}") for c in range(1, 15) for t in range(c)],  # each a snapshot of the next
    [(c, t, "user", f"t {t}") for c in range(1, 15) for t in range(16 - c)],
    [(3, t, "user", f"w{t % 3}") for t in range(700)] + [(c, t, "user", f"w{t % 3}") for c in range(4, 30) for t in range(c)],  # one holds most turns
    [(None, 0, "user", "x"), (5, 1, "r", "b"), (5, None, "r", "a"), (5, 1, "r", "b"), (25, None, "r", "a"), (25, 2, "r", "b"), (-7, 0, "r", "a " * 40000)],
    [(c, 0, "user", "same") for c in range(300)],
    [(1, 0, "", "ab"), (2, 0, "a", "b"), (4, 0, "1:a", "b")],
])
def test_tree_is_that_of_all_prefixes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    # turns of equal number are told apart by digests; here they differ in nothing else
    assert got(df) == plain(rows)


def test_no_rows_and_clashing_names(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    rows = [(c, t, "user", f"t{t}") for c in range(30) for t in range(c % 4 + 1)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(1).alias(c) for c in ("d", "pos", "key", "owner", "level", "_piece", "n")))
    assert got(df) == plain(rows)


def test_prefix_sums_of_a_group_in_many_pieces(spark):
    rows = [(g, i, 1, i) for g, n in (("a", 50), ("b", 900), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i long, one long, v long").repartition(5)
    out = trie.prefix_sums(df, "g", ["i"], ["one", "v"]).collect()
    assert sorted((r["g"], r["i"], r["one"], r["v"], r["v_own"]) for r in out) == sorted((g, i, i, i * (i - 1) // 2, i) for g, i, _, _ in rows)


def test_order_of_equal_turns_does_not_hang_on_the_rows_order(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "y"), (2, 0, "user", "y"), (2, 0, "user", "x")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == got(spark.createDataFrame(rows[::-1], SCHEMA))
