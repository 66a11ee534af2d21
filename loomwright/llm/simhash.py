"""Near-duplicates by 64-bit SimHash fingerprints, linked by meet-in-the-middle ball hashing.

Two fingerprints at distance d <= 2r share a variant at distance <= r from both. Every fingerprint
therefore emits all its variants within r = radius // 2 bits; fingerprints that meet at a variant
are linked. Variants are shuffled by the values of some of their bits: a fingerprint's variants that
agree in these bits travel as one row and are written out inside the task. Of b such bits a
fingerprint has 1 + b + b (b - 1) / 2 rows for r = 2, and b grows with the logarithm of the number of
fingerprints, so that a task always holds about as many variants.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, checkpointed, components, met_evenly, partitions

SEED = 42
#: Variants of a shard in the mean, and those at which a shard is dealt again by more bits.
MEAN_SHARD, FULL_SHARD = 1 << 21, 1 << 23
#: How many more bits that takes.
MORE_BITS = 6


def shingle_hashes(text: str | None, k: int) -> Iterator[np.ndarray]:
    """XXH64 values of the k-word shingles of a text, in bounded arrays."""
    tail: list[bytes] = []
    seen = False
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for words in ascii_words(text):
        words = tail + words
        if len(words) >= k:
            seen = True
            for at in range(0, len(words) - k + 1, 1 << 16):
                part = words[at : at + (1 << 16) + k - 1]
                # one joined string and slices of it cost less than a join for each shingle
                whole = join(part)
                ends = np.cumsum([len(w) + 1 for w in part]).tolist()
                starts = [0, *ends]
                yield np.array(
                    [digest(whole[starts[i] : ends[i + k - 1] - 1], SEED) for i in range(len(part) - k + 1)], np.uint64
                )
            tail = words[len(words) - k + 1 :]
        else:
            tail = words
    if not seen and tail:
        yield np.array([digest(join(tail), SEED)], np.uint64)


def fingerprint(text: str | None, k: int = 4) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes; 0 for a text without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, k):
        n += len(h)
        for at in range(0, len(h), 4096):
            bits = np.unpackbits(h[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, text: str = "text", k: int = 4, out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` (null or empty: 0) as a long, bit for bit."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.array([fingerprint(t, k) for t in s], np.uint64).view(np.int64))

    return docs.withColumn(out, of(F.col(text)))


@lru_cache(maxsize=64)
def ball(positions: tuple[int, ...], radius: int) -> tuple[np.ndarray, list[int]]:
    """All masks of at most ``radius`` of the bits at ``positions``, those of fewer bits first, and how
    many have at most 0, 1, ... ``radius`` bits."""
    one = [1 << i for i in positions]
    masks = [[sum(c) for c in combinations(one, n)] for n in range(radius + 1)]
    return np.array([m for ms in masks for m in ms], np.uint64), np.cumsum([len(m) for m in masks]).tolist()


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bits_of(positions: tuple[int, ...]) -> int:
    return sum(1 << i for i in positions)


def left(key: Column, dealt: tuple[int, ...], radius: int) -> Column:
    """How many bits a variant may still differ by, beyond those by which ``key`` does."""
    return F.lit(radius) - F.bit_count(F.col("fp").bitwiseXOR(key).bitwiseAND(F.lit(signed(bits_of(dealt)))))


def deal(rows: DataFrame, dealt: tuple[int, ...], more: tuple[int, ...], radius: int) -> DataFrame:
    """Rows (fp, key), key holding a variant's bits at ``dealt``, as a row for each value that variants
    have at the bits ``more``, which key then holds too."""
    masks, upto = ball(more, radius)
    masks = F.lit(np.array(masks).view(np.int64).tolist())
    own = F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.lit(signed(bits_of(more)))))
    fits = F.slice(masks, F.lit(1), F.element_at(F.lit(upto), left(F.col("key"), dealt, radius) + 1))
    return rows.select("fp", F.explode(F.transform(fits, lambda m: own.bitwiseXOR(m))).alias("key"))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Indices of links (a, b) that connect n nodes as all links do, without a cycle."""
    parent, chosen, left = np.arange(n), [], np.arange(len(a))
    while True:
        ra, rb = parent[a[left]], parent[b[left]]
        live = ra != rb
        left, ra, rb = left[live], ra[live], rb[live]
        if not len(left):
            return np.concatenate(chosen) if chosen else left
        high, first = np.unique(np.maximum(ra, rb), return_index=True)
        parent[high] = np.minimum(ra, rb)[first]
        chosen.append(left[first])
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def meet(x: np.ndarray, key: np.uint64, dealt: tuple[int, ...], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the fingerprints ``x`` that share a variant with the bits ``key`` at ``dealt``:
    links that connect whatever those meetings connect."""
    masks, upto = ball(tuple(i for i in range(64) if i not in dealt), radius)
    mask = np.uint64(bits_of(dealt))
    n = np.array(upto)[radius - np.bitwise_count((x ^ key) & mask).astype(np.int64)]
    owner = np.repeat(np.arange(len(x), dtype=np.int32), n)
    variants = ((x & ~mask) | key)[owner]
    variants ^= masks[np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)]
    ordered = np.sort(variants)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.searchsorted(shared, variants)
    hit = shared[np.minimum(place, len(shared) - 1)] == variants
    place, owner = place[hit], owner[hit]
    by = np.lexsort((owner, place))
    place, owner = place[by], owner[by]
    first = np.r_[True, place[1:] != place[:-1]]
    hub = owner[np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))]
    pairs = np.unique(np.stack([hub[~first], owner[~first]], 1), axis=0)
    keep = forest(pairs[:, 0], pairs[:, 1], len(x))
    return pairs[keep, 0], pairs[keep, 1]


def shards(distinct: DataFrame, radius: int) -> tuple[DataFrame, list[int]]:
    """(fp, key, bits): where the fingerprints' variants meet, and the 64 bit positions in the order
    in which they deal; the first ``bits`` of them say what ``key`` holds.

    Positions that are set in nearest to half of the fingerprints deal first. Shards that hold over
    FULL_SHARD variants even so are dealt by more positions, until none does or no position is left.
    """
    ones = [F.coalesce(F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))), F.lit(0)).alias(f"b{i}") for i in range(64)]
    seen = distinct.agg(F.count("*").alias("n"), *ones).first()
    n = seen["n"]
    order = sorted(range(64), key=lambda i: (abs(2 * seen[f"b{i}"] - n), i))
    bits = 0
    while n * ball(tuple(range(64)), radius)[1][-1] > MEAN_SHARD << bits:
        bits += 1
    rows = deal(distinct.select("fp", F.lit(0).cast("long").alias("key")), (), tuple(order[:bits]), radius)
    done = rows.limit(0).withColumn("bits", F.lit(0))
    while True:
        dealt = tuple(order[:bits])
        free = F.lit(ball(tuple(order[bits:]), radius)[1])
        held = F.sum(F.element_at(free, left(F.col("key"), dealt, radius) + 1))
        full = checkpointed(rows.groupBy("key").agg(held.alias("held")).filter(F.col("held") > FULL_SHARD).select("key"))
        if bits == 64 or full.isEmpty():
            return done.unionByName(rows.withColumn("bits", F.lit(bits))), order
        done = done.unionByName(rows.join(full, "key", "left_anti").select("fp", "key", F.lit(bits).alias("bits")))
        more = min(64, bits + MORE_BITS)
        rows = deal(rows.join(full, "key", "left_semi").select("fp", "key"), dealt, tuple(order[bits:more]), radius)
        bits = more


def links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """(u, v) verified links that join all of the distinct fingerprints ``fp`` reachable over
    ``distance`` or fewer differing bits."""
    radius = distance // 2
    if 2 * radius != distance:
        raise ValueError("the distance must be even")
    dealt, order = shards(distinct, radius)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf["fp"].to_numpy(np.int64)).view(np.uint64)
        key = np.int64(pdf["key"].iloc[0]).view(np.uint64)
        a, b = meet(x, key, tuple(order[: int(pdf["bits"].iloc[0])]), radius)
        x = x.view(np.int64)
        return pd.DataFrame({"u": x[a], "v": x[b]})

    met = dealt.groupBy("bits", "key").applyInPandas(one, "u long, v long")
    return met.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 4, distance: int = 4) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``.

    component_id is the smallest id reachable over links of ``distance`` or fewer differing bits,
    the row's own included. Null and empty texts have fingerprint 0 and are linked like any other;
    repeated rows stay repeated. Rows with a null id take part like all others, links through them
    included: they get the smallest id of their component, null if nothing there has one.
    """
    fps = checkpointed(fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")), "text", k).drop("text"))
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("rows")))
    joined = components(links(distinct.select("fp"), distance))
    members = distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "id", "rows", F.coalesce("component", "fp").alias("component"))
    members = checkpointed(members)
    most = fps.count() // (16 * partitions(docs.sparkSession)) + 1
    least = members.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("prints"))
    named = met_evenly(members.drop("id"), least, "component", "prints", most).select("fp", "component_id", "rows")
    return met_evenly(fps, named, "fp", "rows", most).select(F.col("id").alias(id_col), "fp", "component_id")


def fingerprint_hex(fp: str) -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id. Rows with a
    null doc_id cannot be named as anybody's copy and stay."""
    keep = near_duplicates(docs, **how).filter("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.join(keep, docs["doc_id"] == keep["_kept"], "left_semi")
    return named.unionByName(docs.filter("doc_id is null"))
