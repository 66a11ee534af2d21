"""Alignment of two tokenizers' tokens by the bytes they cover.

A slab of documents is one byte string. Both tokenizers' token ends are counted by byte once; where both
end, the slab is cut into groups, and between two ends of any kind lies one link, the bytes that one A
and one B token share. Prefix sums, differenced at the documents' ends, give each document's numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .packing import encoder

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text aligned in one go; a longer document is aligned alone.
SLAB = 1 << 21
#: Pairs a task counts before it hands its counts on.
HELD = 1 << 21
#: Id pairs, the most frequent ones, whose counts go to every task: 13 bytes each.
COMMON = 1 << 19


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write a printable Latin-1 byte as itself and the others, in order, from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, their tokens' bytes and the tokens' lengths."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.b = encoder(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        known, codes = self.a.tokenizer.get_vocab(with_added_tokens=True), byte_of_char()
        self.a_bytes = [b""] * (max(known.values()) + 1)
        for piece, i in known.items():
            self.a_bytes[i] = bytes(codes[c] for c in piece)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_size, self.b_size = (np.array([len(t) for t in tokens], np.int64) for tokens in (self.a_bytes, self.b_bytes))

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[bool]]:
        """A ids, B ids, and whether both spell the space and the text, by text."""
        data = [b" " + t.encode() for t in texts]
        a = [np.frombuffer(self.a.encode(" " + t), "<u4") for t in texts]
        b = self.b.encode(texts, num_threads=1)
        spelt = [
            d == b"".join(map(self.b_bytes.__getitem__, y)) and d == b"".join(map(self.a_bytes.__getitem__, x.tolist()))
            for d, x, y in zip(data, a, b, strict=True)
        ]
        return a, [np.array(y, np.int64) for y in b], spelt


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


@lru_cache(maxsize=1)
def decimals() -> np.ndarray:
    """Row s, column i: the decimal i and the separator s of ``,``, ``|``, ``;`` and none, padded with NULs."""
    return np.array([[f"{i}{s}".encode() for i in range(1 << 16)] for s in (",", "|", ";", "")], "S6")


def slabs(texts: list[str | None], size: int) -> Iterator[list[int]]:
    """Indices of the texts that have something in them, in slabs of about ``size`` characters."""
    held, chars = [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        if held and chars + len(t) > size:
            yield held
            held, chars = [], 0
        held.append(i)
        chars += len(t)
    if held:
        yield held


def align(a: list[np.ndarray], b: list[np.ndarray], a_size: np.ndarray, b_size: np.ndarray) -> dict[str, np.ndarray | list]:
    """What two tokenizations of the same documents share, all documents at once.

    By document: n_a, n_b, n_groups, n_links and groups, the groups' text; by link, in the order of the
    texts: its ids a and b. Every document has tokens.
    """
    n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    a, b = (np.concatenate(side).astype(np.int64) for side in (a, b))
    a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    a_last, b_last = np.cumsum(n_a), np.cumsum(n_b)
    total = int(a_end[-1]) + 1
    ends_a, ends_b = np.bincount(a_end, minlength=total).astype(bool), np.bincount(b_end, minlength=total).astype(bool)
    cut = ends_a & ends_b
    cuts, marks = np.cumsum(cut), np.cumsum(ends_a | ends_b)
    doc_end = a_end[a_last - 1]
    by_doc = lambda running: np.diff(running[doc_end], prepend=0)
    at = np.flatnonzero(ends_a | ends_b)
    link_a, link_b = (ids[(np.cumsum(ends) - ends)[at]] for ids, ends in ((a, ends_a), (b, ends_b)))
    # the text of the groups: each group's A tokens, then its B tokens
    a_cut, b_cut = cut[a_end], cut[b_end]
    a_group, b_group = cuts[a_end] - a_cut, cuts[b_end] - b_cut
    groups = int(cuts[-1])
    a_until = np.cumsum(np.bincount(a_group, minlength=groups))
    b_until = np.cumsum(np.bincount(b_group, minlength=groups))
    b_sep = np.where(b_cut, 2, 0)
    b_sep[b_last - 1] = 3
    shown = np.empty(len(a) + len(b), "S6")
    shown[np.arange(len(a)) + np.r_[0, b_until][a_group]] = decimals()[a_cut.astype(np.int64), a]
    shown[np.arange(len(b)) + a_until[b_group]] = decimals()[b_sep, b]
    both = np.r_[0, a_last + b_last]
    text = [shown[s:e].tobytes().translate(None, b"\0") for s, e in zip(both[:-1], both[1:], strict=True)]
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": by_doc(cuts), "n_links": by_doc(marks), "groups": text,
        "a": link_a, "b": link_b,
    }


ROWS = pa.schema([
    ("uid", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary()),
])


def aligned(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """(uid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times[, groups]) of every row.

    ``pairs`` are the document's distinct linked id pairs, A times 65536 plus B, ascending, as
    little-endian 32-bit words; ``times`` says how often each is linked. ``uid`` tells rows apart that
    repeat a doc_id.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        two, uid = pair(a_path, b_path), TaskContext.get().partitionId() << 36
        for batch in batches:
            texts, n = batch.column("text").to_pylist(), batch.num_rows
            sums = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
            sha, shown, pairs, times = [""] * n, [""] * n, [b""] * n, [b""] * n
            for slab in slabs(texts, SLAB):
                a, b, spelt = two.ids([texts[i] for i in slab])
                slab = [i for i, s in zip(slab, spelt, strict=True) if s]
                if not slab:
                    continue
                got = align([x for x, s in zip(a, spelt, strict=True) if s], [y for y, s in zip(b, spelt, strict=True) if s], two.a_size, two.b_size)
                for c, values in sums.items():
                    values[slab] = got[c]
                owner = np.repeat(np.arange(len(slab), dtype=np.uint64), got["n_links"])
                keys, counts = np.unique(owner << np.uint64(32) | (got["a"] << 16 | got["b"]).astype(np.uint64), return_counts=True)
                until = np.searchsorted(keys, np.arange(1, len(slab) + 1, dtype=np.uint64) << np.uint64(32))
                words, counts = keys.astype("<u4"), counts.astype("<u4")
                for i, text, s, e in zip(slab, got["groups"], np.r_[0, until[:-1]], until, strict=True):
                    sha[i], pairs[i], times[i] = hashlib.sha256(text).hexdigest(), words[s:e].tobytes(), counts[s:e].tobytes()
                    if with_groups:
                        shown[i] = text.decode()
            columns = [pa.array(np.arange(uid, uid + n)), batch.column("doc_id").cast(pa.int64()), *(pa.array(v) for v in sums.values()), sha, pairs, times]
            uid += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, ROWS, strict=True)] + ([pa.array(shown)] if with_groups else []), schema=out)

    out = ROWS.append(pa.field("groups", pa.string())) if with_groups else ROWS
    kinds = {"int64": "long", "string": "string", "binary": "binary"}
    return docs.select("doc_id", "text").mapInArrow(of, ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in out))


def pair_counts(rows: DataFrame, held: int = HELD) -> DataFrame:
    """(pair, n): how many links of all ``rows`` hold each id pair. Tasks count before anything is shuffled."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, fresh, waiting = np.zeros(0, "<u4"), np.zeros(0, np.int64), [], 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            all_keys = np.concatenate([keys, *(k for k, _ in fresh)])
            known, at = np.unique(all_keys, return_inverse=True)
            return known, np.bincount(at, np.concatenate([sums, *(t for _, t in fresh)]), len(known)).astype(np.int64)

        for batch in batches:
            fresh.append((np.frombuffer(b"".join(batch.column("pairs").to_pylist()), "<u4"), np.frombuffer(b"".join(batch.column("times").to_pylist()), "<u4")))
            waiting += len(fresh[-1][0])
            if waiting >= held:
                keys, sums = merge()
                fresh, waiting = [], 0
                if len(keys) >= held:
                    yield pa.record_batch({"pair": keys.astype(np.int64), "n": sums})
                    keys, sums = keys[:0], sums[:0]
        keys, sums = merge()
        yield pa.record_batch({"pair": keys.astype(np.int64), "n": sums})

    return rows.select("pairs", "times").mapInArrow(of, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def common_bound(counts: DataFrame, most: int) -> int:
    """The least count that ``most`` pairs or fewer reach, from a histogram of under 1100 cells."""
    step = F.floor(F.log2("n") * 16).cast("int")
    held, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect(), key=lambda r: -r["step"]):
        held += r["k"]
        if held > most:
            break
        least = r["n"]
    return (1 << 62) if least is None else least


def alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, common: int = COMMON) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    A null or empty text has no tokens, nor one that its tokens do not spell (say, with U+2581, which
    reads as a space): zeros and an empty digest. Repeated rows get a row each and count each; a null
    doc_id stays null; a document of any length is aligned whole; an empty table gives no row. Other
    columns are not read.

    The counts of the ``common`` most frequent pairs go to every task, so that no pair that many
    documents share is a key of a join; the other pairs are joined, each with few rows.
    """
    import public_tokenizers

    rows = written(aligned(docs, a_path or public_tokenizers.path(A_NAME), b_path or public_tokenizers.path(B_NAME)), "aligned")
    counts = written(pair_counts(rows), "pairs")
    # a row for each id of B's vocabulary, 32,000, whatever the corpus
    highest = counts.groupBy((F.col("pair") % 65536).alias("b")).agg(F.max("n").alias("highest"))
    ranked = counts.join(F.broadcast(highest), F.col("pair") % 65536 == F.col("b")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    bound = common_bound(counts, common)
    known = ranked.filter(F.col("n") >= bound).sort("pair").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((
        known["pair"].to_numpy().astype("<u4"), known["n"].to_numpy(), known["best"].to_numpy().astype(np.int64),
    ))

    def met(batches: Iterator[pa.RecordBatch], rest: bool) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            sizes = np.array([len(p) // 4 for p in batch.column("pairs").to_pylist()], np.int64)
            mine = np.frombuffer(b"".join(batch.column("pairs").to_pylist()), "<u4")
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), "<u4").astype(np.int64)
            at = np.minimum(np.searchsorted(pairs, mine), max(len(pairs) - 1, 0))
            here = pairs[at] == mine if len(pairs) else np.zeros(len(mine), bool)
            if rest:
                uid = np.repeat(batch.column("uid").to_numpy(), sizes)
                yield pa.record_batch({"uid": uid[~here], "pair": mine[~here].astype(np.int64), "times": times[~here]})
            else:
                sums = [np.diff(np.r_[0, np.cumsum(np.where(here, v[at] * times, 0) if len(pairs) else 0 * times)][np.r_[0, np.cumsum(sizes)]]) for v in (best, n)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *map(pa.array, sums)], names=[*batch.schema.names[:-2], "n_best", "count_sum"])

    plain = [f.name for f in ROWS][:-2]
    known_sums = rows.select(*plain, "pairs", "times").mapInArrow(
        lambda batches: met(batches, False), ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in plain) + ", n_best long, count_sum long"
    )
    rare = ranked.filter(F.col("n") < bound)
    if not rare.isEmpty():
        rest = rows.select("uid", "pairs", "times").mapInArrow(lambda batches: met(batches, True), "uid long, pair long, times long").join(rare, "pair")
        sums = rest.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
        known_sums = known_sums.unionByName(sums, allowMissingColumns=True).groupBy("uid").agg(*(F.max(c).alias(c) for c in plain[1:]), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return known_sums.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

