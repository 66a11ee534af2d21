"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, written

TOKENIZER = "byte_bpe_50k.json"
LENGTH, END = 1024, 2
#: Characters of which both libraries hold the same view of what is a letter, a number and white
#: space. Texts with any other go through ``tokenizers``, which defines the ids; the rest through
#: ``tiktoken`` with the same vocabulary and pattern, which gives the same ids three times as fast.
OTHER = re.compile("[^\x00-\x1b\x20-\x7f\xa1-\u024f\u2013\u2014\u2018-\u201d\u2026]")


#: Runs of so many characters between white space, or of it, go through ``tokenizers`` too: matching the
#: pattern on a long one takes more of the stack than the fast library has.
RUN = 1 << 14
RUNS_OF_TEXT = re.compile(r"\s+|\S+")


def has_long_run(text: str) -> bool:
    return len(text) >= RUN and any(m.end() - m.start() >= RUN for m in RUNS_OF_TEXT.finditer(text))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids as little-endian 32-bit words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        ranks, self.fast = path.removesuffix(".json") + ".tiktoken", None
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def defined(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast is None or (not text.isascii() or not text.isprintable()) and OTHER.search(text) or has_long_run(text):
            return self.defined(text)
        return array("I", self.fast.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(ids: bytes, length: int = LENGTH) -> list[bytes]:
    """A document's ids in pieces of at most ``length`` tokens; only the first may be shorter."""
    size, first = 4 * length, len(ids) % (4 * length)
    return ([ids[:first]] if first else []) + [ids[i : i + size] for i in range(first, len(ids), size)]


def pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, uid, piece, start, length, ids_crc32[, ids]) of every row of ``docs``.

    A document is its text's ids (null: none) and one end id. ``uid`` tells rows apart that repeat
    a doc_id.
    """
    path = path or tokenizer_path()

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc, end = encoder(path), np.array([END], "<u4").tobytes()
        row = TaskContext.get().partitionId() << 36
        for pdf in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(pdf["doc_id"].tolist(), map(enc.encode, pdf["text"]), strict=True):
                start = 0
                doc_id = None if doc_id != doc_id or doc_id is None else int(doc_id)
                for k, p in enumerate(cut(ids + end, length)):
                    n = len(p) // 4
                    out.append((doc_id, row, k, start, n, zlib.crc32(p), *([np.frombuffer(p, "<u4").astype("i4")] if with_ids else [])))
                    start += n
                row += 1
            frame = pd.DataFrame(out, columns=["doc_id", "uid", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    schema = "doc_id long, uid long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(of, schema)


#: Gaps and units of documents, as runs: of kind GAP ``n`` sequences from ``first`` on with ``size``
#: tokens free, of kind UNIT ``n`` units of ``size`` tokens, those from rank ``first`` on of the units of
#: ``size`` / ``each`` documents of length ``each``. USED has the number of sequences opened as ``n``. PLACED
#: are units that have gone into sequences from ``sequence`` on that had ``gap`` tokens free.
RUNS = "kind int, size long, each long, first long, n long, sequence long, gap long"
GAP, UNIT, USED, PLACED = range(4)
#: Rounds in one job: runs are few, so that a round costs less than writing and reading them.
ROUNDS = 4
#: Equal documents that together take this share of a sequence or less are placed as one unit.
SHARE = 64


def units(counts: DataFrame, length: int = LENGTH) -> DataFrame:
    """The runs of units of (length, n): whole units of equal documents, and what is left of them singly."""
    many = F.greatest(F.floor(F.lit(length // SHARE) / F.col("length")), F.lit(1)).cast("long")
    whole = counts.select("length", "n", many.alias("m"))
    zero, full = F.lit(0).cast("long"), F.floor(F.col("n") / F.col("m"))
    run = lambda size, first, n: F.struct(F.lit(UNIT).alias("kind"), size.alias("size"), F.col("length").cast("long").alias("each"), first.alias("first"), n.alias("n"), (zero - 1).alias("sequence"), zero.alias("gap"))
    both = F.array(run(F.col("m") * F.col("length"), zero, full), run(F.col("length").cast("long"), full * F.col("m"), F.col("n") - full * F.col("m")))
    return whole.select(F.inline(both)).filter("n > 0")


def swept(runs: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """One round: the placed runs of rows (kind, size, each, first, n), and the gaps and units after it.

    Units and gaps are sorted by size, the largest first, and swept: each unit takes its successor among
    the gaps, the smallest that fits and that no unit of a higher rank has taken, at most one unit a gap.
    Then the gaps are updated.
    """
    free: list[list] = []  # the gaps passed that nobody has taken, the smallest last
    placed, gaps, rest = [], [], []
    for kind, size, each, first, n in sorted(runs, key=lambda r: (-r[1], r[0], r[3], r[2])):
        if kind == GAP:
            free.append([size, first, n])
            continue
        while n and free:
            gap, sequence, k = free[-1]
            t = min(n, k)
            placed.append((size, each, first, t, sequence, gap))
            if gap > size:
                gaps.append((GAP, gap - size, 1, sequence, t))
            first, n, free[-1] = first + t * size // each, n - t, [gap, sequence + t, k - t]
            if t == k:
                free.pop()
        if n:
            rest.append((UNIT, size, each, first, n))
    after: list[tuple] = []
    for kind, size, each, first, n in sorted([*rest, *gaps, *((GAP, g, 1, s, k) for g, s, k in free)]):  # those that continue one another as one
        if after and after[-1][:3] == (kind, size, each) and after[-1][3] + after[-1][4] * (size // each if kind == UNIT else 1) == first:
            first, n = after[-1][3], after.pop()[4] + n
        after.append((kind, size, each, first, n))
    return placed, after


def opened(runs: list[tuple], length: int) -> int:
    """How many sequences a round opens: where the largest gap is too small for some units, one for each
    over half a sequence, or where none is, as many as their tokens fill."""
    gap = max((r[1] for r in runs if r[0] == GAP), default=0)
    lost = [r for r in runs if r[0] == UNIT and r[1] > gap]
    return sum(r[4] for r in lost if 2 * r[1] > length) or -(-sum(r[1] * r[4] for r in lost) // length)


def best_fit(counts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Where documents go: rows (length, first, n, sequence, per, offset): the documents of ``length``
    from rank ``first`` on, ``n`` of them, ``per`` in each sequence from ``sequence`` on, from ``offset`` on.
    ``counts`` has (length, n).

    Bulk-synchronous best fit over runs of equal lengths and of equal gaps. Lengths and gaps are whole
    numbers up to ``length``, so that there are a few thousand runs at most, whatever the number of
    documents; they are range-sorted in one partition, and jobs of ROUNDS rounds follow one another,
    each writing the gaps and units it leaves, until no unit is left.
    """
    spark = counts.sparkSession

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(batches))
        rows = [tuple(map(int, r)) for r in frame[["kind", "size", "each", "first", "n"]].itertuples(index=False)]
        used = next((r[4] for r in rows if r[0] == USED), 0)
        runs, out = [r for r in rows if r[0] != USED], []
        for _ in range(ROUNDS):
            if not any(r[0] == UNIT for r in runs):
                break
            new = opened(runs, length)
            placed, runs = swept(runs + ([(GAP, length, 1, used, new)] if new else []))
            used += new
            out += [(PLACED, *p) for p in placed]
        out += [(*r, -1, 0) for r in [*runs, (USED, 0, 1, 0, used)]]
        yield pd.DataFrame(out, columns=frame.columns)

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    start = spark.createDataFrame([(USED, 0, 1, 0, 0, -1, 0)], RUNS)
    state = written(units(counts.filter(F.col("length") < length), length).unionByName(start).coalesce(1))
    done = []
    while not state.filter(F.col("kind") == UNIT).isEmpty():
        state = written(state.filter(F.col("kind") != PLACED).coalesce(1).mapInPandas(advance, RUNS))
        done.append(state.filter(F.col("kind") == PLACED))
    used = state.filter(F.col("kind") == USED).first()["n"]
    full = counts.filter(F.col("length") == length)
    out = full.select(F.col("length").cast("long"), zero.alias("first"), "n", F.lit(used).cast("long").alias("sequence"), one.alias("per"), zero.alias("offset"))
    per = F.floor(F.col("size") / F.col("each"))
    for d in done:
        out = out.unionByName(d.select(F.col("each").alias("length"), "first", (F.col("n") * per).alias("n"), "sequence", per.alias("per"), (length - F.col("gap")).alias("offset")))
    return out


def ranked(items: DataFrame, size: str, order: list[str], out: str = "rank") -> DataFrame:
    """Adds the rank of each row among those of its ``size``. Rows are spread over buckets by a hash
    of ``order``, counted by (size, bucket), and numbered inside, so no size meets in one task."""
    spark = items.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = items.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = spread.groupBy(size, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(size).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).drop("_n")
    inside = Window.partitionBy(size, "_bucket").orderBy(*order)
    numbered = spread.withColumn("_nth", F.row_number().over(inside) - 1)
    return numbered.join(counts, [size, "_bucket"]).withColumn(out, F.col("_before") + F.col("_nth")).drop("_bucket", "_nth", "_before")


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row.

    Null and empty texts are one end id. A document longer than ``length`` gives full pieces, which
    fill sequences by themselves, and one shorter first piece. Rows that repeat a doc_id are packed
    each. Null ids stay null.
    """
    cutted = checkpointed(pieces(docs, length, path))
    placed = best_fit(cutted.groupBy("length").agg(F.count("*").alias("n")), length).toPandas()  # runs, not documents
    runs: dict[int, np.ndarray] = {}
    table = placed.sort_values(["length", "first"]).to_numpy(np.int64)
    for size in np.unique(table[:, 0]):
        runs[int(size)] = table[table[:, 0] == size]

    @F.pandas_udf("sequence_id long, offset long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for sizes, ranks in batches:
            size, rank = sizes.to_numpy(np.int64), ranks.to_numpy(np.int64)
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                rows, run = np.flatnonzero(size == s), runs[int(s)]
                r = run[np.searchsorted(run[:, 1], rank[rows], side="right") - 1]
                at = rank[rows] - r[:, 1]
                seq[rows], off[rows] = r[:, 3] + at // r[:, 4], r[:, 5] + at % r[:, 4] * s
            yield pd.DataFrame({"sequence_id": seq, "offset": off})

    numbered = ranked(cutted, "length", ["uid", "piece"])
    put = numbered.withColumn("at", place("length", "rank"))
    return put.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))
