"""BM25 over an inverted index in blocks of documents, exact without scoring every pair.

A posting's impact is what it adds to a score for each unit of a word's weight, and a block knows the
largest impact of each word. Words are added in the order of what they can add; as soon as the words
left cannot lift a document over the block's k-th best, only documents that may still reach it are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..sources.sinks import written

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents of a block, and words of questions that meet it at a time.
BLOCK, ASKED = 4096, 1 << 18
#: Bytes of texts whose words are counted at a time; a longer text is counted by itself.
TEXTS = 1 << 20
#: Scores are rounded to six places before they are ranked, so bounds give way by more than that.
SLACK = 2e-6
#: Bytes of words, and the letters beyond ASCII that have lower-case forms in it.
INSIDE = np.zeros(256, bool)
INSIDE[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
FOLDED = {"\u0130": "i\u0307", "\u212a": "k"}


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.LargeStringArray]:
    """The row and the word of each run of [a-z0-9] in the lower-cased texts; null texts have none."""
    low = texts.cast(pa.large_string()).fill_null("")
    for letter, lower in FOLDED.items():
        low = pc.replace_substring(low, letter, lower)
    low = pc.ascii_lower(low)
    _, ends, data = low.buffers()
    cut = np.frombuffer(ends, np.int64)[low.offset : low.offset + len(low) + 1] if len(low) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)[cut[0] : cut[-1]]
    inside = INSIDE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    tops = cut[:-1][cut[:-1] < cut[-1]] - cut[0]
    begins[tops] = inside[tops]  # a text's first byte begins a word, whatever the text before ends with
    row = np.searchsorted(cut[1:] - cut[0], np.flatnonzero(begins), side="right")
    letters = data[inside]
    offsets = np.r_[np.flatnonzero(begins[inside]), len(letters)]
    return row, pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(offsets), pa.py_buffer(letters))


def pieces(batch: pa.RecordBatch, column: str = "text", most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows with about ``most`` bytes of texts, TEXTS unless given."""
    most = most or TEXTS
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt over all cores where the planner expects fewer splits than these, as of small files; else
    as they are, so that large inputs are not shuffled."""
    spark = rows.sparkSession
    expected = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if expected < cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() else rows


def postings(chunks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, chunk_id, dl, first, term, tf): a chunk's distinct words, counted where its text is read, a
    bounded piece of a batch at a time, so that memory does not grow with what a split or a batch holds.
    ``first`` marks one row of each chunk; a chunk without words has one with no word."""
    keys = [*by, "chunk_id"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole)):
            row, word = words_of(batch.column("text"))
            coded = word.dictionary_encode()
            size = np.bincount(row, minlength=len(batch))
            pair, tf = np.unique(row * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
            row, code = np.divmod(pair, max(1, len(coded.dictionary)))
            none = np.flatnonzero(size == 0)  # a row each, without a word
            at = np.r_[row, none]
            term = pa.array(np.r_[code, none * 0], mask=np.arange(len(at)) >= len(row))
            first = np.r_[np.diff(row, prepend=-1) != 0, none >= 0]
            columns = [batch.column(k).take(pa.array(at)) for k in keys] + [pa.array(size[at]), pa.array(first), coded.dictionary.take(term).cast(pa.string()), pa.array(np.r_[tf, none * 0])]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "dl", "first", "term", "tf"])

    kinds = ", ".join(f"{k} {chunks.schema[k].dataType.simpleString()}" for k in keys)
    return spread(chunks.select(*keys, "text")).mapInArrow(of, f"{kinds}, dl long, first boolean, term string, tf long")


def asked_words(questions: DataFrame) -> DataFrame:
    """(query_id, term, qf) of (query_id, text): a word counts as often as the question has it."""
    return questions.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))


class Index:
    """Postings of (chunk_id, text), each group of ``by`` by itself; chunks with a null group are left out."""

    def __init__(self, chunks: DataFrame, by: tuple[str, ...] = ()):
        for c in by:
            chunks = chunks.filter(F.col(c).isNotNull())
        self.by, self.rows = list(by), written(postings(chunks, by), "postings")
        self.sizes = self.rows.filter("first").groupBy(*by).agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))

    def known(self, rows: DataFrame, sums: DataFrame) -> DataFrame:
        """``rows`` with the sums of their group; without groups these are one row."""
        return rows.join(sums, self.by) if self.by else rows.crossJoin(F.broadcast(sums))

    def idf(self) -> DataFrame:
        """(*by, term, idf): a negative inverse frequency becomes EPSILON times the vocabulary's mean."""
        df = self.rows.filter("term is not null").groupBy(*self.by, "term").agg(F.count("*").alias("df"))
        raw = self.known(df, self.sizes).withColumn("raw", F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.groupBy(*self.by).agg(F.avg("raw").alias("mean"))
        return self.known(raw, mean).select(*self.by, "term", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))

    def blocks(self, asked: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
        """The postings of asked words by block, and the number of blocks of each group. Documents are dealt by hash."""
        counts = self.sizes.select(*self.by, F.ceil(F.col("docs") / block).alias("blocks"), "avgdl")
        met = self.known(self.rows.join(asked.select("term").distinct(), "term", "left_semi"), counts)
        impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        return met.select(*self.by, F.pmod(F.xxhash64("chunk_id"), "blocks").alias("block"), "chunk_id", "term", impact.alias("impact")), counts


def best_of_block(impacts: dict[int, tuple[np.ndarray, np.ndarray]], words: list[tuple[int, float]], n: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, number scored to the end): all that can be among the ``k`` best of a block of ``n``.

    ``impacts`` gives each word's documents, ascending, and their impacts; ``words`` are a question's, with
    weights. Words that lower scores are added first, so that what is left can only raise them.
    """
    total = np.zeros(n)
    most = [(max(w, 0.0) * impacts[t][1].max(), t, w) for t, w in words if t in impacts]
    for _, t, w in most:
        if w < 0:
            np.add.at(total, impacts[t][0], w * impacts[t][1])
    rising = sorted((m for m in most if m[2] >= 0), reverse=True)
    met = np.zeros(n, bool)
    for _, t, _ in most:
        met[impacts[t][0]] = True
    rest = sum(m for m, _, _ in rising)
    docs = None
    for place, (m, t, w) in enumerate(rising):
        at, value = impacts[t]
        rest -= m
        if docs is None:
            total[at] += w * value
            if place % 2 and n > k:
                bar = np.partition(total, n - k)[n - k]
                if rest < bar:
                    docs = np.flatnonzero(met & (total + rest >= bar - SLACK))
        else:
            where = np.minimum(np.searchsorted(at, docs), len(at) - 1)
            total[docs] += np.where(at[where] == docs, w * value[where], 0.0)
            if len(docs) > k:
                bar = np.partition(total[docs], len(docs) - k)[len(docs) - k]
                docs = docs[total[docs] + rest >= bar - SLACK]
    if docs is None:
        docs = np.flatnonzero(met)
    return docs, total[docs], len(docs)


def ranked_block(left: pa.Table, right: pa.Table, k: int) -> Iterator[tuple[int, pa.Array, np.ndarray, int]]:
    """(row of ``right`` with the question, its chunks, their scores, number scored) of the questions of a block."""
    if not len(left) or not len(right):
        return
    chunks = left.column("chunk_id").combine_chunks().dictionary_encode()
    terms = right.column("term").combine_chunks().dictionary_encode()
    code = pc.index_in(left.column("term").combine_chunks(), value_set=terms.dictionary).to_numpy(zero_copy_only=False)
    doc, impact = chunks.indices.to_numpy(), left.column("impact").to_numpy()
    order = np.lexsort((doc, code))
    order = order[~np.isnan(code[order].astype(float))]
    code, doc, impact = code[order].astype(np.int64), doc[order], impact[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    impacts = {int(code[s]): (doc[s:e], impact[s:e]) for s, e in zip(starts, np.r_[starts[1:], len(code)])}
    asked = right.column("query_id").combine_chunks().dictionary_encode().indices.to_numpy()
    by_question = np.argsort(asked, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(asked[by_question]) != 0])
    weight, code = right.column("weight").to_numpy(), terms.indices.to_numpy()
    for s, e in zip(cuts, np.r_[cuts[1:], len(by_question)]):
        rows = by_question[s:e]
        docs, scores, scored = best_of_block(impacts, list(zip(code[rows].tolist(), weight[rows].tolist())), len(chunks.dictionary), k)
        yield int(rows[0]), chunks.dictionary.take(pa.array(docs)), scores, scored


def bm25(chunks: DataFrame, questions: DataFrame, k: int, by: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """(*by, query_id, chunk_id, score, rank): the ``k`` best of (chunk_id, text) for each of (query_id, text).

    Terms with a negative inverse frequency get EPSILON times the mean over the vocabulary. Words of
    a question count as often as they occur. Scores are rounded to six places; what is equal then is in
    the order of chunk_id, so that the ranking does not hang on the order of summation. A question
    without a word that any chunk has gives no row; nulls are empty texts; chunk_id is a key. With
    ``by``, columns of ``chunks``, every question is asked in each group, whose statistics are its own;
    chunks with a null group are left out.

    Texts are read once. The postings of asked words are dealt into blocks of about ``block`` documents;
    each block meets the questions in bounded parts and gives at most ``k`` rows for each.
    """
    ix, asked = Index(chunks, by), written(asked_words(questions), "asked")
    rows, counts = ix.blocks(asked, block)
    parts = asked.count() // ASKED + 1
    weighed = asked.join(ix.idf(), "term").select(*by, "query_id", "term", (F.col("qf") * F.col("idf")).alias("weight"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part"))
    met = ix.known(weighed, counts).select(*by, "query_id", "term", "weight", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    names = [f"_by{i}" for i in range(len(by))]  # apart from those of the other side
    dealt = rows.select(
        *(F.col(c).alias(n) for c, n in zip(by, names)), F.col("block").alias("_block"), "chunk_id", "term", "impact",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("_part"),
    )
    kinds = [f"{c} {chunks.schema[c].dataType.simpleString()}" for c in by] + [f"query_id {questions.schema['query_id'].dataType.simpleString()}", f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}"]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row, found, scores, _ in ranked_block(left, right, k):
            scores = np.round(scores, 9)
            places = pc.sort_indices(pa.table({"c": found, "s": np.round(scores, 6)}), sort_keys=[("s", "descending"), ("c", "ascending")])[:k]
            one = lambda c: pa.repeat(right.column(c)[row], len(places))  # noqa: B023, E731
            out.append(pa.table([*(one(c) for c in by), one("query_id"), found.take(places), pa.array(scores).take(places)], names=[*by, "query_id", "chunk_id", "score"]))
        return pa.concat_tables(out) if out else empty

    empty = pa.table({f.name: pa.array([], f.type) for f in to_arrow_schema(chunks.select(*by, F.lit(0).alias("query_id"), "chunk_id", F.lit(0.0).alias("score")).withColumn("query_id", F.lit(None).cast(questions.schema["query_id"].dataType)).schema)})
    found = dealt.groupBy(*names, "_block", "_part").cogroup(met.groupBy(*by, "block", "part")).applyInArrow(best, ", ".join([*kinds, "score double"]))
    rounded = found.withColumn("score", F.round("score", 6))
    place = F.row_number().over(Window.partitionBy(*by, "query_id").orderBy(F.desc("score"), "chunk_id"))
    return rounded.withColumn("rank", place).filter(F.col("rank") <= k)
