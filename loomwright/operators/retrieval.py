"""Ranking of passages: BM25, dense inner products, reciprocal rank fusion, and its evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..sources.sinks import written
from .impact import FOLDED, bm25, spread
from .quantiles import exact_quantiles

K_RRF = 60


def top(scored: DataFrame, k: int, *by: str, query: str = "query_id", item: str = "chunk_id", score: str = "score") -> DataFrame:
    w = Window.partitionBy(*by, query).orderBy(F.desc(score), item)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Questions that meet all vectors in one pass, and rows of vectors multiplied at a time.
ASKED, ROWS = 2048, 1024


def dense(vectors: DataFrame, questions: DataFrame, k: int, asked: int = ASKED) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` largest inner products of (chunk_id, v) with each of a stated set of
    questions (query_id, q), rounded to six places, ties to the smaller chunk_id.

    Questions go to every task in blocks of about ``asked``, dealt by hash; a task multiplies its vectors with
    them as matrices, and ``k`` rows a question leave each piece of it. Null vectors, and those of
    another length than the block's first question, are left out; so are questions like these.
    """
    spark, found = vectors.sparkSession, None
    n = questions.count() // asked + 1
    kinds = f"query_id {questions.schema['query_id'].dataType.simpleString()}, chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, score double"
    for i in range(n):
        block = questions.filter((F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) & F.col("q").isNotNull()).select("query_id", "q").toArrow()
        if not len(block):
            continue
        wide = len(block["q"][0])
        same = pc.equal(pc.list_value_length(block["q"]), wide)
        block = block.filter(same)
        ids = block["query_id"].combine_chunks()
        shared = spark.sparkContext.broadcast((ids, block["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, wide)))
        met = vectors.select("chunk_id", "v").mapInArrow(multiplied(shared, wide, k), kinds)  # a filter here would make the vectors twice
        found = met if found is None else found.unionByName(met)
    if found is None:
        return vectors.limit(0).join(questions.limit(0)).select("query_id", "chunk_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).filter("false")
    return top(found.withColumn("score", F.round("score", 6)), k)


def multiplied(shared: Broadcast, wide: int, k: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column("v")), wide))
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                keys = pc.array_sort_indices(rows.column("chunk_id"))  # so that places are in the order of ids
                rows = rows.take(keys)
                v = rows.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)
                score = q @ v.T
                best = np.argsort(-np.round(score, 6), axis=1, kind="stable")[:, :k]
                asked = np.repeat(np.arange(len(q)), best.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(asked)), rows.column("chunk_id").take(pa.array(best.ravel())), pa.array(np.take_along_axis(score, best, axis=1).ravel())], ["query_id", "chunk_id", "score"]
                )

    return of


def fuse(rankings: list[DataFrame], k: int, k_rrf: int = K_RRF) -> DataFrame:
    """Sum of 1 / (k_rrf + rank) over the rankings."""
    rows = rankings[0].select("query_id", "chunk_id", "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select("query_id", "chunk_id", "rank"))
    return top(rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k_rrf + F.col("rank"))), 9).alias("score")), k)


def evaluate(ranking: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Recall at each k, hit at 5 and reciprocal rank by question; no relevant hit counts as 0."""
    hits = ranking.join(gold.withColumn("rel", F.lit(1)), ["query_id", "chunk_id"]).groupBy("query_id").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks], F.min("rank").alias("first")
    )
    asked = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return asked.join(hits, "query_id", "left").select(
        "query_id", "n_gold", *[F.round(zero(f"h{k}") / F.col("n_gold"), 6).alias(f"recall_{k}") for k in ks],
        (zero("h5") > 0).cast("int").alias("hit_5"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr"),
    )


def in_force_or_all(rows: DataFrame, query: str, flag: str) -> DataFrame:
    """The rows of each query that are in force; all of them where none is."""
    some = rows.groupBy(query).agg(F.max(flag).alias("_some"))
    return rows.join(some, query).filter(F.col(flag) | ~F.col("_some")).drop("_some")


def lexical(question: Column, passage: Column) -> Column:
    """A stand-in for a model that scores pairs: the share of the question's distinct words that the passage has."""
    asked = F.array_distinct(tokens(question))
    return F.round(F.size(F.array_intersect(asked, tokens(passage))) / F.greatest(F.size(asked), F.lit(1)), 6)


def rerank(ranking: DataFrame, scores: DataFrame, candidates: int) -> DataFrame:
    """``ranking`` (query_id, chunk_id, rank) with the first ``candidates`` ordered by ``scores``
    (query_id, chunk_id, model); the rest stays behind them in its order."""
    head = F.col("rank") <= candidates
    scored = ranking.join(scores, ["query_id", "chunk_id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.when(head, 0).otherwise(1), F.when(head, -F.col("model")).otherwise(F.col("rank")), "rank")
    return scored.withColumn("place", F.row_number().over(order)).select("query_id", "chunk_id", F.col("place").alias("rank"), F.when(head, F.col("model")).alias("model"))


def letter_shares(texts: pa.Array) -> pa.Array:
    """How often each letter a to x occurs in the lower-cased texts, in unit length (all 0 for none)."""
    said = texts.cast(pa.large_string()).fill_null("")
    _, ends, data = said.buffers()
    cut = np.frombuffer(ends, np.int64)[said.offset : said.offset + len(said) + 1] if len(said) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    counts = np.zeros((len(said), 24))
    for row, (start, end) in enumerate(zip(cut[:-1], cut[1:])):
        seen = np.bincount(data[start:end], minlength=128)
        counts[row] = seen[97:121] + seen[65:89]
    for letter, lower in FOLDED.items():
        counts[:, ord(lower[0]) - 97] += pc.count_substring(said, letter).to_numpy(zero_copy_only=False)
    norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    shares = np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(said) + 1, dtype=np.int32) * 24), pa.array(shares.ravel()))


def letters(c: Column) -> Column:
    """A stand-in for an embedding: ``letter_shares``, one pass over a text."""

    def of(texts: pa.Array) -> pa.Array:
        return letter_shares(texts)

    return F.arrow_udf(of, "array<double>")(c)


def embedded(chunks: DataFrame, embed=letters) -> DataFrame:
    """(chunk_id, v) of (chunk_id, text), small inputs dealt over all cores before their vectors are made."""
    return spread(chunks.select("chunk_id", "text")).select("chunk_id", embed(F.col("text")).alias("v"))


def hybrid(chunks: DataFrame, questions: DataFrame, mode: str, k: int, candidates: int = 20, scorer=None, embed=letters) -> DataFrame:
    """(query_id, chunk_id, rank) of the ``k`` best by ``mode`` dense, bm25 or hybrid: ``candidates`` of each
    ranking, fused where both are asked for, then reordered by ``scorer`` (question, passage) if given. ``embed`` makes a text's vector."""
    if mode not in ("dense", "bm25", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    found = []
    if mode != "dense":
        found.append(bm25(chunks, questions, candidates))
    if mode != "bm25":
        found.append(dense(embedded(chunks, embed), questions.select("query_id", embed(F.col("text")).alias("q")), candidates))
    ranking = (fuse(found, candidates) if len(found) > 1 else found[0]).select("query_id", "chunk_id", "rank")
    if scorer is not None:
        pairs = ranking.join(questions.select("query_id", F.col("text").alias("_q")), "query_id").join(chunks.select("chunk_id", F.col("text").alias("_c")), "chunk_id")
        ranking = rerank(ranking, pairs.select("query_id", "chunk_id", scorer(F.col("_q"), F.col("_c")).alias("model")), candidates)
    return ranking.filter(F.col("rank") <= k).select("query_id", "chunk_id", "rank")


def report(evaluated: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row for each k: mean recall, its ceiling with as many relevant chunks, and recall as a share of
    what fits into k places; with the share of questions with a hit and its interval."""
    from .metrics import wilson

    rows = evaluated.select("n_gold", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"recall_{k}").alias("recall")) for k in ks])).alias("r")).select("n_gold", "r.*")
    fits = F.least("k", "n_gold")
    out = rows.groupBy("k").agg(
        F.count("*").alias("n"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg(fits / F.col("n_gold")), 4).alias("ceiling"),
        F.round(F.avg(F.col("recall") * F.col("n_gold") / fits), 4).alias("recall_norm"), F.count_if(F.col("recall") > 0).alias("hits"),
    )
    lo, hi = wilson(F.col("hits"), F.col("n"))
    return out.select("*", F.round(F.col("hits") / F.col("n"), 4).alias("hit_rate"), lo.alias("lo"), hi.alias("hi"))


def separation(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """Tenth, half and nine tenths of the best scores of questions with a relevant chunk, and of those without."""
    best = ranking.filter("rank = 1").select("query_id", "score").join(gold.select("query_id").distinct().withColumn("_g", F.lit(True)), "query_id", "left")
    split = written(best.select(F.coalesce("_g", F.lit(False)).alias("answerable"), "score"), "best")
    parts = exact_quantiles(split, ["answerable"], "score", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    counts = split.groupBy("answerable").agg(F.count("*").alias("n"))
    return counts.join(parts, "answerable").select("answerable", "n", *(F.round(p, 3).alias(p) for p in ("p10", "p50", "p90")))
