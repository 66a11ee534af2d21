"""One registered query for each operator: the operator over its whole table, and digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, chat, jpeg, lines, lm, mixing, packing, quality, secret_spans, simhash, toxicity, trie
from .common import fold, table


def _fold_is(n: int, k: int) -> F.Column:
    """Whether the id falls in the fold; false for a null id, from which nothing is learnt either."""
    return F.coalesce(fold("doc_id", n) == k, F.lit(False))


def op1_nearest_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def _toxic_model(docs: DataFrame, labels: DataFrame):
    return toxicity.train(docs.filter(fold("doc_id", 5) != 0), labels)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = _toxic_model(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs, model, out="score")
    return scored.select("doc_id", _fold_is(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.train(docs.filter(fold("doc_id", 4) != 2), table(spark, sf_dir, "labels"))
    scored = quality.quality(docs, net, out="score")
    return scored.select("doc_id", _fold_is(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, distance=4)
    return found.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op6_subword_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lm.score_texts(docs, F.coalesce(fold("doc_id", 7) != 2, F.lit(False)))
    return scored.select(
        "doc_id", _fold_is(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score"
    )


def op7_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.read_back(jpeg.to_media(table(spark, sf_dir, "documents")))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return lines.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"))


def op12_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_tree(table(spark, sf_dir, "conversations"))


def op13_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_spans.find_secrets(docs, secret_spans.train(docs))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    base = of(*secret_spans.KINDS)
    return found.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in secret_spans.KINDS),
        F.sha2(secret_spans.written_out(base).cast("binary"), 256).alias("base_sha256"), secret_spans.written_out(F.col("spans")).alias("spans"),
    )


QUERIES = {f.__name__: f for f in (
    op1_nearest_codes, op2_toxicity, op3_chat_repair, op4_quality, op5_simhash, op6_subword_lm, op7_progressive_jpeg,
    op8_best_fit_packing, op9_line_dedup, op10_source_mix, op11_align_tokens, op12_prefix_tree, op13_secret_spans,
)}

#: The others have no SQL that says the same; tests/llm holds them against brute force.
ORACLES = {"op9_line_dedup": lines.oracle(), "op10_source_mix": mixing.oracle(), "op12_prefix_tree": trie.oracle()}
