"""A corpus, stage by stage: toxic documents go, boilerplate lines go, one document of each group of
near copies stays, sources are mixed to their weights, and what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import lines, mixing, packing, simhash, toxicity
from loomwright.llm.common import fold, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a classifier learnt from the labelled ones.

    Null and empty texts have a score as all others, that of a text without features; repeated rows
    and ties score alike; rows with a null doc_id are scored, but nothing is learnt from them. Without
    labels of both kinds, or without rows, all scores are alike and below 0.5 unless the labels say
    otherwise. Other columns stay as they are, whatever their names.
    """
    model = toxicity.train(docs.filter(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.scorer(docs, model)(F.col("text")) < 0.5)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines of five or more words that three or more sources show, but for each
    line's first place. What had words and has none left goes; ``n_chars`` is counted anew.

    Null texts stay null, empty ones empty; repeated rows lose the same lines; rows with a null doc_id
    stay as they are; a null source counts as none. Other columns stay, whatever their names.
    """
    kept = lines.dedup_lines(docs)
    bare = F.coalesce(F.col("text").rlike(r"^[\x20\x09-\x0D]*$"), F.lit(True))
    left = kept.filter(~((F.col("n_removed") > 0) & bare))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    if "n_chars" in names:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by fingerprints.

    Null, empty and wordless texts share fingerprint zero, so one of them stays; rows that repeat
    that doc_id stay all; rows with a null doc_id stay. Other columns stay, whatever their names.
    """
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for: not at all, once, or twice.

    Null and empty texts have no words and take part with size 0; a null source is one source, the
    last; rows that repeat a doc_id get the copies of one of them; rows with a null doc_id stay once.
    A source without words takes nothing. Other columns stay, whatever their names.
    """
    return mixing.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 1024 tokens.

    Null and empty texts are one end id; repeated rows are packed each, null ids stay null; very long
    texts are cut into full pieces; an empty table gives no piece. Other columns are not read.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash_near_dedup", drop_near_copies),
    ("source_mix", mix_sources), ("best_fit_packing", pack_sequences),
]

#: Classifier, fingerprints and tokenizer have no SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage's rows are written as Parquet to the shared folder and read
    again, so that no stage is computed twice and a lost executor costs no more than its stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
