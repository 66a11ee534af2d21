"""Registered queries of streams, of files with sentences, and of fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnose, learn
from ..sources import files, sinks
from ..streaming import ledger, masking
from .registry import _sql_mask, query


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def st_ingest_batches(t):
    """Orders as a stream of files, ingested batch by batch, each written once, and read back. Then the stream's
    progress is lost and it starts again from its first batch, which adds nothing."""
    source, path = sinks.scratch(t.spark, "arriving"), sinks.scratch(t.spark, "ingested")
    t.orders.select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year")).repartition(3).write.parquet(source)
    stream = t.spark.readStream.schema("o_orderkey long, o_totalprice double, year int").option("maxFilesPerTrigger", 1).parquet(source)
    for progress in ("progress", "lost"):
        ledger.ingest(stream, path, sinks.scratch(t.spark, progress), "orders", "year").awaitTermination()
    rows = ledger.ingested(t.spark, path, "o_orderkey long, o_totalprice double, year int")
    return rows.groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"SELECT conv_id * 1000 + turn AS stream_id, {_sql_mask('text')} AS masked FROM conversations WHERE length(text) > 0")
def st_mask_stream(t):
    """Turns cut into fragments of 7 characters, streamed, masked across the cuts, and joined again."""
    source, path = sinks.scratch(t.spark, "fragments"), sinks.scratch(t.spark, "masked")
    said = t.conversations.filter("length(text) > 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), "text")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 7).cast("int")), lambda i: F.substring(F.col("text"), i * 7 + 1, F.lit(7)))
    cut = said.select("stream_id", F.length("text").alias("n"), F.posexplode(pieces).alias("pos", "piece"))
    cut.select("stream_id", "pos", "piece", (F.col("pos") == F.floor((F.col("n") - 1) / 7)).alias("last")).write.parquet(source)
    stream = t.spark.readStream.schema("stream_id long, pos int, piece string, last boolean").parquet(source)
    masking.mask_available(stream, path, sinks.scratch(t.spark, "progress"))
    return t.spark.read.schema("stream_id long, text string").parquet(path).select("stream_id", F.col("text").alias("masked"))



@query("SELECT md5(array_to_string(w, ' ')) AS digest, CAST(len(w) AS BIGINT) AS n, CAST(len(list_filter(w, lambda x: length(x) > 6)) AS BIGINT) AS n_tagged FROM (SELECT list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0")
def src_conll(t):
    """Passages written as lines of a word and its tag, and read back as sentences."""
    path = sinks.scratch(t.spark, "conll")
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    line = lambda x: F.concat(x, F.lit(" "), F.when(F.length(x) > 6, "B-LOCAL").otherwise("O"))
    t.benchmark.select(F.concat(F.array_join(F.transform(words, line), "\n"), F.lit("\n")).alias("value")).write.text(path)
    rows = files.read_conll(t.spark, path)
    return rows.select(F.md5(F.array_join("tokens", " ")).alias("digest"), F.size("tokens").cast("long").alias("n"), F.size(F.filter("tags", lambda x: x != "O")).cast("long").alias("n_tagged"))


def labelled(t):
    words = F.size(F.split("text", " ")).cast("double")
    return t.documents.join(t.labels, "doc_id").select("doc_id", "quality", "lang", F.col("n_chars").cast("double").alias("size"), words.alias("words"), (F.col("n_chars") / words).alias("mean"))


NUMERIC = ["size", "words", "mean"]


def _parts(t):
    """The labelled documents in two parts, each with its share of both labels: to fit on, and to score."""
    dealt = learn.split_stratified(labelled(t), "doc_id", "quality", 0.7)
    return dealt.filter("not held_out").drop("held_out"), dealt.filter("held_out").drop("held_out")


def _judged(t, model, fit):
    """Areas under the ROC and the precision-recall curve of rows that the model was not fitted on."""
    known, held = _parts(t)
    said = fit(known).transform(held)
    row = (model, known.count(), held.count(), diagnose.area(said, "quality"), diagnose.area(said, "quality", "areaUnderPR"))
    return t.spark.createDataFrame([row], "model string, n_fit long, n_held long, auc double, pr_auc double")


def _area(t, model):
    return _judged(t, model, lambda known: learn.fit(known, "quality", NUMERIC, ["lang"], model))


@query()
def ml_logreg(t):
    return _area(t, "logistic")


@query()
def ml_tree(t):
    return _area(t, "tree")


@query()
def ml_rf(t):
    return _area(t, "forest")


@query()
def ml_gbt(t):
    return _area(t, "boosted")


@query()
def ml_mlp(t):
    return _judged(t, "perceptron", lambda known: learn.perceptron(known, "quality", NUMERIC, (8, 4)))


@query()
def ml_importance(t):
    fitted = learn.fit(labelled(t), "quality", NUMERIC, [], "tree")
    return t.spark.createDataFrame(learn.importances(fitted, NUMERIC), "feature string, weight double")


@query()
def ml_cv(t):
    return diagnose.cross_validate(labelled(t), "doc_id", "quality", NUMERIC, [], "tree", 3)


@query()
def ml_validation_curve(t):
    return diagnose.validation_curve(labelled(t), "doc_id", "quality", NUMERIC, [], (2, 6))


@query()
def ml_kmeans(t):
    return learn.clusters(labelled(t), NUMERIC, (2, 3))[0].select("doc_id", "cluster")
