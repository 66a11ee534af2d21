"""Ingestion by micro-batches that is written once, however often a batch runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LEDGER = "_ledger"


def noted(spark: SparkSession, path: str, name: str, batch: int) -> bool:
    """Whether the ledger of ``path`` has the batch: its entry is complete once Spark has marked it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{LEDGER}/query={name}/batch={batch}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_once(batch: DataFrame, batch_id: int, path: str, name: str, by: str | None = None, fmt: str = "parquet") -> bool:
    """The rows of a batch in a folder of its own, then its entry in the ledger; False if it was there already.

    A batch that failed between the two, or in the middle of either, is written again over its own folder.
    """
    spark = batch.sparkSession
    if noted(spark, path, name, batch_id):
        return False
    folder = f"{path}/query={name}/batch={batch_id}"
    out = batch.write.mode("overwrite").format(fmt)
    (out.partitionBy(by) if by else out).save(folder)
    rows = spark.read.schema(batch.schema).format(fmt).load(folder).count()
    spark.createDataFrame([(rows,)], "rows long").coalesce(1).write.mode("overwrite").json(f"{path}/{LEDGER}/query={name}/batch={batch_id}")
    return True


def ingest(stream: DataFrame, path: str, checkpoint: str, name: str, by: str | None = None, fmt: str = "parquet") -> StreamingQuery:
    """All rows that are there, batch by batch, each written once under (``name``, batch id)."""
    each = lambda df, i: write_once(df, i, path, name, by, fmt) and None
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(query, batch, rows) of the ledger."""
    return spark.read.schema("rows long, query string, batch long").json(f"{path}/{LEDGER}").select("query", "batch", "rows")


def ingested(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """The rows of the batches that the ledger has, with their ``query`` and ``batch``; what a failed batch left is not read."""
    rows = spark.read.schema(f"{schema}, query string, batch long").format(fmt).load(path)
    known = entries(spark, path).select("query", "batch")
    return rows.join(known, ["query", "batch"], "left_semi").select(*[c for c in rows.columns if c not in ("query", "batch")], "query", F.col("batch").cast("long").alias("batch"))
