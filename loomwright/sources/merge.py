"""A table of keyed rows that takes new versions by writing anew only the buckets they fall into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import written

BUCKET = "_bucket"


def newest(rows: DataFrame, key: str, version: str, late: str) -> DataFrame:
    """One row of each key: that of the highest ``version`` (null: before all), then of the highest ``late``."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(whole, F.struct(version, late)).alias("_row")).select("_row.*")


def keyed(spark: SparkSession, path: str) -> DataFrame:
    """The table as it is, without the column of its buckets."""
    return spark.read.parquet(path).drop(BUCKET)


def merge(updates: DataFrame, path: str, key: str, version: str, buckets: int = 64, exists: bool = True) -> int:
    """``updates`` merged into the table in ``path``, made where it does not exist; how many buckets were written.

    Rows are dealt into ``buckets`` folders by a hash of their key (as many as when the table was made). Of
    each key the row with the highest version stays, whether it is stored or new; of equal versions the
    new one. Buckets without updates are neither read nor written. What is written is first written
    aside, so that a job that fails leaves the table readable and can run again. Rows with a null
    key are left out; columns must be those of the table.
    """
    spark = updates.sparkSession
    dealt = updates.filter(F.col(key).isNotNull()).withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).withColumn("_late", F.lit(1))
    came = newest(dealt, key, version, "_late")
    if exists:
        touched = [r[0] for r in dealt.select(BUCKET).distinct().collect()]  # at most ``buckets``
        stored = spark.read.parquet(path).filter(F.col(BUCKET).isin(touched)).withColumn("_late", F.lit(0))
        came = newest(stored.unionByName(came), key, version, "_late")
    rows = written(came.drop("_late"), "merged")
    rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return rows.select(BUCKET).distinct().count()
