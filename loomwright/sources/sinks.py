"""Writers: JSON lines, CSV with a byte order mark, logs, tables, vector exports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors see: under ``spark.checkpoint.dir``, or where that is unset
    on a local master in the machine's temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="loomwright-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new folder that all see and read again: computed once, its lineage cut, its size known."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv_bom(df: DataFrame, path: str, sep: str = ";") -> None:
    """Delimited files that begin with a byte order mark, before the header of each."""
    first, *rest = df.columns
    df.select(F.col(first).alias(BOM + first), *rest).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def read_csv_bom(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    rows = spark.read.option("header", True).option("sep", sep).csv(path)
    return rows.toDF(*[c.lstrip(BOM) for c in rows.columns])


def append_log(events: DataFrame, path: str, flow: str) -> None:
    """Events as JSON lines after those already there, each tagged with its flow."""
    events.withColumn("_fluxo", F.lit(flow)).write.mode("append").json(path)


def write_report(metrics: DataFrame, path: str, **stamp: str) -> None:
    """One row of metrics and what it is stamped with, as one JSON object."""
    metrics.select("*", *[F.lit(v).alias(k) for k, v in stamp.items()]).coalesce(1).write.mode("overwrite").json(path)


def replace_table(df: DataFrame, name: str, path: str) -> DataFrame:
    """The table ``name`` made anew of ``df`` in ``path``."""
    df.write.mode("overwrite").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def vector_bytes(v: Column) -> Column:
    """Little-endian 32-bit floats of an array, one after the other, as the vector's binary export."""
    import numpy as np

    return F.pandas_udf(lambda s: s.map(lambda x: np.asarray(x, "<f4").tobytes(), na_action="ignore"), "binary")(v)
