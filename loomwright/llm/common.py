"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text that a task looks at in one go.
SLAB = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share: the context's own, else that of
    ``spark.checkpoint.dir``. Where neither names one a temporary folder is used, on a local master
    alone; a cluster without one is an error."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomwright-"))
        known = sc._jsc.sc().getCheckpointDir()
    return known.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    The folder is that of ``shared_folder``.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` written as Parquet to a folder of its own in the shared folder, and read again: its lineage
    is cut, and its size is known, where a checkpoint keeps the estimate made before it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % n


def hash_step(h: Column) -> Column:
    """A whole number for the size of a 64-bit hash: 16 steps for each halving, the smallest hashes last."""
    return F.floor(-F.log2(F.greatest(h / 2.0**64 + 0.5, F.lit(2.0**-60))) * 16)


def steps_within(counts: dict[int, int], sample: int) -> list[int]:
    """Steps that hold ``sample`` rows or fewer together, from the smallest hashes on; a step that does not
    fit, such as one with a much repeated row, is left out alone."""
    chosen, held = [], 0
    for step in sorted(counts, reverse=True):
        if held + counts[step] <= sample:
            held += counts[step]
            chosen.append(step)
    return chosen


def labelled(docs: DataFrame, labels: DataFrame, label: str, fits: Column, sample: int) -> DataFrame:
    """(doc_id, text, y) of at most ``sample`` rows of ``docs`` that ``fits`` and that are labelled 0 or
    1 (the larger of several labels), chosen by the hashes of their ids, in one partition.

    Which hashes is chosen from counts by size of hash, under 1200 of them, from the smallest on, so
    that ``sample`` rows or fewer are kept; an id repeated more often than that is passed over and costs
    its neighbours alone. Ids are chosen first, so that texts are not shuffled but for the rows chosen;
    the chosen ids go to every task.
    """
    marks = labels.filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    fit = docs.filter(fits)
    ids = fit.select("doc_id").join(marks, "doc_id").withColumn("step", hash_step(F.xxhash64("doc_id")))
    steps = steps_within({r["step"]: r["count"] for r in ids.groupBy("step").count().collect()}, sample)
    chosen = ids.filter(F.col("step").isin(steps)).select("doc_id", "y").distinct()
    rows = fit.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slabs(data: bytes, size: int = SLAB) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes, cut only before a space character."""
    if len(data) <= size:
        yield data
        return
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] not in b" \t\n\r\x0b\f":
            end += 1
        yield data[at:end]
        at = end


def ascii_words(text: str | None) -> Iterator[list[bytes]]:
    """Lists of the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased, slab by slab."""
    for slab in slabs((text or "").encode("utf-8", "surrogatepass")):
        yield slab.lower().split()


def met_evenly(rows: DataFrame, keys: DataFrame, on: str, count: str, most: int) -> DataFrame:
    """``rows`` joined with ``keys``, whose column ``count`` says how many of the rows a key has; it is left out.

    Keys of over ``most`` rows go to every task, so that none of them meets in one; they are at most
    1 / ``most`` of all rows.
    """
    hot, few = F.broadcast(keys.filter(F.col(count) > most)), keys.filter(F.col(count) <= most)
    rest = rows.join(hot.select(on), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(few, on)).drop(count)


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of the whole-number column ``value`` over the rows before this one
    within ``group`` in the order of ``order`` (nulls last), as a distributed prefix sum.

    Rows are dealt by range of (group, order), so a group of any size spreads over many pieces;
    sums inside a piece and sums of whole pieces are added. Integers keep it independent of the
    order of evaluation. ``order`` should end in a unique column.
    """
    keys = [F.col(c).asc_nulls_last() for c in (*group, *order)]
    pieces = df.repartitionByRange(partitions(df.sparkSession), *keys).withColumn("_piece", F.spark_partition_id())
    inside = Window.partitionBy("_piece", *group).orderBy(*keys[len(group):]).rowsBetween(Window.unboundedPreceding, -1)
    local = checkpointed(pieces.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0).cast("long"))))
    across = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        local.groupBy(*group, "_piece").agg(F.sum(value).alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(across), F.lit(0).cast("long"))).drop("_sum")
    )
    same = F.col("a._piece") == F.col("b._piece")
    for g in group:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    joined = local.alias("a").join(base.alias("b"), same)
    kept = [F.col(f"a.{c}") for c in df.columns]
    return joined.select(*kept, (F.col("a._local") + F.col("b._base")).alias(out))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected ``edges`` (u, v): the smallest node reachable.

    Alternates large-star and small-star steps until the edges stay the same. Minima are
    pre-aggregated and joined back, so a hub of any size is never gathered in one group.
    """
    def star(e: DataFrame, small: bool) -> DataFrame:
        # each row (u, v): v is a neighbour of u that the step looks at
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        joined = e.join(least, "u")
        if small:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        else:
            out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.filter("u <> v").distinct()

    now = checkpointed(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    )
    n = now.count()
    for _ in range(rounds):
        if not n:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        before, held = now, n
        now = checkpointed(star(star(both, False), True))
        n = now.count()
        if n == held and now.join(before, ["u", "v"], "left_anti").isEmpty():  # edges are distinct: as many and all known are the same
            break
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
