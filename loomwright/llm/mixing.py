"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from .common import SLAB, checkpointed, running_sum

WEIGHTS = (5, 2, 1)
#: Expected copies are whole multiples of 1 / UNIT, so that prefix sums are exact.
UNIT = 1 << 24
SEED = 42
SPACES = np.array([c in b" \t\n\r\x0b\f" for c in range(256)])


def count_words(text: str | None) -> int:
    """How many ``[^\\x20\\x09-\\x0D]+`` a text has; 0 for null."""
    if not text:
        return 0
    data, n, before = text.encode("utf-8", "surrogatepass"), 0, True
    for at in range(0, len(data), SLAB):
        space = SPACES[np.frombuffer(data, np.uint8, min(SLAB, len(data) - at), at)]
        n += int(np.count_nonzero(space[:-1] & ~space[1:])) + int(before and not space[0])
        before = bool(space[-1])
    return n


@F.pandas_udf(LongType())
def word_count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([count_words(t) for t in s], dtype="int64")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all
    sizes. A target stops at ``most`` times its source's size and the excess is shared again by
    weight: with sources sorted by cap over weight, those up to the first k at which the common
    level fits are capped, all others get level times weight. One row for each source is sorted.
    """
    everything = Window.partitionBy()
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.select(
        "source", "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int") + 1).alias("w"),
        (F.col("source_size") * F.lit(float(most))).alias("cap"), F.sum("source_size").over(everything).alias("all"),
    )
    after = everything.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto = after.rowsBetween(Window.unboundedPreceding, -1)
    leveled = weighed.withColumn(
        "level",  # if this source and all after it were below their caps
        (F.col("all") * F.lit(float(share)) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
        / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))),
    ).withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)
    return leveled.withColumn("l", level.getField("level")).select(
        "source", "source_size", F.when(F.col("l").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("l") * F.col("w"))).alias("target")
    )


def offset(source: str, seed: int = SEED) -> F.Column:
    """The source's random start, in units: 24 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(source), F.lit("\u0000")))), 1, 6), 16, 10).cast("long")


def systematic_copies(items: DataFrame, group: str, order: list[str], expected: str, seed: int = SEED) -> DataFrame:
    """Adds ``copies``: how many whole numbers the running sum of ``expected`` (in 1/UNIT copies)
    crosses at this row, the sum in ``group`` starting at one random offset."""
    summed = running_sum(items, [group], order, expected, "before")
    start = F.col("before") + offset(group, seed)
    unit = F.lit(UNIT)
    return summed.withColumn(
        "copies", F.floor((start + F.col(expected)) / unit).cast("long") - F.floor(start / unit).cast("long")
    ).drop("before")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row for each row of ``docs``.

    Every document of a source expects target / source_size copies, at most ``most``; sources are
    walked in order of size, so that what a source takes differs from its target by about its
    largest document. Null texts have size 0. A source without words has target 0 and takes
    nothing. Null sources form one source, which comes last. Repeated rows count each.
    """
    sized = checkpointed(docs.select("doc_id", "source", word_count("text").alias("size")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, share, most, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    same = F.col("d.source").eqNullSafe(F.col("t.source"))
    items = sized.alias("d").join(targets.alias("t"), same).select(
        "d.doc_id", "d.source", "d.size", "t.source_size", "t.target", F.round(rate * UNIT).cast("long").alias("expected")
    )
    drawn = systematic_copies(items, "source", ["size", "doc_id"], "expected", seed)
    return drawn.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, **how) -> DataFrame:
    """``docs``, each as often as the mix takes it. The mix is drawn for each doc_id once; rows that
    repeat a doc_id all get the copies of its first. Rows with a null doc_id are emitted once."""
    named = docs.filter("doc_id is not null")
    drawn = mix(named, **how).groupBy("doc_id").agg(F.min("copies").alias("copies")).filter("copies > 0")
    whole = named.select(F.struct(*docs.columns).alias("doc"))  # columns of whatever names
    again = whole.join(drawn, F.col("doc.doc_id") == drawn["doc_id"]).select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return again.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns]).unionByName(docs.filter("doc_id is null"))


def oracle(share: float = 1.5, most: float = 2.0, seed: int = SEED) -> str:
    """DuckDB SQL for (doc_id, size, source_size, target, taken) with the weights 5, 2, 1."""
    return f"""
    WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
    totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
    weighed AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w,
        source_size * {most}::DOUBLE AS cap, sum(source_size) OVER () AS everything FROM totals),
    leveled AS (SELECT *, (CAST(everything AS DOUBLE) * {share}::DOUBLE - coalesce(sum(cap) OVER u, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER u, 0)) AS level
        FROM weighed WINDOW u AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    targets AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / w) FROM leveled WHERE level * w <= cap) * w, cap)) AS target FROM leveled),
    rated AS (SELECT s.*, t.source_size, t.target, CAST(round(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END * {UNIT}) AS HUGEINT) AS expected,
        CAST('0x' || substr(md5('{seed}|' || coalesce(s.source, chr(0))), 1, 6) AS BIGINT) AS start
        FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
    summed AS (SELECT *, start + coalesce(sum(expected) OVER (PARTITION BY source ORDER BY size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM rated)
    SELECT doc_id, size, source_size, target, CAST(((b + expected) // {UNIT} - b // {UNIT}) * size AS BIGINT) AS taken FROM summed"""
