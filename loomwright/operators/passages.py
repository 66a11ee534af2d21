"""All places of all passages in texts, and what overlaps them."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of passages in one automaton; a longer passage has one of its own.
SHARD = 1 << 20


#: The automaton that a Python worker has built last, by its shard's name.
_BUILT: dict[str, object] = {}


def automaton(name: str, passages: Broadcast):
    """The shard's automaton, built once in each Python worker; a match gives the passage's digest and length."""
    import ahocorasick

    if name not in _BUILT:
        _BUILT.clear()
        found = ahocorasick.Automaton()
        for passage in passages.value:
            found.add_word(passage, (hashlib.md5(passage.encode()).digest(), len(passage)))
        found.make_automaton()
        _BUILT[name] = found
    return _BUILT[name]


def places(texts: DataFrame, passages: DataFrame, key: str, text: str, item: str, passage: str, shard: int = SHARD) -> DataFrame:
    """(key, item, start, end) of every place of every passage in every text, in characters.

    One walk over a text finds the places of all passages of a shard, those that overlap or lie inside
    each other included (Aho-Corasick). Distinct passages are dealt by hash into as many shards as their
    characters ask for, and a shard, which is bounded, goes to every task. Items with the same passage
    share its places. Null or empty texts and passages have no place; repeated texts have places each.
    """
    known = passages.filter(F.length(passage) > 0).select(F.col(item).alias("_item"), F.col(passage).alias("_passage"))
    distinct = known.select("_passage").distinct()
    chars = distinct.agg(F.sum(F.length("_passage"))).first()[0] or 0
    n = -(-chars // shard)
    spark, found = texts.sparkSession, []
    kind = texts.schema[key].dataType.simpleString()
    for i in range(n):
        words = [r[0] for r in distinct.filter(F.pmod(F.xxhash64("_passage"), F.lit(n)) == i).collect()]
        if words:
            walked = walk(spark.sparkContext.broadcast(words), uuid.uuid4().hex, key, text)
            found.append(texts.select(key, text).filter(F.length(text) > 0).mapInArrow(walked, f"_key {kind}, _digest binary, start int, end int"))
    if not found:
        empty = F.lit(0).alias("start"), F.lit(0).alias("end")
        return texts.select(key, *empty).limit(0).join(passages.select(item).limit(0)).select(key, item, "start", "end")
    named = known.select("_item", F.unhex(F.md5("_passage")).alias("_digest"))
    return reduce(DataFrame.unionByName, found).join(named, "_digest").select(F.col("_key").alias(key), F.col("_item").alias(item), "start", "end")


def walk(passages: Broadcast, name: str, key: str, text: str, rows: int = 50_000):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(name, passages)
        for batch in batches:
            keys, met = batch.column(key), []

            def out() -> pa.RecordBatch:
                row, digest, start, end = zip(*met) if met else ((),) * 4
                columns = [keys.take(pa.array(row, pa.int64())), pa.array(digest, pa.binary()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
                return pa.RecordBatch.from_arrays(columns, ["_key", "_digest", "start", "end"])

            for row, said in enumerate(batch.column(text)):  # one text at a time as a string
                for last, (digest, size) in found.iter(said.as_py()):
                    met.append((row, digest, last + 1 - size, last + 1))
                    if len(met) == rows:
                        yield out()
                        met.clear()
            yield out()

    return of


def overlapping(spans: DataFrame, windows: DataFrame, key: str, bin_size: int) -> DataFrame:
    """Pairs of rows of ``spans`` (key, start, end, ...) and ``windows`` (key, from, to, ...) of a key that share a character.

    Both are dealt into bins of ``bin_size`` characters and meet by key and bin, so that a long text's
    spans meet only the windows near them; a pair that shares several bins is kept in the first.
    """
    bins = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor((F.col(z) - 1) / bin_size))).alias("_bin")
    left = spans.filter(F.col("end") > F.col("start")).select("*", bins("start", "end"))
    right = windows.filter(F.col("to") > F.col("from")).select("*", bins("from", "to"))
    first = F.floor(F.greatest("start", "from") / bin_size)
    return left.join(right, [key, "_bin"]).filter((F.col("start") < F.col("to")) & (F.col("end") > F.col("from")) & (F.col("_bin") == first)).drop("_bin")
