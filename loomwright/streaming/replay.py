"""Replays of requests against caches that forget what was used least recently."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def replay_lru(requests: DataFrame, cache: str, segment: Column, order: str, key: str, size: int = 128) -> DataFrame:
    """(cache, order, key, hit) of every request, where each cache holds the ``size`` keys used last.

    ``segment`` must not fall as ``order`` rises (the day of a time stamp, say). A cache at the start of
    a segment holds the keys used last before it, and these follow from the last ``size`` keys of
    each segment; so segments are replayed side by side, and a busy cache is many tasks. ``order`` must
    be unique in a cache. Requests with a null key are left out.
    """
    asked = requests.filter(F.col(key).isNotNull()).select(F.col(cache).alias("c"), segment.cast("string").alias("g"), F.col(order).alias("o"), F.col(key).alias("k"))
    kinds = dict(asked.dtypes)
    latest = Window.partitionBy("c", "g").orderBy(F.desc("o"))
    tails = asked.groupBy("c", "g", "k").agg(F.max("o").alias("o")).withColumn("r", F.row_number().over(latest)).filter(F.col("r") <= size)

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        """What the cache holds when each of its segments begins."""
        held, out = OrderedDict(), []
        for g, rows in pdf.sort_values(["g", "o"]).groupby("g", sort=True):
            out += [(rows["c"].iloc[0], g, i, k) for i, k in enumerate(held)]
            for k in rows["k"]:
                held[k] = None
                held.move_to_end(k)
            while len(held) > size:
                held.popitem(last=False)
        return pd.DataFrame(out, columns=["c", "g", "i", "k"])

    held = tails.select("c", "g", "o", "k").groupBy("c").applyInPandas(carry, f"c {kinds['c']}, g string, i long, k {kinds['k']}")
    both = held.select("c", "g", "i", F.lit(None).cast(kinds["o"]).alias("o"), "k").unionByName(asked.withColumn("i", F.lit(None).cast("long")))
    dealt = both.repartition("c", "g").sortWithinPartitions("c", "g", F.asc_nulls_last("i"), "o")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, known = None, OrderedDict()
        for pdf in batches:
            hits = []
            for c, g, i, k in zip(pdf["c"], pdf["g"], pdf["i"], pdf["k"], strict=True):
                at = (None if pd.isna(c) else c, g)
                if at != now:
                    now, known = at, OrderedDict()
                hits.append(k in known if pd.isna(i) else None)
                known[k] = None
                known.move_to_end(k)
                if len(known) > size:
                    known.popitem(last=False)
            out = pd.DataFrame({"c": pdf["c"], "o": pdf["o"], "k": pdf["k"], "hit": hits})
            yield out[pdf["i"].isna()]

    done = dealt.mapInPandas(run, f"c {kinds['c']}, o {kinds['o']}, k {kinds['k']}, hit boolean")
    return done.select(F.col("c").alias(cache), F.col("o").alias(order), F.col("k").alias(key), "hit")


def hit_rate(replayed: DataFrame, cache: str) -> DataFrame:
    return replayed.groupBy(cache).agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.count_if("hit") / F.count("*"), 3).alias("rate")
    )
