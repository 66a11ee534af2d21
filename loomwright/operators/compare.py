"""Two tables compared as bags of rows, without a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = ("double", "float", "decimal")


def cell(df: DataFrame, c: str, digits: int, shift: float) -> Column:
    """A column's value as text: numbers on a grid of ``digits`` decimals, shifted by part of its width; null apart."""
    if not df.schema[c].dataType.simpleString().startswith(NUMBERS):
        return F.coalesce(F.to_json(F.struct(F.col(c))), F.lit("null"))
    number = F.col(c).cast("double")
    odd = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(odd, F.coalesce(number.cast("string"), F.lit("null"))).otherwise(F.floor(number * 10.0**digits + 0.5 + shift).cast("string"))


def bags(df: DataFrame, names: list[str], digits: int, shift: float) -> DataFrame:
    """(row, k, n): equal rows as one, with how often they are there."""
    key = F.sha2(F.array_join(F.array(*[F.concat(F.length(cell(df, c, digits, shift)), F.lit(":"), cell(df, c, digits, shift)) for c in names]), ""), 256)
    return df.select(key.alias("k"), F.struct(*names).alias("row"), *(["n"] if "n" in df.columns and "n" not in names else [F.lit(1).alias("n")]))


def less(left: DataFrame, right: DataFrame, names: list[str], digits: int, shift: float) -> tuple[DataFrame, DataFrame]:
    """What the bags of (names, n) have beyond each other, in one join of counts by digest."""
    from ..sources.sinks import written

    one = lambda df: bags(df, names, digits, shift).groupBy("k").agg(F.min("row").alias("row"), F.sum("n").alias("n"))
    both = one(left).withColumnsRenamed({"row": "a", "n": "x"}).join(one(right).withColumnsRenamed({"row": "b", "n": "y"}), "k", "full")
    more = F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0))
    both = written(both.withColumn("more", more).filter("more <> 0"), "beyond")
    return both.filter("more > 0").select("a.*", F.col("more").alias("n")), both.filter("more < 0").select("b.*", (-F.col("more")).alias("n"))


def compare(left: DataFrame, right: DataFrame, digits: int = 6, first: int = 20) -> tuple[DataFrame, DataFrame]:
    """(n_left, n_right, n_same, only_left, only_right), and (place, column, left, right) of the first cells that differ.

    Columns are matched by name, and must be the same on both sides. Rows are equal if their numbers lie in
    the same cells of a grid of ``digits`` decimals, or of one shifted by half a cell, and all else is the
    same; so numbers closer than half a cell are equal, but that a row may be told apart if one of its
    numbers meets on one grid alone and another on the other alone. Rows count as often as they are
    there; nulls are equal, NaN too. What differs is put in order on both sides and shown place by place.
    """
    if set(left.columns) != set(right.columns):
        raise ValueError(f"columns on one side alone: {sorted(set(left.columns) ^ set(right.columns))}")
    names = sorted(left.columns)
    a, b = less(left.select(*names), right.select(*names), names, digits, 0.0)
    a, b = less(a, b, names, digits, 0.5)
    total = lambda df, name, what: df.agg(what.alias(name))
    count = F.coalesce(F.sum("n"), F.lit(0).cast("long"))
    sums = total(left, "n_left", F.count("*")).crossJoin(total(right, "n_right", F.count("*"))).crossJoin(total(a, "only_left", count)).crossJoin(total(b, "only_right", count))
    report = sums.select("n_left", "n_right", (F.col("n_left") - F.col("only_left")).alias("n_same"), "only_left", "only_right")

    def head(df: DataFrame, side: str) -> DataFrame:
        # ``first`` rows at most
        texts = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in names]))
        rows = df.orderBy(*names).limit(first).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("rows"))
        return rows.select(F.posexplode("rows").alias("place", "r")).select("place", "r.*").select("place", F.explode(texts).alias("column", side))

    cells = head(a, "left").join(head(b, "right"), ["place", "column"], "full").filter(~F.col("left").eqNullSafe(F.col("right")))
    return report, cells.orderBy("place", "column")
