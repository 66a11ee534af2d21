"""Exact percentiles by distributed selection: no task ever holds a group."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Groups of up to so many rows are ranked as they are, in a few MB; of larger ones, cells of up to so many.
SMALL = 1 << 18
#: Cells of a round, as a power of two: a value's 64 bits are settled in six rounds at most.
BITS = 12
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def keys_of(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit keys in the order of the values; NaN is above all."""
    if values.dtype.kind == "i":
        return values.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    bits = (np.where(np.isnan(values), np.nan, values) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def values_of(key: int, whole: bool) -> float | int:
    if whole:
        return int(np.array([key ^ (1 << 63)], np.uint64).view(np.int64)[0])
    bits = key ^ (1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


@dataclass
class Search:
    """Where a rank of a group still lies: keys of ``lo`` to ``hi``, ``rank`` rows from there, ``rows`` in all."""

    group: tuple
    rank: int
    left: int
    lo: int
    hi: int
    rows: int

    def shift(self) -> int:
        return max((self.hi - self.lo).bit_length() - BITS, 0)


def counted(rows: DataFrame, searches: list[Search], by: list[str], value: str) -> dict[tuple, dict[int, int]]:
    """Rows by cell of each (group, lo, hi) that is searched, counted in the tasks before anything is shuffled."""
    asked: dict[tuple, list[tuple[int, int, int]]] = {}
    for s in searches:
        cell = (s.lo, s.hi, s.shift())
        if cell not in asked.setdefault(s.group, []):
            asked[s.group].append(cell)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(asked)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, sums = shared.value, {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            groups, at = group_numbers(table, by)
            keys = keys_of(table.column(value).to_numpy())
            for g, group in enumerate(groups):
                mine = keys[at == g] if by else keys
                for lo, hi, shift in asked.get(group, ()):
                    inside = mine[(mine >= np.uint64(lo)) & (mine <= np.uint64(hi))]
                    cells = np.bincount(((inside - np.uint64(lo)) >> np.uint64(shift)).astype(np.int64), minlength=1)
                    have = sums.setdefault((group, lo, hi), np.zeros(1 << BITS, np.int64))
                    have[: len(cells)] += cells
        numbers = {(g, lo, hi): i for i, (g, lo, hi) in enumerate((g, lo, hi) for g, cells in asked.items() for lo, hi, _ in cells)}
        for k, have in sums.items():
            cells = np.flatnonzero(have)
            yield pa.record_batch({"search": np.full(len(cells), numbers[k], np.int64), "cell": cells, "n": have[cells]})

    found = rows.mapInArrow(of, "search long, cell long, n long").groupBy("search", "cell").agg(F.sum("n").alias("n")).collect()
    order = [(g, lo, hi) for g, cells in asked.items() for lo, hi, _ in cells]
    out: dict[tuple, dict[int, int]] = {k: {} for k in order}
    for r in found:
        out[order[r["search"]]][r["cell"]] = r["n"]
    return out


def group_numbers(table: pa.Table, by: list[str]) -> tuple[list[tuple], np.ndarray]:
    """The distinct groups of a batch, and each row's place among them."""
    if not by:
        return [()], np.zeros(len(table), np.int64)
    place: dict[tuple, int] = {}
    at = np.array([place.setdefault(g, len(place)) for g in zip(*(table.column(c).to_pylist() for c in by), strict=True)], np.int64)
    return list(place), at


def narrowed(s: Search, cells: dict[int, int]) -> Search:
    """The cell that holds the rank."""
    left, shift = s.left, s.shift()
    for cell in sorted(cells):
        if left <= cells[cell]:
            lo = s.lo + (cell << shift)
            return Search(s.group, s.rank, left, lo, min(s.hi, lo + (1 << shift) - 1), cells[cell])
        left -= cells[cell]
    raise AssertionError("the rank is beyond the rows")


def selected(rows: DataFrame, ranks: dict[tuple, list[int]], sizes: dict[tuple, tuple], by: list[str], value: str, small: int) -> dict[tuple, float | int]:
    """(group, rank) -> value for large groups: rounds of cells until the cell of each rank is small or one
    value, then the rows of these cells alone, which are few, in order."""
    whole = rows.schema[value].dataType.simpleString() in INTEGERS
    kind = np.int64 if whole else np.float64
    open_ = [
        Search(g, r, r, *(int(keys_of(np.array([x], kind))[0]) for x in sizes[g][1:]), sizes[g][0]) for g, asked in ranks.items() for r in asked
    ]
    done, few = {}, []
    while open_:
        cells = counted(rows, open_, by, value)
        open_ = [narrowed(s, cells[s.group, s.lo, s.hi]) for s in open_]
        for s in open_:
            if s.lo == s.hi:
                done[s.group, s.rank] = values_of(s.lo, whole)
            elif s.rows <= small:
                few.append(s)
        open_ = [s for s in open_ if s.lo != s.hi and s.rows > small]
    if few:
        # a row a group and rank, each over ``small`` rows of the input
        bounds = [(*s.group, s.rank, s.left, values_of(s.lo, whole), values_of(s.hi, whole)) for s in few]
        names = [f"_g{i}" for i in range(len(by))]
        number = "long" if whole else "double"
        fields = [f"{n} {rows.schema[c].dataType.simpleString()}" for n, c in zip(names, by)] + ["_rank long", "_left long", f"_lo {number}", f"_hi {number}"]
        spans = rows.sparkSession.createDataFrame(bounds, ", ".join(fields))
        same = (F.col(value) >= F.col("_lo")) & (F.col(value) <= F.col("_hi"))
        for n, c in zip(names, by):
            same &= F.col(n).eqNullSafe(F.col(c))
        near = rows.join(F.broadcast(spans), same).select(*names, "_rank", "_left", value)
        placed = near.withColumn("_at", F.row_number().over(Window.partitionBy(*names, "_rank").orderBy(value)))
        for r in placed.filter("_at = _left").collect():
            done[tuple(r[n] for n in names), r["_rank"]] = r[value]
    return done


def ranks_of(n: int, disc: list[float], cont: list[float]) -> set[int]:
    out = {min(max(math.ceil(p * n), 1), n) for p in disc}
    for p in cont:
        at = p * (n - 1)
        out |= {math.floor(at) + 1, math.ceil(at) + 1}
    return out


def exact_quantiles(rows: DataFrame, by: list[str], value: str, disc: dict[str, float] | None = None, cont: dict[str, float] | None = None, small: int = SMALL) -> DataFrame:
    """(*by, name of each percentile) for each group of ``rows``.

    ``disc`` gives names to nearest ranks (the least value that a share p of the rows does not exceed),
    ``cont`` to linear interpolations between the neighbouring ranks. Null values do not count; a group
    of nulls alone has nulls; NaN is above all; a null group is a group; an empty table gives no row (with
    no ``by``, one row of nulls). Whole numbers are ranked exactly and given as doubles.

    Groups of up to ``small`` rows are numbered by a window. Larger ones, of which there is at most one
    for so many rows of input, are searched: each round counts the rows of 4096 cells between bounds
    inside the tasks and goes on in the cell of each rank; only cells of up to ``small`` rows are sorted.
    """
    disc, cont = disc or {}, cont or {}
    kind = rows.schema[value].dataType.simpleString()
    typed = rows.select(*by, value if kind in INTEGERS else F.col(value).cast("double").alias(value))
    typed = typed.withColumn(value, F.col(value).cast("long")) if kind in INTEGERS else typed
    known = typed.filter(F.col(value).isNotNull())
    sizes = typed.groupBy(*by).agg(F.count(value).alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max"))
    spark = rows.sparkSession
    large = {tuple(r[c] for c in by): (r["_n"], r["_min"], r["_max"]) for r in sizes.filter(F.col("_n") > small).collect()}
    group_type = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in by]

    ranks = {g: sorted(ranks_of(n, list(disc.values()), list(cont.values()))) for g, (n, _, _) in large.items()}
    found = selected(known, ranks, large, by, value, small) if large else {}
    columns = [*disc, *cont]

    def of_large(g: tuple) -> tuple:
        n = large[g][0]
        low_high = lambda at: [float(found[g, f(at) + 1]) for f in (math.floor, math.ceil)]
        nearest = [float(found[g, min(max(math.ceil(p * n), 1), n)]) for p in disc.values()]
        between = []
        for p in cont.values():
            at = p * (n - 1)
            lo, hi = low_high(at)
            between.append(lo if lo == hi else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi)
        return (*g, *nearest, *between)

    few = sizes.filter(F.col("_n") <= small).select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by)), "_n")
    same = F.lit(True)
    for i, c in enumerate(by):
        same &= F.col(f"_g{i}").eqNullSafe(F.col(c))
    names = [f"_g{i}" for i in range(len(by))]
    inside = few.join(known, same, "left").select(*names, "_n", F.col(value).cast("double").alias("_v"), F.row_number().over(Window.partitionBy(*names).orderBy(value)).alias("_at"))
    # as text: an expression built piece by piece costs more than a small group's rows
    pick = lambda at: f"max(CASE WHEN _at = {at} THEN _v END)"
    out = [F.expr(f"{pick(f'greatest(ceil({p!r}D * _n), 1)')} AS `{name}`") for name, p in disc.items()]
    for i, p in enumerate(cont.values()):
        at = f"{p!r}D * (_n - 1)"
        out.append(F.expr(f"struct({pick(f'floor({at}) + 1')} AS lo, {pick(f'ceil({at}) + 1')} AS hi, max({at}) AS at) AS _c{i}"))
    picked = inside.groupBy(*names).agg(*out)
    between = [
        F.expr(f"CASE WHEN _c{i}.lo = _c{i}.hi THEN _c{i}.lo ELSE (ceil(_c{i}.at) - _c{i}.at) * _c{i}.lo + (_c{i}.at - floor(_c{i}.at)) * _c{i}.hi END AS `{name}`")
        for i, name in enumerate(cont)
    ]
    result = picked.select(*(F.col(n).alias(c) for n, c in zip(names, by)), *disc, *between)
    if not large:
        return result
    searched = spark.createDataFrame([of_large(g) for g in large], ", ".join([*group_type, *(f"{c} double" for c in columns)]))
    return result.unionByName(searched) if by else searched
