"""Star schema over monthly totals, and its analytic queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import MONTHS
from ..sources.sinks import written


def calendar(dates: DataFrame, date: str = "month") -> DataFrame:
    d = F.col(date)
    return dates.select(date).distinct().select(
        date, F.year(d).alias("year"), F.month(d).alias("month_no"), F.quarter(d).alias("quarter"),
        F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(d)).alias("month_name"),
    )


def keyed(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Distinct ``columns`` numbered from 1 in their order. The rows are a dimension: few."""
    return rows.select(*columns).distinct().withColumn(key, F.row_number().over(Window.orderBy(*columns)))


def monthly(rows: DataFrame, date: Column, value: Column, *by: str) -> DataFrame:
    return rows.groupBy(*by, F.trunc(date, "month").alias("month")).agg(F.sum(value).alias("total"))


def growth(months: DataFrame) -> DataFrame:
    """Percent change on the row before and on the twelfth row before, over one series."""
    w = Window.orderBy("month")
    change = lambda k: F.round(100.0 * (F.col("total") - F.lag("total", k).over(w)) / F.nullif(F.lag("total", k).over(w), F.lit(0.0)), 2)
    return months.withColumn("mom_pct", change(1)).withColumn("yoy_pct", change(12))


def growth_calendar(months: DataFrame) -> DataFrame:
    """Percent change on the same month of the year before; missing months give null."""
    before = months.select(F.add_months("month", 12).alias("month"), F.col("total").alias("before"))
    return months.join(before, "month", "left").withColumn("yoy_pct", F.round(100.0 * (F.col("total") - F.col("before")) / F.nullif(F.col("before"), F.lit(0.0)), 2))


def share(rows: DataFrame, by: str, value: Column) -> DataFrame:
    grouped = rows.groupBy(by).agg(F.sum(value).alias("total"))
    return grouped.withColumn("pct", F.round(100.0 * F.col("total") / F.sum("total").over(Window.partitionBy()), 1))


def lag_features(series: DataFrame, by: str) -> DataFrame:
    """Lags 1, 2, 3, 12 and means of the 3 and 12 rows before, null unless all are there."""
    w = Window.partitionBy(by).orderBy("month")
    out = series
    for k in (1, 2, 3, 12):
        out = out.withColumn(f"lag_{k}", F.lag("total", k).over(w))
    for n in (3, 12):
        frame = w.rowsBetween(-n, -1)
        out = out.withColumn(f"mean_{n}", F.when(F.count("total").over(frame) == n, F.avg("total").over(frame)))
    return out


def contiguous(series: DataFrame, by: str, least: int) -> DataFrame:
    """Series without missing months and at least ``least`` of them."""
    span = 12 * (F.year(F.max("month")) - F.year(F.min("month"))) + F.month(F.max("month")) - F.month(F.min("month")) + 1
    found = series.groupBy(by).agg(F.countDistinct("month").alias("n_months"), span.cast("long").alias("span"))
    return found.filter((F.col("n_months") == F.col("span")) & (F.col("n_months") >= least))


def backtest(series: DataFrame, by: str, horizon: int = 12) -> DataFrame:
    """MAPE of the naive and the seasonal naive forecast over each series' last ``horizon`` months."""
    back = Window.partitionBy(by).orderBy(F.desc("month"))
    w = Window.partitionBy(by).orderBy("month")
    ranked = series.withColumn("r", F.row_number().over(back)).withColumn("seasonal", F.lag("total", 12).over(w))
    last = Window.partitionBy(by)
    held = ranked.withColumn("naive", F.max(F.when(F.col("r") == horizon + 1, F.col("total"))).over(last)).filter(F.col("r") <= horizon)
    off = lambda p: F.round(F.avg(F.abs((F.col("total") - F.col(p)) / F.nullif(F.col("total"), F.lit(0.0)))) * 100, 4)
    return held.groupBy(by).agg(off("naive").alias("mape_naive"), off("seasonal").alias("mape_seasonal"))


def series_of(series: DataFrame, by: str, value: str) -> DataFrame:
    """One series in the order of its months; the value is data, never part of a query's text."""
    return series.filter(F.col(by) == F.lit(value)).orderBy("month")


def sum_columns(*columns: str) -> Column:
    """Sum over columns of a row, null counted as 0."""
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in columns[1:]), F.coalesce(F.col(columns[0]), F.lit(0)))


def filled(rows: DataFrame, by: str, date: str, step: str) -> DataFrame:
    """``rows`` with a row for each ``step`` (day, month) between a group's first and last date."""
    ends = rows.groupBy(by).agg(F.min(date).alias("a"), F.max(date).alias("b"))
    every = ends.select(by, F.explode(F.sequence("a", "b", F.expr(f"interval 1 {step}"))).alias(date))
    return every.join(rows, [by, date], "left")


def last_periods(rows: DataFrame, date: Column, n: int) -> DataFrame:
    """Rows of the last ``n`` distinct periods (recent) and of the n before (before), by their ``period``."""
    dated = rows.withColumn("_at", date)
    known = dated.select("_at").distinct().withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_at")))).filter(F.col("_r") <= 2 * n)
    return dated.join(F.broadcast(known), "_at").withColumn("period", F.when(F.col("_r") <= n, "recent").otherwise("before")).drop("_r", "_at")


def numbered(df: DataFrame, order: str, out: str) -> DataFrame:
    """``df`` with each row's place from 1 in ``out``, in the order of the unique column ``order`` (nulls last).

    Rows are dealt by range and written aside; a place is that in its range and the counts of those before."""
    spark = df.sparkSession
    key = F.col(order).asc_nulls_last()
    dealt = written(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key).withColumn("_range", F.spark_partition_id()), "dealt")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row a range
    placed = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(key)))
    return placed.join(F.broadcast(base), "_range").withColumn(out, F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")


def drift(series: DataFrame, by: str, n: int = 12) -> DataFrame:
    """Stability index of the last ``n`` months' totals against the n before, over the series that both hold."""
    from .metrics import psi

    named = last_periods(series, F.col("month"), n)
    recent, before = named.filter("period = 'recent'"), named.filter("period = 'before'")
    both = recent.select(by).intersect(before.select(by))
    return psi(before.join(both, by, "left_semi"), recent.join(both, by, "left_semi"), "total")
