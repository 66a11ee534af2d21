"""Agreement, intervals, rank statistics, drift and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .evaluation import at_or_above
from .quantiles import exact_quantiles


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, zz = k / F.nullif(n, F.lit(0)), z * z
    d = 1 + zz / n
    mid, half = (p + zz / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / d
    clip = lambda c: F.coalesce(F.bround(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), 3), F.lit(0.0))
    safe = n > 0
    return F.when(safe, clip(mid - half)).otherwise(0.0), F.when(safe, clip(mid + half)).otherwise(0.0)


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Kappa of two 0/1 columns; 1 where chance agreement is 1."""
    n = F.count("*")
    po, pa, pb = F.avg((F.col(a) == F.col(b)).cast("double")), F.avg(F.col(a).cast("double")), F.avg(F.col(b).cast("double"))
    out = pairs.agg(n.alias("n"), po.alias("po"), (pa * pb + (1 - pa) * (1 - pb)).alias("pe"))
    return out.select("n", F.when(F.col("pe") == 1, 1.0).otherwise(F.round((F.col("po") - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0)), 4)).alias("kappa"))


def auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Mann-Whitney area; of a pair with equal scores half counts."""
    c = at_or_above(scored, score, label)
    total = c.agg(F.sum("p").alias("np"), F.sum("q").alias("nn"))
    below = F.col("nn") - F.col("fp") + F.col("q") / 2
    s = c.crossJoin(F.broadcast(total)).agg(F.sum(F.col("p") * below).alias("won"), F.max("np").alias("np"), F.max("nn").alias("nn"))
    return s.select(F.round(F.col("won") / F.nullif(F.col("np") * F.col("nn"), F.lit(0)), 6).alias("auc"))


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    x, y = F.col(a) == 1, F.col(b) == 1
    out = pairs.agg(F.count_if(x & ~y).alias("b10"), F.count_if(~x & y).alias("b01"))
    n = F.col("b10") + F.col("b01")
    return out.withColumn("chi2", F.when(n > 0, F.round(F.pow(F.greatest(F.abs(F.col("b10") - F.col("b01")) - 1, F.lit(0)), F.lit(2)) / n, 6)).otherwise(0.0))


def psi(base: DataFrame, recent: DataFrame, value: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Population stability index over quantile bins of ``base``; open at both ends."""
    names = {f"c{i}": i / bins for i in range(1, bins)}
    cuts = exact_quantiles(base, [], value, cont=names).select(F.array(*names).alias("cuts"))
    rows = base.select(F.col(value), F.lit(True).alias("_base")).unionByName(recent.select(F.col(value), F.lit(False).alias("_base")))
    binned = rows.crossJoin(F.broadcast(cuts)).select("_base", F.size(F.filter("cuts", lambda c: c <= F.col(value))).alias("bin"))
    counts = binned.groupBy("bin").agg(F.count_if("_base").alias("b"), F.count_if(~F.col("_base")).alias("r"))
    share = lambda c: F.greatest(F.coalesce(F.try_divide(F.col(c), F.sum(c).over(Window.partitionBy())), F.lit(0.0)), F.lit(eps)).alias(c)
    shares = counts.select(share("b"), share("r"))  # a row a bin
    out = shares.agg(F.round(F.sum((F.col("r") - F.col("b")) * F.log(F.col("r") / F.col("b"))), 4).alias("psi"))
    return out.withColumn("status", F.when(F.col("psi") < 0.1, "estavel").when(F.col("psi") < 0.25, "moderado").otherwise("severo"))


def gate(rules: DataFrame, found: DataFrame) -> DataFrame:
    """Rules (name, op, floor) against metrics (name, value); a missing metric fails."""
    v, f = F.col("value"), F.col("floor")
    ok = F.when(F.col("op") == ">=", v >= f).when(F.col("op") == "<=", v <= f).when(F.col("op") == "==", v == f)
    return rules.join(found, "name", "left").withColumn("passed", F.coalesce(ok, F.lit(False)))


def threshold_sweep(scored: DataFrame, score: str, label: str, steps: int = 60) -> DataFrame:
    """Coverage of label 1, specificity of label 0 and Youden's J at evenly spaced thresholds."""
    ends = scored.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    grid = ends.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / (steps - 1))).alias("threshold"))
    by = scored.groupBy(F.col(score).alias("s")).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    met = F.broadcast(grid).crossJoin(by).groupBy("threshold").agg(
        (F.sum(F.when(F.col("s") >= F.col("threshold"), F.col("p")).otherwise(0)) / F.nullif(F.sum("p"), F.lit(0))).alias("coverage"),
        (F.sum(F.when(F.col("s") < F.col("threshold"), F.col("q")).otherwise(0)) / F.nullif(F.sum("q"), F.lit(0))).alias("specificity"),
    )
    return met.select(F.round("threshold", 6).alias("threshold"), F.round("coverage", 6).alias("coverage"), F.round("specificity", 6).alias("specificity"), F.round(F.col("coverage") + F.col("specificity") - 1, 6).alias("youden"))


def fleiss_kappa(votes: DataFrame, item: str, category: str) -> DataFrame:
    """Kappa of any number of raters, all items with as many votes; 1 where chance agreement is 1."""
    cell = votes.groupBy(item, category).agg(F.count("*").alias("_c"))
    per = cell.groupBy(item).agg(F.sum("_c").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("sq"))
    agree = per.agg(F.avg((F.col("sq") - F.col("n")) / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))).alias("p"))
    share = cell.groupBy(category).agg(F.sum("_c").alias("_c")).agg((F.sum(F.col("_c") * F.col("_c")) / F.pow(F.sum("_c"), F.lit(2))).alias("pe"))
    kappa = F.when(F.col("pe") == 1, 1.0).otherwise(F.round((F.col("p") - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0)), 4))
    return agree.crossJoin(share).select(kappa.alias("kappa"))


def confusion(pairs: DataFrame, said: str, label: str) -> DataFrame:
    """Counts of 0/1 predictions against labels, with precision, recall and F1; 0 where undefined."""
    p, y = F.col(said) == 1, F.col(label) == 1
    c = pairs.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    share = lambda a, b: F.coalesce(F.round(a / F.nullif(b, F.lit(0)), 4), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, lo, upper_median, hi): least, largest and upper median of a whole-number column in each group.

    Values are counted first, so that what is numbered are a group's distinct values, not its rows."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(by).orderBy(value))
    total = F.sum("_c").over(Window.partitionBy(by))
    placed = counts.withColumn("_upto", upto).withColumn("_half", F.floor(total / 2) + 1)
    return placed.groupBy(by).agg(F.min(value).alias("lo"), F.min(F.when(F.col("_upto") >= F.col("_half"), F.col(value))).alias("upper_median"), F.max(value).alias("hi"))


def micro_f1(said: DataFrame, gold: DataFrame, item: str, kind: str) -> DataFrame:
    """Counts and F1 over distinct (item, text, kind), for each kind and for all of them."""
    keys = [item, "text", kind]
    both = said.select(*keys).distinct().withColumn("_s", F.lit(1)).join(gold.select(*keys).distinct().withColumn("_g", F.lit(1)), keys, "full")
    hit = F.col("_s").isNotNull() & F.col("_g").isNotNull()
    c = both.rollup(kind).agg(F.grouping(kind).alias("_all"), F.count_if(hit).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_s").isNull()).alias("fn"))
    share = F.coalesce(F.round(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), 4), F.lit(0.0))
    return c.select(F.when(F.col("_all") == 1, "all").otherwise(F.col(kind)).alias("kind"), "tp", "fp", "fn", share.alias("f1"))
