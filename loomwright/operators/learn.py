"""Classifiers and clusters of Spark's ML library, behind one preparation of the features."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def models(label: str) -> dict:
    said = {"labelCol": label, "weightCol": "_weight", "featuresCol": "_features"}
    return {
        "logistic": LogisticRegression(**said), "tree": DecisionTreeClassifier(maxDepth=12, **said),
        "forest": RandomForestClassifier(numTrees=100, maxDepth=12, seed=42, **said), "boosted": GBTClassifier(maxIter=50, seed=42, **said),
    }


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds ``_weight``: n / (2 n of the row's class)."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"))
    return df.join(F.broadcast(n.crossJoin(total).select(label, (F.col("_all") / (2 * F.col("_n"))).alias("_weight"))), label)


def rare_together(df: DataFrame, column: str, least: float = 0.005) -> DataFrame:
    """Values under the share ``least`` as one, ``infrequent``; null as its own."""
    counts = df.groupBy(column).agg(F.count("*").alias("_c"))
    kept = counts.withColumn("_keep", F.col("_c") >= least * F.sum("_c").over(Window.partitionBy())).filter("_keep").select(F.col(column).alias("_v"))
    same = F.col(column).eqNullSafe(F.col("_v"))
    held = df.join(F.broadcast(kept.withColumn("_hit", F.lit(1))), same, "left")
    value = F.when(F.col("_hit").isNull(), "infrequent").otherwise(F.coalesce(column, F.lit("missing")))
    return held.withColumn(column, value).drop("_v", "_hit")


def preparation(numeric: list[str], categories: list[str]) -> list:
    filled = [f"{c}_filled" for c in numeric]
    return [
        Imputer(strategy="median", relativeError=0.0, inputCols=numeric, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_numeric"), StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True),
        *[StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in categories],
        *([OneHotEncoder(inputCols=[f"{c}_index" for c in categories], outputCols=[f"{c}_hot" for c in categories])] if categories else []),
        VectorAssembler(inputCols=["_scaled", *[f"{c}_hot" for c in categories]], outputCol="_features"),
    ]


def fit(train: DataFrame, label: str, numeric: list[str], categories: list[str], model: str = "logistic", **params):
    """A fitted pipeline whose ``probability`` is the balanced model's; ``params`` are set on the model."""
    chosen = models(label)[model]
    chosen.setParams(**params)
    return Pipeline(stages=[*preparation(numeric, categories), chosen]).fit(balanced(train, label))


def clusters(df: DataFrame, numeric: list[str], ks: tuple[int, ...] = (2, 3, 4, 5, 6)) -> tuple[DataFrame, dict[int, float]]:
    """Rows with the ``cluster`` of the k with the best silhouette (of squared distances), and all silhouettes."""
    prepared = Pipeline(stages=preparation(numeric, [])).fit(df).transform(df)
    judge, found = ClusteringEvaluator(featuresCol="_features", predictionCol="cluster"), {}
    fitted = {k: KMeans(k=k, seed=42, featuresCol="_features", predictionCol="cluster").fit(prepared).transform(prepared) for k in ks}
    for k, out in fitted.items():
        found[k] = judge.evaluate(out)
    return fitted[max(found, key=found.get)].select(*df.columns, "cluster"), found


def without_outcomes(df: DataFrame, outcomes: list[str]) -> DataFrame:
    """``df`` as it is; ValueError if it has a column that only the outcome tells."""
    told = sorted(set(df.columns) & set(outcomes))
    if told:
        raise ValueError(f"columns of the outcome among the features: {told}")
    return df


def _draw(key: str, seed: int) -> list:
    return [F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), F.col(key)]


def split_stratified(df: DataFrame, key: str, label: str, share: float, seed: int = 42, cells: int = 1024) -> DataFrame:
    """Adds ``held_out``: of the rows of each label in the order of a hash of the key, those from ``share`` on.

    Ranks are summed from cells of the hash, so that no label meets in one task; reruns agree."""
    digest = _draw(key, seed)[0]
    dealt = df.withColumn("_h", digest).withColumn("_cell", F.pmod(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)) / (1 << 32) * cells, F.lit(cells)).cast("int"))
    counts = dealt.groupBy(label, "_cell").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(label).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select(label, "_cell", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"), F.sum("_c").over(Window.partitionBy(label)).alias("_all"))
    inside = Window.partitionBy(label, "_cell").orderBy("_h", key)
    ranked = dealt.withColumn("_r", F.row_number().over(inside) - 1).join(F.broadcast(sums), [label, "_cell"])
    return ranked.withColumn("held_out", (F.col("_base") + F.col("_r")) / F.col("_all") >= share).drop("_h", "_cell", "_base", "_all", "_r")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows chosen by a hash of the key."""
    return df.orderBy(*_draw(key, seed)).limit(n)


def importances(fitted, features: list[str], k: int = 15) -> list[tuple[str, float]]:
    """The ``k`` features that a fitted pipeline's trees weigh most, of those named in order."""
    weights = fitted.stages[-1].featureImportances.toArray()
    return sorted(zip(features, weights.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:k]


def perceptron(train: DataFrame, label: str, numeric: list[str], hidden: tuple[int, ...] = (64, 16)):
    """A fitted multilayer perceptron on the prepared features."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    net = MultilayerPerceptronClassifier(layers=[len(numeric), *hidden, 2], labelCol=label, featuresCol="_features", seed=42, maxIter=100)
    return Pipeline(stages=[*preparation(numeric, []), net]).fit(train)
