"""Cross-validation, learning curves and calibration of the classifiers of ``learn``."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learn


def folds(df: DataFrame, key: str, n: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``_fold``, from a hash of the key: rows of each label are spread evenly, and reruns agree."""
    return df.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(n)).cast("int"))


def area(scored: DataFrame, label: str, metric: str = "areaUnderROC") -> float:
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="probability", metricName=metric).evaluate(scored)


def cross_validate(df: DataFrame, key: str, label: str, numeric: list[str], categories: list[str], model: str = "logistic", n: int = 5) -> DataFrame:
    """(fold, auc) of models fitted on the other folds; the preparation is fitted anew in each."""
    dealt = folds(df, key, n)
    found = []
    for k in range(n):
        fitted = learn.fit(dealt.filter(F.col("_fold") != k), label, numeric, categories, model)
        found.append((k, area(fitted.transform(dealt.filter(F.col("_fold") == k)), label)))
    return df.sparkSession.createDataFrame(found, "fold int, auc double")


def learning_curve(
    df: DataFrame, key: str, label: str, numeric: list[str], categories: list[str], model: str = "logistic", shares: tuple[float, ...] = (0.1, 0.25, 0.5, 1.0)
) -> DataFrame:
    """(share, n, train_auc, test_auc): models fitted on growing shares of four folds, tested on the fifth."""
    dealt = folds(df, key)
    held, rest = dealt.filter("_fold = 0"), dealt.filter("_fold <> 0")
    place = F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(10_000)) / 10_000
    found = []
    for share in shares:
        part = rest.filter(place < share)
        fitted = learn.fit(part, label, numeric, categories, model)
        found.append((share, part.count(), area(fitted.transform(part), label), area(fitted.transform(held), label)))
    return df.sparkSession.createDataFrame(found, "share double, n long, train_auc double, test_auc double")


def validation_curve(df: DataFrame, key: str, label: str, numeric: list[str], categories: list[str], depths: tuple[int, ...] = (2, 4, 8, 12)) -> DataFrame:
    """(depth, train_auc, test_auc) of trees of growing depth, fitted on four folds and tested on the fifth."""
    dealt = folds(df, key)
    held, rest = dealt.filter("_fold = 0"), dealt.filter("_fold <> 0")
    found = []
    for depth in depths:
        fitted = learn.fit(rest, label, numeric, categories, "tree", maxDepth=depth)
        found.append((depth, area(fitted.transform(rest), label), area(fitted.transform(held), label)))
    return df.sparkSession.createDataFrame(found, "depth int, train_auc double, test_auc double")


def calibrate(scored: DataFrame, label: str, probability: str = "probability"):
    """An isotonic model from the probability of label 1 (a vector's second value, or a number) to its share."""
    return IsotonicRegression(featuresCol="_p", labelCol=label, predictionCol="calibrated").fit(_one(scored, probability))


def calibrated(scored: DataFrame, model, probability: str = "probability") -> DataFrame:
    """``scored`` with the column ``calibrated``."""
    return model.transform(_one(scored, probability)).drop("_p", "_v")


def _one(scored: DataFrame, probability: str) -> DataFrame:
    number = dict(scored.dtypes)[probability] in ("double", "float")
    p = F.col(probability).cast("double") if number else vector_to_array(probability)[1]
    return VectorAssembler(inputCols=["_v"], outputCol="_p").transform(scored.withColumn("_v", p))
