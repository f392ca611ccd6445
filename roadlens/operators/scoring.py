"""Training and scoring with MLlib: sample weights, encoded matrices, boosted ensembles, calibration, importances."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.functions.rules import platt


def recency_weight(year: Column, newest: int) -> Column:
    return F.when(year == newest, 20.0).when(year == newest - 1, 6.0).when(year == newest - 2, 2.0).otherwise(1.0)


def matrix(categories: list[str], numbers: list[str]) -> Pipeline:
    """Indexes of categories (unknown ones kept as one more) and numbers as one feature vector."""
    indexer = StringIndexer(inputCols=categories, outputCols=[f"{c}_index" for c in categories], handleInvalid="keep")
    return Pipeline(stages=[indexer, VectorAssembler(inputCols=[*[f"{c}_index" for c in categories], *numbers], outputCol="features")])


def fit_ensemble(rows: DataFrame, label: str, weight: str, holdout: str, seeds: list[int], trees: int, bins: int) -> list:
    """Boosted trees, one model for each seed; training stops early on the rows marked as holdout, a slice of the training years."""
    boost = lambda seed: GBTClassifier(
        labelCol=label, weightCol=weight, validationIndicatorCol=holdout, maxIter=trees, maxDepth=3, maxBins=bins, subsamplingRate=0.7, seed=seed
    )
    return [boost(seed).fit(rows) for seed in seeds]


def mean_probability(rows: DataFrame, models: list) -> DataFrame:
    """rows with raw, the mean of the models' probabilities."""
    out = rows
    for i, model in enumerate(models):
        out = model.transform(out).withColumn(f"_p{i}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
    names = [f"_p{i}" for i in range(len(models))]
    return out.withColumn("raw", sum((F.col(n) for n in names), F.lit(0.0)) / len(names)).drop(*names)


def fit_platt(scored: DataFrame, raw: str, label: str) -> tuple[float, float]:
    """Slope and intercept of the sigmoid over raw scores, with an L2 penalty of one observation."""
    n = scored.count()
    rows = VectorAssembler(inputCols=[raw], outputCol="_x").transform(scored.select(raw, F.col(label).cast("double").alias(label)))
    fitted = LogisticRegression(featuresCol="_x", labelCol=label, regParam=1.0 / max(1, n), standardization=False).fit(rows)
    return float(fitted.coefficients[0]), float(fitted.intercept)


def score(rows: DataFrame, prepared: PipelineModel, models: list, a: float, b: float) -> DataFrame:
    """rows with raw and calibrated (rounded to 4) probabilities."""
    return mean_probability(prepared.transform(rows), models).withColumn("calibrated", F.round(platt(F.col("raw"), a, b), 4))


def importances(models: list, names: list[str], groups: dict[str, str], spark) -> DataFrame:
    """feature, part (group), importance averaged over models, place."""
    values = [(n, groups.get(n, "other"), float(sum(m.featureImportances[i] for m in models) / len(models))) for i, n in enumerate(names)]
    ranked = sorted(values, key=lambda v: (-v[2], v[0]))
    return spark.createDataFrame([(*v, i + 1) for i, v in enumerate(ranked)], "feature string, part string, importance double, place int")


def group_importances(found: DataFrame) -> DataFrame:
    """part, features, importance (total), share, place of each group of the features of `importances`."""
    from pyspark.sql import Window

    by = found.groupBy("part").agg(F.count(F.lit(1)).alias("features"), F.sum("importance").alias("importance"))
    place = F.row_number().over(Window.orderBy(F.desc("importance"), "part"))  # as many rows as groups
    return by.select("part", "features", "importance", F.try_divide("importance", F.sum("importance").over(Window.partitionBy())).alias("share"), place.alias("place"))


def top_importances(found: DataFrame, n: int = 20) -> DataFrame:
    """The n features of highest importance, in order."""
    return found.orderBy("place").limit(n)
