"""Pair models: gradient-boosted trees with grouped folds, stacked in two stages."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordweave.runtime import cut
from recordweave.sources.files import uniform

MISSING = -1.0


def fold(key, n: int = 5):
    """Fold of a group, by its hash; groups stay whole."""
    return F.floor(uniform(key, "fold") * n).cast("int")


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """df with the vector column features; null and NaN become -1, which no similarity takes."""
    filled = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(MISSING)), F.lit(MISSING)).alias(f"_f_{c}") for c in features]
    x = df.select("*", *filled)
    return VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="features").transform(x).drop(*[f"_f_{c}" for c in features])


def classifier(trees: int = 20, depth: int = 4, seed: int = 7, validation: str | None = None) -> GBTClassifier:
    """The classifier; with a validation column training stops early when the held-out loss no longer falls."""
    c = GBTClassifier(featuresCol="features", labelCol="y", maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.2, minInstancesPerNode=5)
    return c.setValidationIndicatorCol(validation) if validation else c


def predict(model: GBTClassificationModel | PipelineModel, df: DataFrame, out: str = "p") -> DataFrame:
    x = model.transform(df)
    return x.withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def out_of_fold(df: DataFrame, features: list[str], group: str, n: int = 5, out: str = "p", train: Column | None = None, **kw) -> tuple[DataFrame, list]:
    """(df with fold and out-of-fold probabilities, the fold models). Each row is scored by the model that didn't see its group.

    A fold's training stops early on the fold it leaves out. train: the rows to learn and stop on; all rows are scored.
    """
    x = cut(assembled(df.withColumn("fold", fold(F.col(group), n)), features))
    use = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    fit = lambda k: classifier(**kw, validation="_held").fit(x.filter(use).withColumn("_held", F.col("fold") == k))
    with ThreadPool(n) as pool:  # a tree is many short jobs, which leave cores to the other folds
        models, parts = pool.map(inheritable_thread_target(df.sparkSession)(fit), range(n), 1), None
    for k, m in enumerate(models):
        p = predict(m, x.filter(F.col("fold") == k), out)
        parts = p if parts is None else parts.unionByName(p)
    return parts.drop("features"), models


def refit(df: DataFrame, features: list[str], models: list, train: Column | None = None, **kw) -> GBTClassificationModel:
    """A model of all rows, with as many trees as the fold models kept on average."""
    kw |= {"trees": max(1, round(sum(m.getNumTrees for m in models) / max(1, len(models))))}
    x = assembled(df if train is None else df.filter(train), features)
    return classifier(**kw).fit(x)


def by_fold(df: DataFrame, models: list, features: list[str], out: str = "p") -> DataFrame:
    """df (with fold) scored by the model that left its fold out."""
    x, parts = assembled(df, features), None
    for k, m in enumerate(models):
        p = predict(m, x.filter(F.col("fold") == k), out)
        parts = p if parts is None else parts.unionByName(p)
    return parts.drop("features")


def score_live(df: DataFrame, model: GBTClassificationModel, features: list[str], live: Column, old: str, out: str = "p") -> DataFrame:
    """df with out: the model's probability of live rows, the column old of the others, which aren't scored."""
    there = F.coalesce(live, F.lit(False))
    scored = predict(model, assembled(df.filter(there), features), out).drop("features")
    return scored.unionByName(df.filter(~there).withColumn(out, F.col(old)))


def save(model: GBTClassificationModel, features: list[str], path: str) -> None:
    """The model and the order of its features, in a folder."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame(list(enumerate(features)), "place int, feature string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load(path: str) -> tuple[GBTClassificationModel, list[str]]:
    """A saved model and its features. Raises ValueError where their numbers differ."""
    names = [r.feature for r in SparkSession.active().read.parquet(f"{path}/features").orderBy("place").collect()]
    model = GBTClassificationModel.load(f"{path}/model")
    if model.numFeatures != len(names):
        raise ValueError(f"the model has {model.numFeatures} features, its list {len(names)}")
    return model, names


def shift(df: DataFrame, features: list[str], label: str, out: str = "p", **kw) -> tuple[DataFrame, DataFrame | None]:
    """((held_out, n, auc), the held-out rows' scores): a model of all other labels' rows, scored on each label; null auc without both classes on both sides.

    One model a label, so the cost grows with the number of labels that have both classes.
    """
    x = cut(assembled(df, features))
    kinds = x.filter(F.col(label).isNotNull()).groupBy(label).agg(F.min("y").alias("a"), F.max("y").alias("b"), F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), label).collect()
    rows, parts = [], None
    for k, a, b, n in kinds:
        train = x.filter((F.col(label) != k) | F.col(label).isNull())
        value = None
        if a < b and train.select("y").distinct().count() == 2:
            scored = classifier(**kw).fit(train).transform(x.filter(F.col(label) == k))
            value = float(auc(scored))
            p = scored.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
            parts = p if parts is None else parts.unionByName(p)
        rows.append((k, n, value))
    return df.sparkSession.createDataFrame(rows, "held_out string, n long, auc double"), parts


def auc(scored: DataFrame) -> float:
    return BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="rawPrediction").evaluate(scored)


def importance(model: GBTClassificationModel, features: list[str], df: DataFrame, top: int = 12) -> DataFrame:
    """(feature, gain) of the features that the trees gain most by."""
    v = sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:top]
    return df.sparkSession.createDataFrame(v, "feature string, gain double")


def blend(a: DataFrame, b: DataFrame, on: list[str], p: str = "p") -> DataFrame:
    """The mean of two models' probabilities of the same pairs."""
    return a.select(*on, F.col(p).alias("_a")).join(b.select(*on, F.col(p).alias("_b")), on).select(*on, ((F.col("_a") + F.col("_b")) / 2).alias(p))
