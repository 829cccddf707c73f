"""Edge and cloud classifiers as Spark jobs."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.checks import leakage_guard

Scorer = Callable[[DataFrame], DataFrame]


def causal_fit_data(df: DataFrame, features: Sequence[str], label: str, role: str = "role", fit_role: str = "baseline_train") -> DataFrame:
    """Complete rows of the training role only, with features free of leakage columns."""
    leakage_guard(features)
    if label in features:
        raise ValueError(f"label {label!r} is among the features")
    return df.where(F.col(role) == fit_role).select(*features, label).dropna()


def nb_fit(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Sufficient statistics of a Gaussian naive Bayes model: one row per class."""
    leakage_guard(features)
    return df.groupBy(F.col(label).alias("label")).agg(
        F.count("*").alias("n"),
        *[F.sum(F.col(c).cast("double")).alias(f"{c}__sum") for c in features],
        *[F.sum(F.col(c).cast("double") * F.col(c)).alias(f"{c}__sq") for c in features],
    )


def nb_merge(tables: Sequence[DataFrame]) -> DataFrame:
    """Learn more: statistics of several batches add up to those of their union."""
    stacked = reduce(DataFrame.unionByName, tables)
    return stacked.groupBy("label").agg(*[F.sum(c).alias(c) for c in stacked.columns if c != "label"])


def nb_scorer(model: DataFrame, features: Sequence[str], smoothing: float = 1e-9) -> Scorer:
    """Scorer that adds p0 and p1 from the class statistics (two rows, joined as one)."""
    leakage_guard(features)

    stats = ["n", *[f"{c}__{s}" for c in features for s in ("sum", "sq")]]
    wide = model.agg(
        *[F.max(F.when(F.col("label") == k, F.col(c))).alias(f"__{c}__{k}") for c in stats for k in (0, 1)]
    )
    p1 = nb_posterior(features, lambda name, k: F.col(f"__{name}__{k}"), smoothing)

    def score(df: DataFrame) -> DataFrame:
        both = df.crossJoin(F.broadcast(wide))  # an ungrouped aggregate: exactly one row
        return both.select(*df.columns, (F.lit(1.0) - p1).alias("p0"), p1.alias("p1"))

    return score


def nb_posterior(features: Sequence[str], stat: Callable[[str, int], Column], smoothing: float = 1e-9) -> Column:
    """p1 from class statistics on the row; `stat(name, k)` finds n, <feature>__sum, <feature>__sq."""

    def log_joint(k: int) -> Column:
        n = stat("n", k)
        terms = [F.ln(n / (stat("n", 0) + stat("n", 1)))]
        for c in features:
            mean = stat(f"{c}__sum", k) / n
            var = F.greatest(stat(f"{c}__sq", k) / n - mean * mean, F.lit(smoothing))
            gap = F.col(c) - mean
            terms.append(F.lit(-0.5) * (F.ln(F.lit(2.0 * math.pi) * var) + gap * gap / var))
        return reduce(add, terms)

    return F.lit(1.0) / (F.lit(1.0) + F.exp(log_joint(0) - log_joint(1)))


def logistic_scorer(weights: dict[str, float], bias: float = 0.0) -> Scorer:
    """Scorer from a fixed linear rule; handy where a run must be reproducible in SQL."""
    leakage_guard(list(weights))
    logit = reduce(add, [F.lit(float(w)) * F.col(c) for c, w in weights.items()], F.lit(float(bias)))
    p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    return lambda df: df.select("*", (F.lit(1.0) - p1).alias("p0"), p1.alias("p1"))


def gbt_fit(
    df: DataFrame, features: Sequence[str], label: str = "label", trees: int = 100, depth: int = 6,
    step: float = 0.1, subsample: float = 0.8, seed: int = 42,
) -> GBTClassificationModel:
    """Gradient-boosted trees; histograms are aggregated on the executors."""
    leakage_guard(features)
    ready = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="skip").transform(
        df.select(*features, F.col(label).cast("double").alias("__y"))
    )
    return GBTClassifier(
        featuresCol="__x", labelCol="__y", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=subsample, seed=seed
    ).fit(ready)


def gbt_scorer(model: GBTClassificationModel, features: Sequence[str]) -> Scorer:
    leakage_guard(features)
    assemble = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep")

    def score(df: DataFrame) -> DataFrame:
        out = model.setFeaturesCol("__x").setProbabilityCol("__p").transform(assemble.transform(df))
        p = vector_to_array("__p")
        return out.select(*df.columns, p[0].alias("p0"), p[1].alias("p1"))

    return score


def predict(df: DataFrame, scorer: Scorer, name: str = "prediction") -> DataFrame:
    return scorer(df).withColumn(name, (F.col("p1") >= F.col("p0")).cast("int"))
