"""Baseline classifiers on Spark ML, and what can be read off a fitted model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import (
    LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import count_where, n_rows, scalar
from tracewell.operators.contracts import ContractError, table_fingerprint
from tracewell.operators.exact_forest import ExactForest, exact_importance, exact_structure, fit_exact_forest, predict_exact

SIGN_TOLERANCE = 1e-12


def prior_model(train: DataFrame, test: DataFrame, target: str = "target") -> DataFrame:
    """The training positive rate as every score, the majority class as every label."""
    rate = scalar(train, F.avg(F.col(target).cast("double")))
    return test.select(
        "case_id", F.col(target).cast("int").alias("y_true"), rate.alias("y_prob")
    ).withColumn("y_pred", (F.col("y_prob") > 0.5).cast("int"))


def fit_logistic(
    train: DataFrame, c: float = 1.0, max_iter: int = 2000, tol: float = 1e-8, target: str = "target"
) -> LogisticRegressionModel:
    """L2 logistic regression with inverse strength `c` on the summed loss.

    Spark penalises the mean loss, so its strength is 1 / (c n); the intercept is free and the
    raw coefficients are penalised.
    """
    n = train.count()
    model = LogisticRegression(
        labelCol=target, regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False,
        maxIter=max_iter, tol=tol, family="binomial",
    ).fit(train)
    if model.summary.totalIterations >= max_iter:
        raise ContractError(f"no convergence within {max_iter} iterations")
    return model


def fit_forest(
    train: DataFrame, num_trees: int = 300, max_depth: int = 30, max_bins: int = 128, seed: int = 42,
    target: str = "target",
) -> RandomForestClassificationModel:
    """Gini forest with sqrt features per split. Spark bins numeric splits and stops at depth 30."""
    return RandomForestClassifier(
        labelCol=target, numTrees=num_trees, impurity="gini", featureSubsetStrategy="sqrt",
        minInstancesPerNode=1, maxDepth=max_depth, maxBins=max_bins, seed=seed, subsamplingRate=1.0,
        maxMemoryInMB=512, cacheNodeIds=True, checkpointInterval=10,
    ).fit(train)


def fit_stored_forest(
    train: DataFrame, num_trees: int = 300, max_depth: int = 30, max_bins: int = 128, seed: int = 42, target: str = "target",
) -> ExactForest:
    """The forest of `fit_forest` for any number of cases: Gini, sqrt features per split, binned splits, the same depth.

    Spark's model is an object of the driver, which grows with trees times cases; here trees are grown by executors and stay
    in a table.
    """
    return fit_exact_forest(train, num_trees, seed=seed, target=target, max_depth=max_depth, bins=max_bins)


def _by_index(dictionary: DataFrame, values: Sequence[float], name: str) -> DataFrame:
    table = dictionary.sparkSession.createDataFrame(
        [(i, float(v)) for i, v in enumerate(values)], f"feature_index long, {name} double"
    )
    return dictionary.join(table, "feature_index")


def logistic_coefficients(model: LogisticRegressionModel, dictionary: DataFrame) -> DataFrame:
    out = _by_index(dictionary, model.coefficients.toArray(), "coefficient")
    return out.withColumn("abs_coefficient", F.abs("coefficient")).orderBy(F.desc("abs_coefficient"), "feature_index")


def coefficient_signs(coefficients: DataFrame) -> DataFrame:
    c = F.col("coefficient")
    return coefficients.agg(
        count_where(c > SIGN_TOLERANCE).alias("positive"),
        count_where(c < -SIGN_TOLERANCE).alias("negative"),
        count_where(F.abs(c) <= SIGN_TOLERANCE).alias("zero"),
    )


def forest_importance(model: RandomForestClassificationModel | ExactForest, dictionary: DataFrame, top: int | None = None) -> DataFrame:
    stored = isinstance(model, ExactForest)
    out = exact_importance(model, dictionary) if stored else _by_index(dictionary, model.featureImportances.toArray(), "importance")
    ranked = out.orderBy(F.desc("importance"), "feature_index")
    return ranked.limit(top) if top else ranked


def forest_structure(model: RandomForestClassificationModel | ExactForest, spark) -> DataFrame:
    """Depth and leaf count over the trees; a binary tree of n nodes has (n + 1) / 2 leaves."""
    if isinstance(model, ExactForest):
        whole = exact_structure(model)
        return whole.withColumns({c: F.col(c).cast("int") for c in ("leaves_min", "leaves_max")})
    trees = spark.createDataFrame(
        [(t.depth, (t.numNodes + 1) // 2) for t in model.trees], "depth int, leaves int"
    )
    return trees.agg(
        n_rows("trees"),
        *[f(c).alias(f"{c}_{n}") for c in ("depth", "leaves") for n, f in
          (("min", F.min), ("mean", F.avg), ("max", F.max))],
    )


def predict(model, data: DataFrame, target: str = "target", positive: int = 1) -> DataFrame:
    """case_id, y_true, y_pred, y_prob of the positive label; a score of exactly 0.5 is class 0."""
    if isinstance(model, ExactForest):
        scored = predict_exact(model, data, target)
        prob = F.col("y_prob") if positive == 1 else 1 - F.col("y_prob")
        return scored.select("case_id", "y_true", prob.alias("y_prob")).withColumn("y_pred", (F.col("y_prob") > 0.5).cast("int"))
    scored = model.transform(data)
    prob = vector_to_array("probability").getItem(positive)
    return scored.select(
        "case_id", F.col(target).cast("int").alias("y_true"), prob.alias("y_prob")
    ).withColumn("y_pred", (F.col("y_prob") > 0.5).cast("int"))


def _equal_tables(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
    left = table_fingerprint(a).select(F.struct("*").alias("f"))
    same = left.withColumn("g", scalar(table_fingerprint(b), F.struct("*")))
    return same.select(
        F.lit(name).alias("check"),
        F.when(F.col("f") == F.col("g"), "PASS").otherwise("FAIL").alias("status"),
        F.col("f.row_count").alias("rows"),
    )


def refit_equality(fit, train: DataFrame, test: DataFrame, dictionary: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """Fit twice; predictions and importances (or coefficients) must agree exactly.

    `again` is handed to the second fit instead of the same rows.
    """
    first, second = fit(train), fit(train if again is None else again)
    weights = logistic_coefficients if isinstance(first, LogisticRegressionModel) else forest_importance
    return _equal_tables("predictions", predict(first, test), predict(second, test)).unionByName(
        _equal_tables("weights", weights(first, dictionary), weights(second, dictionary))
    )


def reload_equality(model, path: str, test: DataFrame) -> DataFrame:
    """Save, load, and compare the predictions."""
    model.save(path)
    return _equal_tables("reloaded_predictions", predict(model, test), predict(type(model).load(path), test))
