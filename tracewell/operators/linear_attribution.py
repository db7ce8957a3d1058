"""Closed-form attribution of a linear score, on the scale of its log-odds, from sparse cells.

Feature j of a case contributes w_j * (x_j - mean_j), with the mean over the background cases; absent features
have x_j = 0 and contribute -w_j * mean_j, the same for all cases. So a case needs rows for its present
features only: what its absent ones add is the total of all -w_j * mean_j less that of the present ones.
No table of cases times features is made, and importance over all cases comes from the same few sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.columns import count_where, n_rows, scalar
from tracewell.functions.tables import measured_broadcast
from tracewell.session import cut_lineage
from tracewell.spec import CASE


@dataclass
class LinearExplainer:
    """`weights`: (feature_index, feature_name, coefficient, mean, offset), one row for each feature."""

    weights: DataFrame
    intercept: float

    @staticmethod
    def build(coefficients: DataFrame, intercept: float, background_cells: DataFrame, background_cases: int) -> LinearExplainer:
        """`coefficients` has feature_index, feature_name and coefficient; background cells left out are zeros."""
        sums = background_cells.groupBy("feature_index").agg(F.sum("value").alias("__sum"))
        mean = F.coalesce(F.col("__sum") / background_cases, F.lit(0.0))
        weights = coefficients.join(sums, "feature_index", "left").select(
            "feature_index", "feature_name", "coefficient", mean.alias("mean"), (-F.col("coefficient") * mean).alias("offset"))
        return LinearExplainer(cut_lineage(weights), float(intercept))

    def base_value(self) -> Column:
        """The score of a case that has the mean of every feature."""
        return F.lit(self.intercept) - scalar(self.weights, F.coalesce(F.sum("offset"), F.lit(0.0)))


def linear_attribution(explainer: LinearExplainer, cells: DataFrame) -> DataFrame:
    """(case_id, feature_index, feature, value, shap_value) of the present features of each case; a feature without a
    coefficient contributes nothing."""
    met = cells.join(measured_broadcast(explainer.weights), "feature_index")
    return met.select(
        CASE, "feature_index", F.col("feature_name").alias("feature"), "value",
        (F.col("coefficient") * (F.col("value") - F.col("mean"))).alias("shap_value"), "offset")


def case_totals(explainer: LinearExplainer, cells: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, present_features, base_value, present_value, absent_value, log_odds, probability) of every case, with
    or without cells. The three values add up to the log-odds."""
    present = linear_attribution(explainer, cells).groupBy(CASE).agg(
        n_rows("present_features"), F.sum("shap_value").alias("present_value"), F.sum("offset").alias("__offset"))
    zero = F.lit(0.0)
    all_offsets = scalar(explainer.weights, F.coalesce(F.sum("offset"), zero))
    rows = cases.select(CASE).join(present, CASE, "left").select(
        CASE, F.coalesce("present_features", F.lit(0)).cast("long").alias("present_features"), explainer.base_value().alias("base_value"),
        F.coalesce("present_value", zero).alias("present_value"), (all_offsets - F.coalesce("__offset", zero)).alias("absent_value"))
    log_odds = F.col("base_value") + F.col("present_value") + F.col("absent_value")
    return rows.withColumn("log_odds", log_odds).withColumn("probability", 1 / (1 + F.exp(-F.col("log_odds"))))


def linear_importance(explainer: LinearExplainer, cells: DataFrame, cases: int) -> DataFrame:
    """(rank, feature, mean_abs_shap, mean_shap, share_of_total_importance) over all cases, the absent features of each included."""
    sums = linear_attribution(explainer, cells).groupBy("feature_index").agg(
        n_rows("__n"), F.sum(F.abs("shap_value")).alias("__abs"), F.sum("shap_value").alias("__sum"))
    absent = cases - F.coalesce("__n", F.lit(0))
    means = explainer.weights.join(sums, "feature_index", "left").select(
        F.col("feature_name").alias("feature"),
        ((F.coalesce("__abs", F.lit(0.0)) + absent * F.abs("offset")) / cases).alias("mean_abs_shap"),
        ((F.coalesce("__sum", F.lit(0.0)) + absent * F.col("offset")) / cases).alias("mean_shap"))
    # one row a feature is left
    order = W.orderBy(F.desc("mean_abs_shap"), "feature")
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return means.select(
        F.row_number().over(order).cast("long").alias("rank"), "feature", "mean_abs_shap", "mean_shap",
        F.try_divide(F.col("mean_abs_shap"), F.sum("mean_abs_shap").over(everything)).alias("share_of_total_importance"))


def linear_additivity(totals: DataFrame, predictions: DataFrame, thresholds: tuple[float, ...] = (1e-9, 1e-6)) -> DataFrame:
    """How far the rebuilt log-odds are from those of the model's probabilities: cases, largest error, cases above each threshold."""
    p = F.col("y_prob")
    error = F.abs(F.col("log_odds") - F.log(p / (1 - p)))
    return totals.join(predictions.select(CASE, "y_prob"), CASE).select(error.alias("e")).agg(
        n_rows("case_count"), F.max("e").alias("max_error"),
        *[count_where(F.col("e") > t).alias(f"above_{t:.0e}".replace("-", "_")) for t in thresholds])
