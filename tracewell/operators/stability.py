"""Do attributions move across windows. Tables here are windows x features: small by nature."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.columns import count_where, mapped, n_rows, ratio
from tracewell.functions.pvalue import correlation_pvalue_udf
from tracewell.operators.metrics import DELTA_METRICS, window_pairs

ZERO = 1e-12


def window_importance(attributions: DataFrame) -> DataFrame:
    """Mean absolute, mean signed and std (ddof 0) of the absolute contribution."""
    phi = F.col("shap_value")
    return attributions.groupBy("window", "feature").agg(
        F.avg(F.abs(phi)).alias("mean_abs_shap"),
        F.avg(phi).alias("mean_signed_shap"),
        F.stddev_pop(F.abs(phi)).alias("std_abs_shap"),
    )


def window_rank(importance: DataFrame) -> DataFrame:
    w = W.partitionBy("window").orderBy(F.desc("mean_abs_shap"), "feature")
    return importance.withColumn("rank", F.row_number().over(w).cast("long"))


def window_top_k(ranked: DataFrame, k: int = 10) -> DataFrame:
    return ranked.filter(F.col("rank") <= k).select("window", "rank", "feature", "mean_abs_shap", "mean_signed_shap")


def _presence(top: DataFrame, names: Sequence[str]) -> DataFrame:
    return top.groupBy("feature").agg(*[F.max((F.col("window") == w).cast("int")).alias(w) for w in names])


def _rows(wide: DataFrame, structs: Sequence[Column]) -> DataFrame:
    return wide.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def jaccard_at_k(top: DataFrame, names: Sequence[str]) -> DataFrame:
    """Overlap of the top sets of every window pair, from one presence table."""
    flags = _presence(top, names)
    pairs = window_pairs(names)
    wide = flags.agg(*[
        c for a, b in pairs for c in (
            count_where((F.col(a) == 1) & (F.col(b) == 1)).alias(f"{a}{b}_both"),
            count_where((F.col(a) == 1) | (F.col(b) == 1)).alias(f"{a}{b}_any"),
        )
    ])
    return _rows(wide, [
        F.struct(
            F.lit(f"{a}_to_{b}").alias("comparison"), F.lit(a).alias("window_a"), F.lit(b).alias("window_b"),
            F.col(f"{a}{b}_both").alias("intersection_count"), F.col(f"{a}{b}_any").alias("union_count"),
            ratio(F.col(f"{a}{b}_both"), F.col(f"{a}{b}_any")).alias("jaccard"),
        )
        for a, b in pairs
    ])


def spearman(importance: DataFrame, names: Sequence[str], p_value: bool = True) -> DataFrame:
    """Correlation of average ranks over all features, per pair, with its two-sided p."""
    by_value = W.partitionBy("window").orderBy("mean_abs_shap")
    ties = W.partitionBy("window", "mean_abs_shap")
    average_rank = F.rank().over(by_value) + (F.count(F.lit(1)).over(ties) - 1) / 2
    ranks = importance.select("window", "feature", average_rank.alias("r"))
    wide = ranks.groupBy("feature").agg(*[F.max(F.when(F.col("window") == w, F.col("r"))).alias(w) for w in names])
    pairs = window_pairs(names)
    one = wide.agg(F.count(F.lit(1)).alias("n"), *[F.corr(a, b).alias(f"{a}{b}") for a, b in pairs])
    out = _rows(one, [
        F.struct(F.lit(f"{a}_to_{b}").alias("comparison"), F.col(f"{a}{b}").alias("spearman_rho"), F.col("n").alias("features"))
        for a, b in pairs
    ])
    return out.withColumn("spearman_pvalue", correlation_pvalue_udf("spearman_rho", "features")) if p_value else out


def stability_table(importance: DataFrame, names: Sequence[str], k: int = 10, p_value: bool = True) -> DataFrame:
    top = window_top_k(window_rank(importance), k)
    return jaccard_at_k(top, names).join(spearman(importance, names, p_value), "comparison").withColumn("top_k", F.lit(k))


def _sign(c: Column) -> Column:
    return F.when(c > ZERO, "positive").when(c < -ZERO, "negative").otherwise("zero")


def signed_summary(ranked: DataFrame, names: Sequence[str], k: int = 10) -> DataFrame:
    """Union of the top sets: signed mean and sign per window, and sign changes per pair,
    ordered by the largest importance."""
    wide = ranked.groupBy("feature").agg(
        F.min("rank").alias("__best"),
        F.max("mean_abs_shap").alias("max_importance"),
        *[F.max(F.when(F.col("window") == w, F.col("mean_signed_shap"))).alias(f"{w}_mean_signed_shap") for w in names],
    ).filter(F.col("__best") <= k).drop("__best")
    signs = wide.withColumns({f"{w}_sign": _sign(F.col(f"{w}_mean_signed_shap")) for w in names})
    changes = {f"sign_change_{a}_{b}": F.col(f"{a}_sign") != F.col(f"{b}_sign") for a, b in window_pairs(names)}
    return signs.withColumns(changes).orderBy(F.desc("max_importance"), "feature")


def importance_heatmap(ranked: DataFrame, names: Sequence[str], k: int = 10) -> DataFrame:
    """Mean absolute contribution of the union features, a column per window."""
    return ranked.groupBy("feature").agg(
        F.min("rank").alias("__best"),
        *[F.max(F.when(F.col("window") == w, F.col("mean_abs_shap"))).alias(w) for w in names],
    ).filter(F.col("__best") <= k).drop("__best")


def window_group_importance(importance: DataFrame, groups: DataFrame) -> DataFrame:
    """Totals, means and shares of feature groups per window. `groups` maps feature -> group."""
    sums = importance.join(groups.select("feature", "group"), "feature").groupBy("window", "group").agg(
        n_rows("feature_count"), F.sum("mean_abs_shap").alias("group_total_importance")
    )
    total = F.sum("group_total_importance").over(W.partitionBy("window"))
    return sums.withColumns({
        "group_mean_importance_per_feature": F.col("group_total_importance") / F.col("feature_count"),
        "share_of_total_importance": F.try_divide(F.col("group_total_importance"), total),
    })


def synthesis(deltas: DataFrame, stability: DataFrame) -> DataFrame:
    """Prediction deltas beside attribution stability per comparison."""
    right = stability.select("comparison", "window_a", "window_b", "jaccard", "spearman_rho",
                             F.col("intersection_count").alias("top_intersection_count"),
                             F.col("union_count").alias("top_union_count"))
    return deltas.join(right, "comparison")


def feature_continuity(top: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per feature of the union: windows it is in, and where it enters or leaves."""
    flags = _presence(top, names)
    out = flags.withColumn("in_all_windows", reduce(lambda a, b: a & b, [F.col(w) == 1 for w in names]))
    for a, b in zip(names, names[1:]):
        out = out.withColumn(f"enters_{b}", (F.col(a) == 0) & (F.col(b) == 1))
        out = out.withColumn(f"leaves_{b}", (F.col(a) == 1) & (F.col(b) == 0))
    return out


def continuity_summary(top: DataFrame, names: Sequence[str]) -> DataFrame:
    c = feature_continuity(top, names)
    differs = (F.col(names[0]) != F.col(names[-1]))
    return c.agg(
        n_rows("union_count"),
        count_where(F.col("in_all_windows")).alias("all_window_count"),
        *[count_where(F.col(f"enters_{w}")).alias(f"entering_{w}") for w in names[1:]],
        *[count_where(F.col(f"leaves_{w}")).alias(f"leaving_{w}") for w in names[1:]],
        (count_where(differs) == 0).alias("first_last_identical"),
    )


def temporary_sign_change(signed: DataFrame, names: Sequence[str]) -> DataFrame:
    """Features whose sign is the same at both ends but differs in a window between."""
    ends = F.col(f"{names[0]}_sign") == F.col(f"{names[-1]}_sign")
    middle = reduce(lambda a, b: a | b, [F.col(f"{w}_sign") != F.col(f"{names[0]}_sign") for w in names[1:-1]])
    return signed.filter(ends & middle).select("feature", *[f"{w}_sign" for w in names])


def findings(deltas: DataFrame, tolerance: float = ZERO) -> DataFrame:
    """Direction facts derived from the signs of the deltas."""
    columns = [f"delta_{m}" for m in DELTA_METRICS]
    long = deltas.unpivot(["comparison"], columns, "measure", "delta")
    direction = (
        F.when(F.col("delta").isNull(), "undefined").when(F.col("delta") > tolerance, "rose")
        .when(F.col("delta") < -tolerance, "fell").otherwise("unchanged")
    )
    measure = mapped(F.col("measure"), {c: c.removeprefix("delta_") for c in columns})
    return long.select("comparison", measure.alias("measure"), "delta", direction.alias("direction"))
