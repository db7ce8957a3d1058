"""Uncertainty of the area under the ROC curve by placement values, without looking at pairs of cases.

The placement of a positive case is the share of negative cases scored below it, ties counted half; that of a
negative case is the share of positive cases scored above it. Both come from the running counts over
distinct scores. Their means are the area, and their variances give its variance; the covariance of two
models over the same cases comes from the covariances of their placements.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import mapped
from tracewell.functions.tables import measured_broadcast
from tracewell.operators.metrics import score_table, window_pairs
from tracewell.session import cut_lineage
from tracewell.spec import CASE

LEVEL = 0.95


def _quantile(level: float) -> float:
    """The normal quantile that leaves (1 - level) / 2 above it."""
    return NormalDist().inv_cdf(0.5 + level / 2)


def placements(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per group and distinct score: positives and negatives there, and the placement of each of them; null where the
    group lacks the other class."""
    t = score_table(df, keys)
    below = F.col("cum_neg") - F.col("neg") / 2
    above = F.col("total_pos") - F.col("cum_pos") + F.col("pos") / 2
    return t.select(*keys, "y_prob", "pos", "neg", "total_pos", "total_neg",
                    F.try_divide(below, F.col("total_neg")).alias("pos_placement"),
                    F.try_divide(above, F.col("total_pos")).alias("neg_placement"))


def _variance(value: str, weight: str) -> Column:
    """Sample variance of a value that occurs `weight` times; null below two."""
    n = F.sum(weight).cast("double")
    mean = F.try_divide(F.sum(F.col(weight) * F.col(value)), n)
    squares = F.sum(F.col(weight) * F.col(value) * F.col(value))
    return F.when(n > 1, F.greatest(F.try_divide(squares - n * mean * mean, n - 1), F.lit(0.0)))


def auc_variance(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, positives, negatives, roc_auc, variance); null where a class has fewer than two cases."""
    t = placements(df, keys)
    grouped = t.groupBy(*keys) if keys else t.groupBy()
    out = grouped.agg(
        F.coalesce(F.max("total_pos"), F.lit(0)).cast("long").alias("positives"), F.coalesce(F.max("total_neg"), F.lit(0)).cast("long").alias("negatives"),
        F.try_divide(F.sum(F.col("pos") * F.col("pos_placement")), F.max("total_pos")).alias("roc_auc"),
        _variance("pos_placement", "pos").alias("__p"), _variance("neg_placement", "neg").alias("__n"))
    return out.withColumn("variance", F.try_divide("__p", "positives") + F.try_divide("__n", "negatives")).drop("__p", "__n")


def _with_interval(df: DataFrame, value: str, variance: str, level: float, low: float, high: float) -> DataFrame:
    margin = _quantile(level) * F.sqrt(variance)
    return df.withColumns({
        "standard_error": F.sqrt(variance),
        "lower": F.greatest(F.col(value) - margin, F.when(F.col(variance).isNotNull(), F.lit(low))),
        "upper": F.least(F.col(value) + margin, F.when(F.col(variance).isNotNull(), F.lit(high)))})


def auc_intervals(df: DataFrame, keys: Sequence[str] = (), level: float = LEVEL) -> DataFrame:
    """The area of each group with its standard error and the interval that holds it with probability `level`."""
    return _with_interval(auc_variance(df, keys), "roc_auc", "variance", level, 0.0, 1.0)


def auc_changes(df: DataFrame, names: Sequence[str], window: str = "window", level: float = LEVEL) -> DataFrame:
    """Later minus earlier area for pairs of windows, whose cases are different ones: the variances add up. A change is
    called only where the interval leaves out zero."""
    each = auc_variance(df, [window]).select(F.struct(window, "roc_auc", "variance").alias("r"))
    wide = each.agg(*[F.max(F.when(F.col(f"r.{window}") == w, F.col("r"))).alias(f"__{w}") for w in names])
    rows = [F.struct(F.lit(f"{a}_to_{b}").alias("comparison"), (F.col(f"__{b}.roc_auc") - F.col(f"__{a}.roc_auc")).alias("delta_roc_auc"),
                     (F.col(f"__{a}.variance") + F.col(f"__{b}.variance")).alias("variance")) for a, b in window_pairs(names)]
    out = _with_interval(wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*"), "delta_roc_auc", "variance", level, -1.0, 1.0)
    finding = F.when(F.col("variance").isNull(), "undefined").when(F.col("lower") > 0, "rose").when(F.col("upper") < 0, "fell").otherwise("no change shown")
    return out.withColumn("finding", finding)


def auc_differences(scored: DataFrame, models: Sequence[str], keys: Sequence[str] = (), model: str = "model", level: float = LEVEL) -> DataFrame:
    """Differences between models that scored the same cases: (keys, model_a, model_b, positives, negatives, roc_auc_a, roc_auc_b,
    difference, covariance, variance, standard_error, lower, upper, z). `scored` has a row for each case and model.

    A case that a model did not score is left out of the pairs of that model.
    """
    keys, models = list(keys), list(models)
    scored = cut_lineage(scored.select(*keys, CASE, model, "y_true", "y_prob"))
    table = measured_broadcast(placements(scored, [*keys, model]).select(*keys, model, "y_prob", "pos_placement", "neg_placement"))
    placed = scored.join(table, [*keys, model, "y_prob"])
    own = F.when(F.col("y_true") == 1, F.col("pos_placement")).otherwise(F.col("neg_placement"))
    # one row for each case with the placements of all models: any pair is an aggregation of two columns
    number = mapped(F.col(model), {m: i for i, m in enumerate(models)})
    wide = placed.groupBy(*keys, CASE).agg(
        F.max("y_true").alias("y_true"), *[F.max(F.when(number == i, own)).alias(f"__v{i}") for i in range(len(models))])
    pairs = list(combinations(range(len(models)), 2))
    aggs = [F.count(F.when(F.col("y_true") == 1, 1)).alias("positives"), F.count(F.when(F.col("y_true") == 0, 1)).alias("negatives")]
    for a, b in pairs:
        both = F.col(f"__v{a}").isNotNull() & F.col(f"__v{b}").isNotNull()
        for label in (1, 0):
            x, y = (F.when(both & (F.col("y_true") == label), F.col(f"__v{i}")) for i in (a, b))
            aggs += [F.struct(F.count(x).alias("n"), F.avg(x).alias("a"), F.avg(y).alias("b"), F.var_samp(x).alias("va"), F.var_samp(y).alias("vb"),
                              F.covar_samp(x, y).alias("c")).alias(f"__s{a}_{b}_{label}")]
    sums = (wide.groupBy(*keys) if keys else wide.groupBy()).agg(*aggs)

    def row(a: int, b: int) -> Column:
        p, n = F.col(f"__s{a}_{b}_1"), F.col(f"__s{a}_{b}_0")
        total = lambda field: F.try_divide(p[field], p["n"]) + F.try_divide(n[field], n["n"])
        return F.struct(
            F.lit(models[a]).alias("model_a"), F.lit(models[b]).alias("model_b"), p["n"].alias("positives"), n["n"].alias("negatives"),
            p["a"].alias("roc_auc_a"), p["b"].alias("roc_auc_b"), (p["b"] - p["a"]).alias("difference"),
            total("c").alias("covariance"), F.greatest(total("va") + total("vb") - 2 * total("c"), F.lit(0.0)).alias("variance"))

    out = sums.select(*keys, F.explode(F.array(*[row(a, b) for a, b in pairs])).alias("r")).select(*keys, "r.*")
    out = _with_interval(out, "difference", "variance", level, -1.0, 1.0)
    return out.withColumn("z", F.try_divide(F.col("difference"), F.col("standard_error")))
