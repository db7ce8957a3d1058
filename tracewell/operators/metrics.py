"""Exact prediction metrics, overall or per group.

Input tables have `y_true`, `y_pred` in {0, 1} and the positive-class score `y_prob`. Ranking
metrics read one cumulative table of distinct scores, so a group may hold most of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import count_where, n_rows, ratio, scalar
from tracewell.operators.contracts import ContractError
from tracewell.operators.order import exact_quantiles, ordered_cumsum
from tracewell.session import cut_lineage

METRICS = ["roc_auc", "average_precision", "accuracy", "precision", "recall", "f1"]
CELLS = ["tn", "fp", "fn", "tp"]


def _cells() -> list[Column]:
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    conditions = {"tn": ~t & ~p, "fp": ~t & p, "fn": t & ~p, "tp": t & p}
    return [count_where(conditions[c]).alias(c) for c in CELLS]


def _agg(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def confusion(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _agg(df, keys, *_cells())


def _with_threshold_metrics(cells: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in CELLS)
    return cells.withColumns({
        "accuracy": ratio(tp + tn, tn + fp + fn + tp),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    })


def threshold_metrics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1; a zero denominator gives 0."""
    return _with_threshold_metrics(confusion(df, keys)).drop(*CELLS)


def score_table(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per group and distinct score: positives and negatives there, and `tp`/`fp` of the
    threshold at that score (everything scored at least as high)."""
    positive = (F.col("y_true") == 1).cast("long")
    cum = ordered_cumsum(df, ["y_prob"], {"pos": positive, "neg": 1 - positive}, keys)
    return cum.select(
        *keys, "y_prob", "pos", "neg", "cum_pos", "cum_neg", "total_pos", "total_neg",
        (F.col("total_pos") - F.col("cum_pos") + F.col("pos")).alias("tp"),
        (F.col("total_neg") - F.col("cum_neg") + F.col("neg")).alias("fp"),
    )


def ranking_metrics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC with ties counted half and step average precision; null for a one-class group.

    Products are taken in doubles: counts multiply beyond 64 bits on a large table.
    """
    t = score_table(df, keys)
    p, n = F.max("total_pos").cast("double"), F.max("total_neg").cast("double")
    below = F.col("cum_neg") - F.col("neg") / 2
    wins = F.sum(F.col("pos").cast("double") * below)
    steps = F.sum(F.col("pos").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp")))
    both = (p > 0) & (n > 0)
    return _agg(t, keys,
                F.when(both, wins / (p * n)).alias("roc_auc"),
                F.when(both, steps / p).alias("average_precision"))


def roc_auc(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, keys).drop("average_precision")


def average_precision(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, keys).drop("roc_auc")


def roc_curve(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A point per distinct score, and the start (infinity, 0, 0) of each group; the rate of a
    class the group lacks is null."""
    t = score_table(df, keys)
    points = t.select(
        *keys, F.col("y_prob").alias("threshold"),
        F.try_divide("fp", "total_neg").alias("fpr"), F.try_divide("tp", "total_pos").alias("tpr"),
    )
    start = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    first = start.select(*keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(first)


def pr_curve(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision and recall per distinct score with the group's prevalence, closed by the point
    (recall 0, precision 1) beyond all scores."""
    t = score_table(df, keys)
    prevalence = F.col("total_pos") / (F.col("total_pos") + F.col("total_neg"))
    points = t.select(
        *keys, F.col("y_prob").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide("tp", "total_pos").alias("recall"),
        prevalence.alias("prevalence"),
    )
    ends = points.groupBy(*keys).agg(F.max("prevalence").alias("prevalence"))
    return points.unionByName(ends.select(
        *keys, F.lit(float("inf")).alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), "prevalence"))


def _join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two aggregated tables side by side: by key, or as the single rows they are."""
    if keys:
        return left.join(right, list(keys), "left")
    one = scalar(right, F.struct(*right.columns))
    return left.withColumns({c: one.getField(c) for c in right.columns})


def prediction_metrics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All six metrics and the confusion counts per group, with the prevalence beside them."""
    cells = _with_threshold_metrics(confusion(df, keys))
    out = _join_groups(cells, ranking_metrics(df, keys), keys)
    n = reduce(lambda a, b: a + b, [F.col(c) for c in CELLS])
    return out.withColumn("prevalence", ratio(F.col("tp") + F.col("fn"), n)).select(
        *keys, *METRICS, "prevalence", *CELLS
    )


def model_comparison(predictions: DataFrame, model: str = "model") -> DataFrame:
    return prediction_metrics(predictions, [model]).select(model, *METRICS, "prevalence")


def metric_deltas(metrics: DataFrame, baseline: str, key: str = "model") -> DataFrame:
    """Every other model minus the baseline; one row per model, so the baseline is a scalar."""
    base = scalar(metrics.filter(F.col(key) == baseline), F.struct(*METRICS))
    return metrics.filter(F.col(key) != baseline).select(
        F.col(key), *[(F.col(m) - base.getField(m)).alias(f"delta_{m}") for m in METRICS]
    )


def prediction_audit(predictions: Mapping[str, DataFrame], population: DataFrame, key: str = "case_id") -> DataFrame:
    """Violations per model: coverage of the population, labels, probabilities, agreement of
    y_true with the population's target.

    All models are checked against the population in one aggregation by key.
    """
    names = list(predictions)
    base = population.select(key, F.lit("").alias("model"), F.col("target").cast("int").alias("y_true"),
                             F.lit(None).cast("int").alias("y_pred"), F.lit(None).cast("double").alias("y_prob"))
    tagged = [
        df.select(key, F.lit(m).alias("model"), F.col("y_true").cast("int").alias("y_true"),
                  F.col("y_pred").cast("int").alias("y_pred"), F.col("y_prob").cast("double").alias("y_prob"))
        for m, df in predictions.items()
    ]
    rows = reduce(DataFrame.unionByName, [base, *tagged])

    def of(m: str) -> Column:
        return F.col("model") == m

    per_key = rows.groupBy(key).agg(
        F.max(F.when(of(""), F.col("y_true"))).alias("target"),
        count_where(of("")).alias("in_population"),
        *[count_where(of(m)).alias(f"{m}__n") for m in names],
        *[F.max(F.when(of(m), F.col("y_true"))).alias(f"{m}__y") for m in names],
        *[count_where(of(m) & ~F.coalesce(F.col("y_pred").isin(0, 1), F.lit(False))).alias(f"{m}__label") for m in names],
        *[
            count_where(of(m) & ~F.coalesce(F.col("y_prob").between(0.0, 1.0) & ~F.isnan("y_prob"), F.lit(False)))
            .alias(f"{m}__prob") for m in names
        ],
    )
    aggs = [
        F.struct(
            F.lit(m).alias("model"),
            count_where(F.col(f"{m}__n") != F.col("in_population")).alias("coverage_errors"),
            F.sum(f"{m}__label").alias("label_errors"),
            F.sum(f"{m}__prob").alias("probability_errors"),
            count_where(~F.col(f"{m}__y").eqNullSafe(F.col("target"))).alias("target_disagreements"),
        ).alias(f"r{i}")
        for i, m in enumerate(names)
    ]
    return per_key.agg(*aggs).select(F.explode(F.array(*[f"r{i}" for i in range(len(names))])).alias("r")).select("r.*")


def stored_predictions_audit(recomputed: DataFrame, stored: DataFrame, key: str = "case_id", tolerance: float = 1e-12) -> DataFrame:
    """What a stored prediction table gets wrong against a recomputed one: rows on one side only,
    other labels, other probabilities."""
    sides = [df.select(key, F.struct("y_pred", "y_prob").alias(n)) for df, n in ((recomputed, "r"), (stored, "s"))]
    both = sides[0].join(sides[1], key, "full_outer")
    r, s = F.col("r"), F.col("s")
    close = F.coalesce(F.abs(r["y_prob"] - s["y_prob"]) <= tolerance, F.lit(False))
    return both.agg(
        n_rows("cases"), count_where(s.isNull()).alias("not_stored"), count_where(r.isNull()).alias("not_recomputed"),
        count_where(r.isNotNull() & s.isNotNull() & ~r["y_pred"].eqNullSafe(s["y_pred"])).alias("label_differences"),
        count_where(r.isNotNull() & s.isNotNull() & ~close).alias("probability_differences"),
    )


# --- windows ----------------------------------------------------------------------------

def window_metrics(df: DataFrame, window: str = "window", strict: bool = False) -> DataFrame:
    """Size, classes, probability summary and all metrics per window.

    Strict mode refuses a window lacking a class, where the ranking metrics are null. The four
    columns are checkpointed once and read by each part.
    """
    df = cut_lineage(df.select(window, "y_true", "y_pred", "y_prob"))
    stats = df.groupBy(window).agg(
        n_rows("n_cases"),
        count_where(F.col("y_true") == 1).alias("success_count"),
        count_where(F.col("y_true") == 0).alias("unsuccessful_count"),
        F.avg(F.col("y_true").cast("double")).alias("success_rate"),
        F.avg("y_prob").alias("mean_probability"),
        F.stddev_pop("y_prob").alias("std_probability"),
    )
    if strict:
        bad = [r[0] for r in stats.filter("success_count = 0 or unsuccessful_count = 0").select(window).limit(20).collect()]
        if bad:
            raise ContractError(f"windows with one class only: {bad}")
    medians = exact_quantiles(df, "y_prob", {"median_probability": 0.5}, [window])
    return stats.join(medians, window, "left").join(prediction_metrics(df, [window]).drop("prevalence"), window, "left")


DELTA_METRICS = ["success_rate", "mean_probability", *METRICS]


def window_pairs(names: Sequence[str]) -> list[tuple[str, str]]:
    """Adjacent windows, then first against last."""
    pairs = list(zip(names, names[1:]))
    return pairs if len(names) < 3 else [*pairs, (names[0], names[-1])]


def window_deltas(metrics: DataFrame, names: Sequence[str], window: str = "window") -> DataFrame:
    """Later minus earlier for every pair, from the few rows of the metrics table."""
    wide = metrics.agg(*[
        F.max(F.when(F.col(window) == w, F.col(m))).alias(f"{m}__{w}") for w in names for m in DELTA_METRICS
    ])
    rows = [
        F.struct(F.lit(f"{a}_to_{b}").alias("comparison"),
                 *[(F.col(f"{m}__{b}") - F.col(f"{m}__{a}")).alias(f"delta_{m}") for m in DELTA_METRICS])
        for a, b in window_pairs(names)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def overall_vs_window(df: DataFrame, window: str = "window") -> DataFrame:
    """Confusion and threshold metrics per window and overall in one pass, and whether the
    windows add up to the whole."""
    sets = df.groupingSets([[window], []], window).agg(F.grouping(window).alias("__all"), *_cells())
    labelled = sets.select(
        F.when(F.col("__all") == 1, F.lit("(all)")).otherwise(F.col(window).cast("string")).alias("part"), *CELLS
    )
    parts = scalar(labelled.filter("part <> '(all)'"), F.struct(*[F.sum(c).alias(c) for c in CELLS]))
    whole = scalar(labelled.filter("part = '(all)'"), F.struct(*CELLS))
    same = reduce(lambda a, b: a & b, [parts.getField(c) == whole.getField(c) for c in CELLS])
    return _with_threshold_metrics(labelled).withColumn("windows_add_up", same)


def sample_prediction_audit(df: DataFrame) -> DataFrame:
    """Confusion counts of a sample, which categories occur, probability range."""
    out = df.agg(*_cells(), F.min("y_prob").alias("min_probability"), F.avg("y_prob").alias("mean_probability"),
                 F.max("y_prob").alias("max_probability"))
    return out.withColumns({f"has_{c}": F.col(c) > 0 for c in CELLS})


def early_outcome_class(eligible_flags: DataFrame, k: int) -> DataFrame:
    """Which class the cases excluded for an early outcome belong to."""
    early = F.col("valid_target") & F.col("has_k_events") & F.coalesce(F.col("outcome_position") <= k, F.lit(False))
    return eligible_flags.agg(
        count_where(early).alias("early_outcome_cases"),
        count_where(early & (F.col("target") == 1)).alias("early_success"),
        count_where(early & (F.col("target") == 0)).alias("early_unsuccessful"),
    )
