"""Outcome labels, eligibility, and leakage-safe prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import count_where, mapped, n_rows
from tracewell.operators.contracts import ContractError
from tracewell.operators.order import first_events
from tracewell.spec import ACTIVITY, CASE, POS, TS, OutcomeSpec


def case_outcomes(ordered: DataFrame, outcomes: OutcomeSpec, strict: bool = False) -> DataFrame:
    """One row per case: size, outcome counts, and the label when it is unambiguous.

    The label and its earliest position exist only for cases with exactly one distinct
    outcome. One pass with fixed-width buffers: each declared outcome has its own flag, so no
    distinct aggregation and no self-join. Strict mode refuses contradictory cases.
    """
    names = outcomes.activities
    is_outcome = F.col(ACTIVITY).isin(names)
    flags = [F.max((F.col(ACTIVITY) == o).cast("int")).alias(f"__has_{i}") for i, o in enumerate(names)]
    cases = ordered.groupBy(CASE).agg(
        F.min(TS).alias("case_start_time"),
        n_rows("n_events"),
        count_where(is_outcome).alias("outcome_event_count"),
        F.min(F.when(is_outcome, F.col(POS))).cast("long").alias("__first"),
        *flags,
    )
    distinct = sum((F.col(f"__has_{i}") for i in range(len(names))), F.lit(0))
    label = F.lit(None).cast("string")
    for i, o in enumerate(names):
        label = F.when(F.col(f"__has_{i}") == 1, F.lit(o)).otherwise(label)
    out = cases.withColumn("distinct_outcome_count", distinct.cast("long"))
    valid = F.col("distinct_outcome_count") == 1
    out = out.select(
        CASE,
        "case_start_time",
        "n_events",
        "outcome_event_count",
        "distinct_outcome_count",
        F.when(valid, label).alias("outcome_activity"),
        F.when(valid, F.col("__first")).alias("outcome_position"),
        valid.alias("valid_target"),
    )
    if strict:
        sample = contradictory_outcomes(ordered, outcomes).collect()
        if sample:
            raise ContractError(f"contradictory outcomes, sample: {[tuple(r) for r in sample]}")
    return target_mapping(out, outcomes)


def target_mapping(cases: DataFrame, outcomes: OutcomeSpec, strict: bool = False) -> DataFrame:
    """Add the binary `target` of the outcome label; strict mode refuses an unmapped label."""
    out = cases.withColumn("target", mapped(F.col("outcome_activity"), outcomes.targets).cast("int"))
    if strict:
        bad = out.filter(F.col("outcome_activity").isNotNull() & F.col("target").isNull())
        labels = [r[0] for r in bad.select("outcome_activity").distinct().limit(20).collect()]
        if labels:
            raise ContractError(f"outcomes without a target: {labels}")
    return out


def contradictory_outcomes(ordered: DataFrame, outcomes: OutcomeSpec, limit: int | None = None) -> DataFrame:
    """Cases with more than one distinct outcome, their sorted labels joined by ' | '; all of
    them, or the first `limit` by case."""
    sets = (
        ordered.filter(F.col(ACTIVITY).isin(outcomes.activities))
        .groupBy(CASE)
        .agg(F.array_sort(F.collect_set(ACTIVITY)).alias("labels"))
        .filter(F.size("labels") > 1)
        .select(CASE, F.array_join("labels", " | ").alias("labels"))
    )
    return sets.orderBy(CASE).limit(limit) if limit else sets


def eligibility(cases: DataFrame, k: int) -> DataFrame:
    """Valid label, at least k events, outcome strictly after k; a missing position is not after."""
    return cases.withColumns({
        "has_k_events": F.col("n_events") >= k,
        "outcome_after_k": F.coalesce(F.col("outcome_position") > k, F.lit(False)),
    }).withColumn("eligible", F.col("valid_target") & F.col("has_k_events") & F.col("outcome_after_k"))


def eligibility_funnel(eligible_flags: DataFrame, k: int) -> DataFrame:
    """Sequential exclusion counts beside unconditional ones, in one aggregation."""
    valid, enough, ok = F.col("valid_target"), F.col("has_k_events"), F.col("eligible")
    early = F.coalesce(F.col("outcome_position") <= k, F.lit(False))
    return eligible_flags.agg(
        F.lit(k).cast("long").alias("prediction_point"),
        n_rows("total_cases"),
        count_where(valid).alias("valid_target_cases"),
        count_where(~valid).alias("unresolved_cases"),
        count_where(~enough).alias("cases_lt_k_events"),
        count_where(valid & early).alias("outcome_at_or_before_k"),
        count_where(ok).alias("eligible_cases"),
        count_where(ok & (F.col("target") == 1)).alias("eligible_success"),
        count_where(ok & (F.col("target") == 0)).alias("eligible_unsuccessful"),
        count_where(F.col("outcome_event_count") == 0).alias("no_outcome_cases"),
        count_where(F.col("distinct_outcome_count") > 1).alias("ambiguous_cases"),
        count_where(valid & (F.col("outcome_event_count") > 1)).alias("repeated_same_outcome"),
        count_where(valid & ~enough).alias("excluded_short"),
        count_where(valid & enough & early).alias("excluded_early_outcome"),
    )


def eligible_cases(eligible_flags: DataFrame) -> DataFrame:
    return eligible_flags.filter("eligible").select(
        CASE, "case_start_time", "n_events", "outcome_activity", "outcome_position", "target"
    )


def safe_prefix(
    log: DataFrame, eligible_flags: DataFrame, k: int, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Events 1..k of the eligible cases, optionally with case columns such as `target`.

    Takes the unordered log: only k rows per case and input task are shuffled with their full
    width, while the labels come from the narrow branch behind `eligible_flags`.
    """
    keep = eligible_flags.filter("eligible").select(CASE, *carry)
    return first_events(log, k).join(keep, CASE, "inner" if carry else "left_semi")


def future_suffix(ordered: DataFrame, eligible_flags: DataFrame, k: int) -> DataFrame:
    keep = eligible_flags.filter("eligible").select(CASE)
    return ordered.filter(F.col(POS) > k).join(keep, CASE, "left_semi")


def prefix_summary(ordered: DataFrame, eligible_flags: DataFrame, outcomes: OutcomeSpec, k: int) -> DataFrame:
    """Twelve boundary counts. Prefix and suffix sizes follow from the case sizes; only the
    outcome-inside-prefix audit looks at events again."""
    ok = F.col("eligible")
    n = F.col("n_events")
    early = F.coalesce(F.col("outcome_position") <= k, F.lit(False))
    inside = (
        ordered.filter((F.col(POS) <= k) & F.col(ACTIVITY).isin(outcomes.activities))
        .join(eligible_flags.filter("eligible").select(CASE), CASE, "left_semi")
        .agg(n_rows("n"))
    )
    return eligible_flags.agg(
        F.lit(k).cast("long").alias("prediction_point"),
        n_rows("total_cases"),
        count_where(F.col("outcome_event_count") > 0).alias("cases_with_outcome"),
        count_where(F.col("distinct_outcome_count") == 1).alias("cases_with_one_distinct_outcome"),
        count_where(F.col("distinct_outcome_count") > 1).alias("cases_with_ambiguous_outcome"),
        count_where(F.col("outcome_event_count") > F.col("distinct_outcome_count"))
        .alias("cases_with_repeated_outcome_events"),
        count_where(F.col("outcome_event_count") == 0).alias("cases_without_outcome"),
        count_where(early).alias("cases_with_outcome_by_k"),
        count_where(ok).alias("eligible_cases"),
        F.coalesce(F.sum(F.when(ok, F.least(n, F.lit(k)))), F.lit(0)).alias("prefix_rows"),
        F.coalesce(F.sum(F.when(ok, F.greatest(n - k, F.lit(0)))), F.lit(0)).alias("future_rows"),
    ).withColumn("outcome_inside_prefix", inside.scalar())
