import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracewell.operators import availability as A
from tracewell.operators import features as X
from tracewell.operators import population as P
from tracewell.operators import profile as E
from tracewell.operators.contracts import ContractError
from tracewell.operators.order import order_events
from tracewell.spec import OutcomeSpec

OUT = OutcomeSpec({"won": 1, "lost": 0})
K = 3
T0 = dt.datetime(2024, 1, 1)
SCHEMA = "case_id string, activity string, ts timestamp, order_key long, resource string, goal string, late double"


def make_log(spark, traces, resources=True):
    rows, key = [], 0
    for case, acts in traces.items():
        for i, a in enumerate(acts):
            rows.append((case, a, T0 + dt.timedelta(seconds=i), key, f"r{i}" if resources else None, case.upper(),
                         1.0 if i >= 3 else None))
            key += 1
    return spark.createDataFrame(rows, SCHEMA)


TRACES = {
    "at_k": ["a", "b", "won", "c"],
    "after_k": ["a", "b", "c", "won", "won"],
    "short": ["a", "won"],
    "open": ["a", "b", "c", "d"],
    "both": ["a", "b", "c", "won", "lost"],
    "exact": ["b", "b", "b", "lost"],
}


def flags(spark, traces=TRACES):
    return P.eligibility(P.case_outcomes(order_events(make_log(spark, traces)), OUT), K)


def test_eligibility_edges(spark):
    got = {r.case_id: r for r in flags(spark).collect()}
    assert {c for c, r in got.items() if r.eligible} == {"after_k", "exact"}
    assert got["at_k"].outcome_position == 3 and not got["at_k"].outcome_after_k
    assert got["both"].outcome_activity is None and got["both"].outcome_position is None
    assert got["open"].outcome_after_k is False and got["open"].distinct_outcome_count == 0
    assert got["after_k"].outcome_event_count == 2 and got["after_k"].target == 1
    assert not got["short"].has_k_events


def test_funnel_is_sequential(spark):
    f = P.eligibility_funnel(flags(spark), K).first()
    assert f.total_cases == f.unresolved_cases + f.excluded_short + f.excluded_early_outcome + f.eligible_cases
    assert (f.no_outcome_cases, f.ambiguous_cases, f.excluded_short, f.excluded_early_outcome) == (1, 1, 1, 1)


def test_strict_mode_refuses_contradictions_and_unmapped_outcomes(spark):
    ordered = order_events(make_log(spark, TRACES))
    with pytest.raises(ContractError):
        P.case_outcomes(ordered, OUT, strict=True)
    cases = P.case_outcomes(ordered, OUT).drop("target")
    with pytest.raises(ContractError):
        P.target_mapping(cases, OutcomeSpec({"won": 1}), strict=True)


def test_prefix_and_suffix_partition_the_eligible_log(spark):
    log, fl = make_log(spark, TRACES), flags(spark)
    prefix = P.safe_prefix(log, fl, K)
    suffix = P.future_suffix(order_events(log), fl, K)
    assert prefix.count() == 2 * K and suffix.count() == 2 + 1
    assert prefix.filter(F.col("activity").isin(OUT.activities)).count() == 0


def test_missing_resource_fails_the_count_map(spark):
    log, fl = make_log(spark, TRACES, resources=False), flags(spark)
    spec = X.FeatureSpec({"goal": "goal"}, {"resource": "resource"}, {"n": "activity"})
    with pytest.raises(Exception, match="missing values"):
        X.case_features(P.safe_prefix(log, fl, K, carry=("target",)), spec).collect()


def test_varying_static_fails(spark):
    log = make_log(spark, TRACES).withColumn("goal", F.col("activity"))
    spec = X.FeatureSpec({"goal": "goal"}, {"activity": "activity"}, {"n": "activity"})
    with pytest.raises(Exception, match="varies"):
        X.case_features(P.safe_prefix(log, flags(spark), K, carry=("target",)), spec).collect()


def test_case_features(spark):
    spec = X.FeatureSpec({"goal": "goal"}, {"activity": "activity"}, {"n_unique_activities": "activity"})
    rows = X.case_features(P.safe_prefix(make_log(spark, TRACES), flags(spark), K, carry=("target",)), spec).collect()
    got = {r.case_id: r for r in rows}
    assert got["exact"].activity_counts == {"b": 3} and got["exact"].n_unique_activities == 1
    assert got["after_k"].activity_counts == {"a": 1, "b": 1, "c": 1}
    for r in rows:
        assert r.prefix_duration_seconds == 2.0 and r.mean_event_gap_seconds * (K - 1) == r.prefix_duration_seconds


def test_attribute_seen_after_k_and_never(spark):
    fl = flags(spark)
    log = make_log(spark, TRACES).withColumn("never", F.lit(None).cast("string"))
    elog = A.eligible_log(order_events(log), fl)
    got = {r.feature: r for r in A.sparse_availability(elog, ["late", "never", "goal"], K).collect()}
    for r in got.values():
        assert r.available_by_k + r.future_only + r.never_observed == r.total_cases == 2
    assert got["late"].future_only == 2 and got["late"].first_seen_min == 4
    assert got["never"].never_observed == 2 and got["never"].first_seen_median is None
    assert got["goal"].available_by_k == 2 and got["goal"].multi_value_cases == 0


def test_missing_by_position_keeps_all_positions(spark):
    prefix = P.safe_prefix(make_log(spark, TRACES), flags(spark), K).filter("event_pos <> 2")
    got = A.missing_by_position(prefix, ["late"], K).collect()
    assert sorted(r.event_pos for r in got) == [1, 2, 3]


def test_policy_refuses_unknown_handling(spark):
    matrix = spark.createDataFrame([("x", "case-level", "Available", "Invented", "")],
                                   "feature string, feature_group string, availability_decision string, "
                                   "model_handling string, reason string")
    with pytest.raises(ContractError):
        A.feature_policy(matrix, {}, strict=True)


def test_target_distribution_counts_cases_not_events(spark):
    got = {r.target: r.case_count for r in E.target_distribution(make_log(spark, TRACES), OUT.activities).collect()}
    assert got == {"won": 4, "lost": 2}


def test_regex_miss_is_ungrouped(spark):
    log = make_log(spark, {"x": ["A_one", "B_two", "none"]})
    got = {r.activity_group: r.event_count for r in E.activity_group(log, "activity", "^([A-Z])_", {"A": "First"}).collect()}
    assert got == {"First": 1, "(ungrouped)": 2}


def test_consistency_counts_null_as_a_value(spark):
    df = spark.createDataFrame([("a", None), ("a", 1), ("b", 1), ("b", 1), ("c", None), ("d", 1), ("d", 2)],
                               "case_id string, v int")
    assert E.case_attr_consistency(df, ["v"]).first().inconsistent_cases == 2


def test_histogram_of_a_constant(spark):
    got = E.histogram(spark.createDataFrame([(3.0,)] * 4, "v double"), "v", 5).orderBy("bin").collect()
    assert [r.case_count for r in got] == [4, 0, 0, 0, 0]
