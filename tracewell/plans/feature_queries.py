"""Availability, feature, split and encoding queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import micros, n_rows, rounded
from tracewell.operators import availability as A
from tracewell.operators import contracts as C
from tracewell.operators import encode as N
from tracewell.operators import features as X
from tracewell.operators import profile as E
from tracewell.operators import temporal as T
from tracewell.operators.population import safe_prefix
from tracewell.plans import sql
from tracewell.plans.tables import (
    L1_CREATE, L1_K, L1_LINK, L1_OUTCOMES, L1_SPARSE, L1_STATES, L1_STATIC, L2_STATIC, WINDOWS,
    flags, l1, l1_cases, l1_ordered, l1_prefix, l2,
)
from tracewell.presets import HANDLING_POLICY
from tracewell.session import cut_lineage, scratch_path

OUTS = L1_OUTCOMES.activities
STATES = list(L1_STATES.values())
FEATURES = X.FeatureSpec(
    statics={"segment": "segment", "credit_limit": "credit_limit"},
    count_maps={"activity": "activity", "event_type": "event_type", "resource": "resource", "k_bucket": "bucket"},
    uniques={"n_unique_activities": "activity", "n_unique_resources": "resource"},
)
ENCODE = N.EncodeSpec(
    numeric=["credit_limit", *FEATURES.numeric_summary], categorical=["segment"], maps=FEATURES.map_columns
)
SAMPLE_N = 100
# A mean of two gaps in whole microseconds has seven decimals.
GAP_DIGITS = 7

# Declared decisions for the attributes of the outcome log.
_YES = {"practically_available": "Yes", "future_dependency": "No", "availability_decision": "Available"}
_COND = {"practically_available": "Conditional", "future_dependency": "No, if observed by k",
         "availability_decision": "Conditionally Available",
         "model_handling": "Use only when observed within the prefix"}
DECISIONS = [
    {"feature": "segment", **_YES, "model_handling": "Candidate model feature", "reason": "case attribute", "notes": ""},
    {"feature": "credit_limit", **_YES, "model_handling": "Candidate model feature", "reason": "case attribute",
     "notes": "zero is observed"},
    {"feature": "activity", **_YES, "model_handling": "Prefix-safe encoding or aggregation", "reason": "event context", "notes": ""},
    {"feature": "resource", **_YES, "model_handling": "Evaluate raw-resource generalization separately",
     "reason": "event context", "notes": ""},
    {"feature": "ts", **_YES, "model_handling": "Use prefix-derived temporal features only", "reason": "event time", "notes": ""},
    {"feature": "amount", **_COND, "reason": "set on creation", "notes": "never backfilled"},
    {"feature": "rating", **_COND, "reason": "set on clicks", "notes": "never backfilled"},
    {"feature": "selected", "practically_available": "No", "future_dependency": "Yes, semantic",
     "availability_decision": "Leakage Risk", "model_handling": "Exclude", "reason": "reflects a later choice", "notes": ""},
    {"feature": "order_key", **_YES, "model_handling": "Exclude as a raw identifier", "reason": "identifier", "notes": ""},
]


def _us(df, *cols):
    return df.withColumns({c: micros(F.col(c)) for c in cols})


def elog(s, d):
    ordered = l1_ordered(s, d)
    return A.eligible_log(ordered, flags(ordered))


def case_features(s, d) -> DataFrame:
    prefix = safe_prefix(l1(s, d), l1_cases(s, d), L1_K, carry=("target",))
    return X.case_features(prefix, FEATURES)


def _feature_checks(s, d):
    prefix = cut_lineage(safe_prefix(l1(s, d), l1_cases(s, d), L1_K, carry=("target",)))
    return X.feature_table_checks(X.case_features(prefix, FEATURES), prefix, FEATURES, OUTS, L1_K)


def split_features(s, d) -> tuple[DataFrame, DataFrame]:
    """Train and test case features; the feature table is built once and read back."""
    table = cut_lineage(case_features(s, d))
    split, _ = T.temporal_split(table, "case_start_time")
    return split.filter("split = 'train'").drop("split"), split.filter("split = 'test'").drop("split")


def _flat(features: DataFrame) -> DataFrame:
    out = _us(features, "case_start_time")
    for m in FEATURES.map_columns:
        out = out.withColumn(m, F.to_json(m))
    return out


def _matrix(s, d, strict=True):
    # Case-level and sparse attributes share one pass; the prefix is k rows per case.
    measured = A.sparse_availability(elog(s, d), ["segment", "credit_limit", "amount", "rating", "selected"], L1_K)
    measured = measured.select("feature", "available_by_k", "available_by_k_pct")
    prefix = cut_lineage(l1_prefix(s, d))
    is_static = F.col("feature").isin(L1_STATIC)
    events = A.event_completeness(prefix, ["activity", "resource", "ts"])
    ids = A.identifier_audit(prefix, ["order_key"])
    return A.availability_matrix({
        "case-level": measured.filter(is_static),
        "event-process": events.select("feature", "cases_with_value", "case_coverage_percentage"),
        "offer-sparse": measured.filter(~is_static),
        "identifier": ids.select("feature", "cases_with_value", "case_coverage_percentage"),
    }, A.decision_table(s, DECISIONS), strict)


def _with_measured(matrix, make):
    """A table by feature beside the measured availability."""
    matrix = cut_lineage(matrix)
    return make(matrix).join(matrix.select("feature", "availability_at_k"), "feature")


def _policy(s, d):
    return _with_measured(_matrix(s, d), lambda m: A.feature_policy(m, HANDLING_POLICY, strict=True).select("feature", "handling"))


def _stored_columns(s, d):
    """Columns of a written prefix: as they are, with one missing, and in another order."""
    path = scratch_path(s, "prefix")
    l1_prefix(s, d).select("case_id", "event_pos", "activity").write.parquet(path)
    wanted = {"stored": ["case_id", "event_pos", "activity"], "missing": ["case_id", "outcome"]}
    checks = [_named(C.check_stored_columns(s, path, cols), name) for name, cols in wanted.items()]
    return C.union_checks([*checks, _named(C.check_stored_columns(s, path, ["activity", "case_id", "event_pos"], exact=True), "order")])


def _named(checks, name):
    return checks.withColumn("check", F.concat(F.lit(f"{name}:"), "check"))


def _disjoint(s, d):
    """The split's parts, and two sets of cases that share every sixth."""
    starts = _l2_starts(s, d)
    return C.union_checks([
        C.check_disjoint(*_contracts(s, d)[2:], "case_id"),
        _named(C.check_disjoint(starts.filter("case_id % 2 = 0"), starts.filter("case_id % 3 = 0"), "case_id"), "sixths")])


def _cover(s, d):
    """The split's parts, and parts that leave out cases and repeat others."""
    starts = _l2_starts(s, d)
    parts = [starts.filter("case_id % 2 = 0"), starts.filter("case_id % 3 = 0")]
    return C.union_checks([
        C.check_cover(_contracts(s, d)[2:], starts, "case_id"), _named(C.check_cover(parts, starts, "case_id"), "gaps")])


def _time_order(s, d):
    split, windows = _split(s, d)[0], _windows(s, d)[0]
    by_case = _l2_starts(s, d).withColumn("part", F.when(F.col("case_id") % 2 == 0, "even").otherwise("odd"))
    return C.union_checks([
        C.check_strict_time_order(split, "split", "case_start_time", ["train", "test"]),
        C.check_strict_time_order(windows, "window", "case_start_time", WINDOWS),
        C.check_strict_time_order(by_case, "part", "case_start_time", ["even", "odd"])])


def _leaks(s, d):
    """The prefix as it is, and judged as if it ended a place earlier and views were outcomes."""
    prefix = l1_prefix(s, d)
    return C.union_checks([
        C.check_leakage(prefix, OUTS, L1_K, ["target", "outcome_position"]),
        _named(C.check_leakage(prefix, ["view"], L1_K - 1, ["ts", "target"]), "stricter")])


def _counts(s, d):
    prefix = l1_prefix(s, d)
    per_case = prefix.groupBy("case_id").agg(n_rows())
    views = F.count(F.when(F.col("activity") == "view", 1))
    return C.union_checks([
        C.check_counts(per_case, {"rows_per_case": (F.max("n"), L1_K), "short_cases": (F.count(F.when(F.col("n") < L1_K, 1)), 0)}),
        C.check_counts(prefix, {"views": (views, 0), "rows": (F.count(F.lit(1)), -1)})])


def _linked(ordered):
    return A.link_next_event(ordered, L1_CREATE, L1_LINK, "item_id", ["accepted", "selected"])


def _later(s, d):
    ordered = l1_ordered(s, d)
    states = A.lifecycle_first_state(ordered, "item_id", L1_STATES)
    return A.later_state(_linked(ordered), states, "item_id", STATES)


def _relationship(s, d):
    later = _later(s, d)
    parts = [A.lifecycle_relationship(later, f, STATES) for f in ("accepted", "selected")]
    return reduce(DataFrame.unionByName, parts)


def _l2_starts(s, d):
    """A case table with heavy start-time ties; the target is a function of the case."""
    starts = l2(s, d).groupBy("case_id").agg(F.min("ts").alias("case_start_time"), n_rows("n"))
    return starts.withColumn("target", (F.col("n") >= 10).cast("int")).drop("n")


def _split(s, d):
    return T.temporal_split(_l2_starts(s, d), "case_start_time")


def _split_summary(s, d):
    split, cut = _split(s, d)
    out = T.split_summary(split, "case_start_time", cut, 0.8)
    return _us(out, "train_start", "train_end", "test_start", "test_end", "boundary_timestamp")


def _windows(s, d):
    return T.temporal_windows(_l2_starts(s, d), "case_start_time", WINDOWS)


def _window_rows(s, d):
    return T.temporal_order(_windows(s, d)[0], "case_start_time", "case_id")


def _window_summary(s, d):
    w, cuts = _windows(s, d)
    return _us(T.window_summary(w, "case_start_time", cuts, WINDOWS), "start_time", "end_time")


def _window_bounds(s, d):
    w, cuts = _windows(s, d)
    return _us(T.boundary_table(w, "case_start_time", cuts, WINDOWS), "time_before", "time_after")


def _sample(s, d, seed=42):
    return T.seeded_sample(_l2_starts(s, d), "case_id", SAMPLE_N, seed)


def _samples(s, d):
    train, test = (_split(s, d)[0].filter(f"split = '{p}'") for p in ("train", "test"))
    return train, test, T.seeded_sample(train, "case_id", SAMPLE_N), T.seeded_sample(test, "case_id", SAMPLE_N)


def _sample_distribution(s, d):
    _, _, bg, ex = _samples(s, d)
    both = bg.withColumn("sample", F.lit("background")).unionByName(ex.withColumn("sample", F.lit("explained")))
    return rounded(T.sample_distribution(both))


def _leakage(s, d):
    train, test, bg, ex = _samples(s, d)
    return T.overlap_counts({"train": train, "test": test, "background": bg, "explained": ex}, "case_id")


def _encoded(s, d, form, part):
    train, test = split_features(s, d)
    dictionary = N.vocabulary_fit(train, ENCODE)
    side = train if part == "train" else test
    if form == "linear":
        cells = N.encode_linear(train, side, dictionary, ENCODE)
    else:
        cells = N.encode_tree(side, dictionary, ENCODE)
    return cells, side, dictionary


def _one_hot(s, d):
    train, test = split_features(s, d)
    return N.one_hot(test, N.vocabulary_fit(train, ENCODE), ENCODE)


def _contracts(s, d):
    """The leakage, order, cover and domain contracts over the real stages."""
    prefix = l1_prefix(s, d)
    split, _ = _split(s, d)
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    return prefix, split, train, test


def _finite(s, d):
    """The training cells as they are, and with values of some cases that are no numbers."""
    cells = cut_lineage(_encoded(s, d, "linear", "train")[0])
    case = F.col("case_id")
    spoilt = cells.withColumn("value", F.when(case % 5 == 0, float("nan")).when(case % 7 == 0, float("-inf")).otherwise(F.col("value")))
    rows = [N.finite_check(c).select(F.lit(n).alias("table"), "*") for n, c in (("cells", cells), ("spoilt", spoilt))]
    return rows[0].unionByName(rows[1])


QUERIES = {
    # availability
    "case_attr_availability": lambda s, d: rounded(A.case_attr_availability(elog(s, d), L1_STATIC, L1_K)),
    "first_seen_distribution": lambda s, d: A.first_seen_distribution(elog(s, d), L1_SPARSE),
    "event_completeness": lambda s, d: rounded(A.event_completeness(
        l1_prefix(s, d), ["activity", "resource", "rating", "item_id"])),
    "missing_by_position": lambda s, d: rounded(A.missing_by_position(
        l1_prefix(s, d), ["resource", "rating", "amount"], L1_K)),
    "sparse_availability": lambda s, d: rounded(A.sparse_availability(elog(s, d), L1_SPARSE, L1_K)),
    "attr_context": lambda s, d: A.attr_context(elog(s, d), L1_SPARSE, ["activity", "k_bucket"]),
    "semantic_value_dist": lambda s, d: rounded(A.semantic_value_dist(elog(s, d), L1_CREATE, ["accepted", "selected"])),
    "outcome_value_presence": lambda s, d: A.outcome_value_presence(
        elog(s, d), l1_cases(s, d), L1_CREATE, ["accepted", "selected"], OUTS),
    "outcome_value_pattern": lambda s, d: A.outcome_value_pattern(
        elog(s, d), l1_cases(s, d), L1_CREATE, ["accepted", "selected"], OUTS),
    "offer_multiplicity": lambda s, d: A.item_multiplicity(elog(s, d), L1_CREATE, ["accepted", "selected"]),
    "link_next_event": lambda s, d: _linked(l1_ordered(s, d)).drop("accepted", "selected"),
    "lifecycle_first_state": lambda s, d: A.lifecycle_first_state(l1_ordered(s, d), "item_id", L1_STATES),
    "later_state": lambda s, d: _later(s, d).select("case_id", "event_pos", *[f"later_{x}" for x in STATES]),
    "lifecycle_relationship": lambda s, d: rounded(_relationship(s, d)),
    "representative_traces": lambda s, d: A.representative_traces(
        elog(s, d), L1_CREATE, F.col("activity").isin([L1_CREATE, *STATES]), ["selected", "accepted"]
    ).select("case_id", "event_pos", "activity", "item_id", "accepted", "selected"),
    "context_only_confirm": lambda s, d: A.context_only_confirm(
        elog(s, d), l1_prefix(s, d), ["rating", "amount"], "click", L1_K),
    "identifier_audit": lambda s, d: rounded(A.identifier_audit(l1_prefix(s, d), ["order_key", "case_id"])),
    "case_frequency": lambda s, d: A.case_frequency(l1_prefix(s, d), l1_cases(s, d), L1_K),
    "availability_matrix": lambda s, d: rounded(_matrix(s, d).drop("reason", "notes", "model_handling")),
    "decision_counts": lambda s, d: A.decision_counts(_matrix(s, d).filter("availability_pct >= 0.5")),
    "feature_policy": _policy,
    "feature_manifest": lambda s, d: _with_measured(_matrix(s, d), lambda m: A.feature_manifest(
        A.feature_policy(m, HANDLING_POLICY)).select("feature", "source", "status")),
    # case features
    "static_features": lambda s, d: X.static_features(l1_prefix(s, d), FEATURES.statics, strict=True),
    "count_maps": lambda s, d: X.count_rows(X.count_maps(l1_prefix(s, d), FEATURES.count_maps), FEATURES.map_columns),
    "unique_counts": lambda s, d: X.unique_counts(l1_prefix(s, d), FEATURES.uniques),
    "timing_features": lambda s, d: rounded(
        _us(X.timing_features(l1_prefix(s, d)), "case_start_time"), GAP_DIGITS),
    "case_features": lambda s, d: rounded(_flat(case_features(s, d)), GAP_DIGITS),
    "feature_table_checks": _feature_checks,
    # split, windows, samples
    "temporal_split": lambda s, d: _split(s, d)[0].select("case_id", "split"),
    "split_summary": lambda s, d: rounded(_split_summary(s, d)),
    "temporal_windows": lambda s, d: _window_rows(s, d).select("case_id", "window", "temporal_order"),
    "window_summary": _window_summary,
    "window_boundaries": _window_bounds,
    "window_inherit": lambda s, d: T.window_inherit(
        _sample(s, d), _windows(s, d)[0].filter("window <> 'T3'"), "case_id").select("case_id", "sample_order", "window", "matched"),
    "seeded_sample": lambda s, d: _sample(s, d).select("case_id", "sample_order", "target"),
    "sample_distribution": _sample_distribution,
    "split_leakage": _leakage,
    # encoding
    "map_validate": lambda s, d: N.map_validate(case_features(s, d), FEATURES.map_columns, OUTS, L1_K),
    "namespaced_counts": lambda s, d: N.namespaced_counts(case_features(s, d), FEATURES.map_columns),
    "vocabulary_fit": lambda s, d: N.vocabulary_fit(split_features(s, d)[0], ENCODE),
    "unknown_audit": lambda s, d: N.unknown_audit(*split_features(s, d), ENCODE),
    "unknown_values": lambda s, d: N.unknown_values(*split_features(s, d), ENCODE),
    "one_hot": _one_hot,
    "scale_numeric": lambda s, d: rounded(N.scale_numeric(
        *split_features(s, d), ENCODE.numeric).select("case_id", *ENCODE.numeric)),
    "encode_linear": lambda s, d: rounded(_encoded(s, d, "linear", "test")[0]),
    "encode_tree": lambda s, d: rounded(_encoded(s, d, "tree", "test")[0], GAP_DIGITS),
    "matrix_stats": lambda s, d: rounded(N.matrix_stats(*_encoded(s, d, "tree", "train"))),
    "constant_features": lambda s, d: N.constant_features(*_encoded(s, d, "tree", "train")),
    "finite_check": _finite,
    # contracts
    "check_required_columns": _stored_columns,
    "check_not_null": lambda s, d: C.check_not_null(l1(s, d), ["case_id", "activity", "ts", "amount"]),
    "check_unique": lambda s, d: C.union_checks([
        C.check_unique(l1_cases(s, d), ["case_id"]), C.check_unique(l2(s, d), ["case_id", "ts"])]),
    "check_disjoint": _disjoint,
    "check_cover": _cover,
    "check_strict_time_order": _time_order,
    "check_domain": lambda s, d: C.union_checks([
        C.check_domain(l1_cases(s, d).filter("eligible"), "target", values=[0, 1]),
        _named(C.check_domain(l1_cases(s, d), "target", values=[1]), "all"),
        C.check_domain(l1(s, d), "value", low=0, high=100)]),
    "check_leakage": _leaks,
    "check_counts": _counts,
    "table_fingerprint": lambda s, d: C.table_fingerprint(
        l1_prefix(s, d), ["case_id", "event_pos", "activity", "resource", "item_id"]),
}


# --- SQL --------------------------------------------------------------------------------

def _verdict(counts: str) -> str:
    """Check rows from counted violations (c, x)."""
    return f"""SELECT c AS "check", CASE WHEN x = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(x AS VARCHAR) AS observed,
  '0' AS expected FROM ({counts})"""


def _union(parts) -> str:
    return "\nUNION ALL ".join(parts)


_SEEN = """, seen AS (SELECT f.feature, f.case_id, f.first_pos, f.vals, f.zero1 FROM ({parts}) f)"""


def _seen(attrs) -> str:
    parts = _union(
        f"""SELECT '{a}' AS feature, case_id, min(event_pos) FILTER ({a} IS NOT NULL) AS first_pos,
  count(DISTINCT {a}) AS vals,
  max(CASE WHEN event_pos = 1 AND TRY_CAST(CAST({a} AS VARCHAR) AS DOUBLE) = 0 THEN 1 ELSE 0 END) AS zero1
FROM elog GROUP BY case_id""" for a in attrs)
    return _SEEN.format(parts=parts)


_AVAIL = """SELECT feature, count(*) AS total_cases, count(first_pos) AS ever_available,
  count(*) FILTER (first_pos <= 3) AS available_by_k, {pct_by_k},
  median(first_pos) AS first_seen_median, max(first_pos) AS first_seen_max,
  count(*) FILTER (first_pos > 3) AS future_only, count(*) FILTER (first_pos IS NULL) AS never_observed,
  count(*) FILTER (vals > 1) AS multi_value_cases{extra}
FROM seen GROUP BY feature"""


def _completeness(attrs, tail: str = "") -> str:
    return _union(f"""SELECT '{a}' AS feature, count(*) AS total_prefix_rows, count({a}) AS non_null_prefix_rows,
  count(*) - count({a}) AS missing_prefix_rows, round(100.0 * count({a}) / count(*), 6) AS row_completeness_percentage,
  round(100.0 * (count(*) - count({a})) / count(*), 6) AS missing_rate,
  count(DISTINCT case_id) FILTER ({a} IS NOT NULL) AS cases_with_value,
  count(DISTINCT case_id) - count(DISTINCT case_id) FILTER ({a} IS NOT NULL) AS cases_with_no_value,
  round(100.0 * count(DISTINCT case_id) FILTER ({a} IS NOT NULL) / count(DISTINCT case_id), 6) AS case_coverage_percentage
FROM prefix""" for a in attrs)


_LINK = """, nxt AS (SELECT *, lead(activity) OVER w AS na, lead(item_id) OVER w AS ni FROM ord
  WINDOW w AS (PARTITION BY case_id ORDER BY event_pos)),
linked AS (SELECT case_id, event_pos, accepted, selected, CASE WHEN na = 'view' THEN ni END AS linked_item,
  na IS NOT DISTINCT FROM 'view' AND ni IS NOT NULL AS linked FROM nxt WHERE activity = 'purchase'),
states AS (SELECT case_id, item_id, min(event_pos) FILTER (activity = 'click') AS first_click,
  min(event_pos) FILTER (activity = 'view') AS first_view, min(event_pos) FILTER (activity = 'signup') AS first_signup
  FROM ord WHERE activity IN ('click','view','signup') AND item_id IS NOT NULL GROUP BY case_id, item_id),
later AS (SELECT l.*, coalesce(linked AND first_click > event_pos, false) AS later_click,
  coalesce(linked AND first_view > event_pos, false) AS later_view,
  coalesce(linked AND first_signup > event_pos, false) AS later_signup
  FROM linked l LEFT JOIN states s ON s.case_id = l.case_id AND s.item_id = l.linked_item)
"""


def _relation_sql(f: str) -> str:
    return f"""SELECT '{f}' AS feature, {f} AS value, count(*) AS create_rows, count(*) FILTER (linked) AS linked_rows,
  """ + ", ".join(f"""count(*) FILTER (later_{x}) AS later_{x},
  round(100.0 * count(*) FILTER (later_{x}) / count(*), 6) AS later_{x}_pct""" for x in STATES) + f"""
FROM later GROUP BY {f}"""


_DECISION_SQL = "(VALUES " + ", ".join(
    "('{feature}', '{practically_available}', '{future_dependency}', '{availability_decision}')".format(**r)
    for r in DECISIONS) + ") d(feature, practically_available, future_dependency, availability_decision)"
_HANDLING_SQL = """CASE WHEN availability_decision = 'Conditionally Available' THEN 'conditional_omitted'
  WHEN availability_decision = 'Leakage Risk' THEN 'leakage_risk_omitted' WHEN feature_group = 'case-level' THEN 'raw_static'
  WHEN feature_group = 'identifier' THEN 'identifier_only' WHEN m.feature = 'ts' THEN 'timing' ELSE 'count_map' END"""
_GROUPS = {"segment": "case-level", "credit_limit": "case-level", "activity": "event-process",
           "resource": "event-process", "ts": "event-process", "amount": "offer-sparse",
           "rating": "offer-sparse", "selected": "offer-sparse", "order_key": "identifier"}
_MATRIX = ", m AS (" + _union(
    f"""SELECT '{f}' AS feature, '{g}' AS feature_group,
  count(DISTINCT case_id) FILTER ({f} IS NOT NULL) AS availability_at_k,
  round(count(DISTINCT case_id) FILTER ({f} IS NOT NULL) / count(DISTINCT case_id), 6) AS availability_pct FROM prefix"""
    for f, g in _GROUPS.items()) + ")\n"

_FEATS = """,
feat AS (
  SELECT p.case_id, min(p.ts) AS case_start_time, max(c.target) AS target, arg_min(p.segment, event_pos) AS segment,
    arg_min(p.credit_limit, event_pos) AS credit_limit, count(DISTINCT p.activity) AS n_unique_activities,
    count(DISTINCT p.resource) AS n_unique_resources,
    (epoch_us(max(p.ts)) - epoch_us(min(p.ts))) / 1e6 AS prefix_duration_seconds,
    (epoch_us(max(p.ts)) - epoch_us(min(p.ts))) / 1e6 / 2 AS mean_event_gap_seconds
  FROM prefix p JOIN cases c USING (case_id) GROUP BY p.case_id),
counts AS (""" + _union(
    f"SELECT case_id, '{ns}' AS namespace, {src} AS key, count(*) AS count FROM prefix GROUP BY case_id, {src}"
    for src, ns in FEATURES.count_maps.items()) + """),
jsons AS (SELECT case_id, namespace,
  '{' || string_agg('"' || key || '":' || count, ',' ORDER BY key) || '}' AS j FROM counts GROUP BY case_id, namespace)"""

_NUM = ENCODE.numeric
_SPLIT_SQL = """,
starts AS (SELECT {start} AS st, count(*) AS n FROM {table} GROUP BY 1),
cum AS (SELECT st, sum(n) OVER (ORDER BY st) AS c, sum(n) OVER () AS total FROM starts),
cut AS (SELECT arg_min(st, abs(c - floor(total * 0.8)) * 1e9 + c) AS b,
  arg_min(c, abs(c - floor(total * 0.8)) * 1e9 + c) AS pos, max(floor(total * 0.8)) AS nominal FROM cum WHERE c < total)"""
_ENC = _FEATS + _SPLIT_SQL.format(start="case_start_time", table="feat") + """,
parts AS (SELECT f.*, CASE WHEN case_start_time <= (SELECT b FROM cut) THEN 'train' ELSE 'test' END AS split FROM feat f),
cells AS (""" + _union(
    [f"SELECT case_id, split, 'numeric' AS source_group, '{c}' AS feature_name, {i} AS block, CAST({c} AS DOUBLE) AS value FROM parts"
     for i, c in enumerate(_NUM)]
    + [f"SELECT case_id, split, 'categorical::segment', 'segment_' || segment, {len(_NUM)}, 1.0 FROM parts"]
    + [f"""SELECT case_id, split, 'structured_map::' || namespace, namespace || '::' || key, {len(_NUM) + 1},
  CAST(count AS DOUBLE) FROM counts JOIN parts USING (case_id)"""]) + """),
dict AS (SELECT row_number() OVER (ORDER BY block, feature_name, source_group) - 1 AS feature_index, feature_name, source_group
  FROM (SELECT DISTINCT block, feature_name, source_group FROM cells WHERE split = 'train'))
"""


def enc(body: str) -> str:
    return sql.l1(_ENC.rstrip() + body)


_STATS = ", st AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in _NUM
) + " FROM parts WHERE split = 'train')\n"

_L2S = """WITH """ + sql.L2_LOG + """,
pop AS (SELECT case_id, min(ts) AS case_start_time, CASE WHEN count(*) >= 10 THEN 1 ELSE 0 END AS target FROM log GROUP BY case_id)"""
_L2_SPLIT = _L2S + _SPLIT_SQL.format(start="case_start_time", table="pop") + """,
parts AS (SELECT *, CASE WHEN case_start_time <= (SELECT b FROM cut) THEN 'train' ELSE 'test' END AS split FROM pop)
"""
_L2_WIN = _L2S + """,
starts AS (SELECT case_start_time AS st, count(*) AS n FROM pop GROUP BY 1),
cum AS (SELECT st, CAST(sum(n) OVER (ORDER BY st) AS BIGINT) AS c, CAST(sum(n) OVER () AS BIGINT) AS total FROM starts),
cut AS (SELECT i, max(total * i // 3) AS nominal, arg_min(st, abs(c - total * i // 3) * 1000000000 + c) AS b,
  arg_min(c, abs(c - total * i // 3) * 1000000000 + c) AS pos FROM cum, (VALUES (1), (2)) v(i) WHERE c < total GROUP BY i),
win AS (SELECT *, CASE WHEN case_start_time <= (SELECT b FROM cut WHERE i = 1) THEN 'T1'
  WHEN case_start_time <= (SELECT b FROM cut WHERE i = 2) THEN 'T2' ELSE 'T3' END AS "window",
  row_number() OVER (ORDER BY case_start_time, case_id) - 1 AS temporal_order FROM pop),
samp AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || case_id), case_id) - 1 AS sample_order FROM win
  QUALIFY row_number() OVER (ORDER BY md5('42:' || case_id), case_id) <= 100)
"""
_L2_SAMPLES = _L2_SPLIT.rstrip() + """,
samp AS (SELECT *, CASE split WHEN 'train' THEN 'background' ELSE 'explained' END AS sample FROM parts
  QUALIFY row_number() OVER (PARTITION BY split ORDER BY md5('42:' || case_id), case_id) <= 100)
"""

SQL = {
    "case_attr_availability": sql.l1(_seen(L1_STATIC) + "\n" + _AVAIL.format(
        pct_by_k="round(100.0 * count(*) FILTER (first_pos <= 3) / count(*), 6) AS availability_percentage",
        extra=""", count(*) FILTER (first_pos IS NULL OR first_pos > 1) AS missing_at_event_1,
  count(*) FILTER (zero1 = 1) AS zero_at_event_1""")),
    "sparse_availability": sql.l1(_seen(L1_SPARSE) + "\n" + _AVAIL.format(
        pct_by_k="round(100.0 * count(*) FILTER (first_pos <= 3) / count(*), 6) AS available_by_k_pct",
        extra=""", min(first_pos) AS first_seen_min,
  round(100.0 * count(*) FILTER (first_pos > 3) / count(*), 6) AS future_only_pct,
  round(100.0 * count(*) FILTER (first_pos IS NULL) / count(*), 6) AS never_observed_pct""")),
    "first_seen_distribution": sql.l1(_seen(L1_SPARSE) + """
SELECT feature, first_pos AS first_seen_event, count(*) AS case_count FROM seen WHERE first_pos IS NOT NULL GROUP BY 1, 2"""),
    "event_completeness": sql.l1(_completeness(["activity", "resource", "rating", "item_id"])),
    "missing_by_position": sql.l1(_union(f"""SELECT '{a}' AS feature, event_pos, count(*) AS total, count({a}) AS non_missing,
  count(*) - count({a}) AS missing, round(100.0 * (count(*) - count({a})) / count(*), 6) AS missing_pct
FROM prefix GROUP BY event_pos""" for a in ("resource", "rating", "amount"))),
    "attr_context": sql.l1(_union(
        f"SELECT '{a}' AS attribute, '{c}' AS context, {c} AS context_value, count(*) AS row_count FROM elog WHERE {a} IS NOT NULL GROUP BY {c}"
        for a in L1_SPARSE for c in ("activity", "k_bucket"))),
    "semantic_value_dist": sql.l1(_union(f"""SELECT '{f}' AS feature, {f} AS value, count(*) AS row_count,
  round(100.0 * count(*) / (SELECT count(*) FROM elog WHERE activity = 'purchase'), 6) AS percentage
FROM elog WHERE activity = 'purchase' GROUP BY {f}""" for f in ("accepted", "selected"))),
    "outcome_value_presence": sql.l1(_union(f"""SELECT '{f}' AS feature, value,
  count(*) FILTER (outcome_activity = 'error_hi') AS error_hi, count(*) FILTER (outcome_activity = 'purchase_hi') AS purchase_hi,
  count(*) AS case_value_memberships
FROM (SELECT DISTINCT case_id, {f} AS value FROM elog WHERE activity = 'purchase') JOIN cases USING (case_id) GROUP BY value"""
                                            for f in ("accepted", "selected"))),
    "outcome_value_pattern": sql.l1(_union(f"""SELECT '{f}' AS feature, value_pattern,
  count(*) FILTER (outcome_activity = 'error_hi') AS error_hi, count(*) FILTER (outcome_activity = 'purchase_hi') AS purchase_hi,
  count(*) AS unique_cases
FROM (SELECT case_id, string_agg(DISTINCT {f}, ' | ' ORDER BY {f}) AS value_pattern FROM elog
  WHERE activity = 'purchase' GROUP BY case_id) JOIN cases USING (case_id) GROUP BY value_pattern"""
                                           for f in ("accepted", "selected"))),
    "offer_multiplicity": sql.l1(_union(f"""SELECT '{f}' AS feature, count(*) AS cases_with_create,
  count(*) FILTER (n > 1) AS cases_with_multiple_creates, count(*) FILTER (v > 1) AS cases_with_multiple_values,
  CAST(sum(v) AS BIGINT) AS case_value_memberships
FROM (SELECT count(*) AS n, count(DISTINCT {f}) AS v FROM elog WHERE activity = 'purchase' GROUP BY case_id)"""
                                        for f in ("accepted", "selected"))),
    "link_next_event": sql.l1(_LINK + "SELECT case_id, event_pos, linked_item, linked FROM linked"),
    "lifecycle_first_state": sql.l1(_LINK + "SELECT * FROM states"),
    "later_state": sql.l1(_LINK + "SELECT case_id, event_pos, later_click, later_view, later_signup FROM later"),
    "lifecycle_relationship": sql.l1(_LINK + _union([_relation_sql("accepted"), _relation_sql("selected")])),
    "representative_traces": sql.l1(""", pc AS (SELECT case_id,
  count(*) FILTER (activity IN ('purchase','click','view','signup')) AS size,
  count(*) FILTER (activity = 'purchase') AS n,
  count(DISTINCT selected) FILTER (activity = 'purchase') AS vs,
  count(DISTINCT accepted) FILTER (activity = 'purchase') AS va FROM elog GROUP BY case_id),
p0 AS (SELECT case_id FROM pc WHERE n > 1 ORDER BY size, case_id LIMIT 1),
p1 AS (SELECT case_id FROM pc WHERE vs > 1 AND case_id NOT IN (SELECT case_id FROM p0) ORDER BY size, case_id LIMIT 1),
p2 AS (SELECT case_id FROM pc WHERE va > 1 AND case_id NOT IN (SELECT case_id FROM p0 UNION ALL SELECT case_id FROM p1)
  ORDER BY size, case_id LIMIT 1)
SELECT case_id, event_pos, activity, item_id, accepted, selected FROM elog
WHERE activity IN ('purchase','click','view','signup') AND case_id IN
  (SELECT case_id FROM p0 UNION ALL SELECT case_id FROM p1 UNION ALL SELECT case_id FROM p2)"""),
    "context_only_confirm": sql.l1(_union(f"""SELECT '{a}' AS feature, count({a}) AS non_null_rows, 'click' AS activity,
  count(*) FILTER ({a} IS NOT NULL AND activity <> 'click') = 0 AS only_on_activity,
  count(*) FILTER ({a} IS NOT NULL AND ts IS NULL) = 0 AS timestamps_present,
  (SELECT count(*) FROM (SELECT case_id, event_pos, {a} FROM prefix EXCEPT SELECT case_id, event_pos, {a} FROM elog)) = 0
    AS prefix_matches_source FROM elog""" for a in ("rating", "amount"))),
    "identifier_audit": sql.l1(_union(f"""SELECT '{a}' AS feature, count(*) AS total_prefix_rows,
  count({a}) AS non_null_prefix_rows, count(*) - count({a}) AS missing_prefix_rows,
  round(100.0 * count({a}) / count(*), 6) AS row_completeness_percentage,
  count(DISTINCT case_id) AS cases_with_value, 100.0::DOUBLE AS case_coverage_percentage,
  count(DISTINCT {a}) AS distinct_values, count({a}) - count(DISTINCT {a}) AS duplicated_rows FROM prefix"""
                                      for a in ("order_key", "case_id"))),
    "case_frequency": sql.l1("""SELECT count(*) AS distinct_case_ids, min(n) AS minimum_rows_per_case,
  max(n) AS maximum_rows_per_case, (SELECT count(*) FROM cases WHERE eligible) AS eligible_cases,
  min(n) = 3 AND max(n) = 3 AND count(*) = (SELECT count(*) FROM cases WHERE eligible) AS every_case_occurs_k_times
FROM (SELECT count(*) AS n FROM prefix GROUP BY case_id)"""),
    "availability_matrix": sql.l1(_MATRIX + f"SELECT m.*, d.* EXCLUDE (feature) FROM m JOIN {_DECISION_SQL} ON d.feature = m.feature"),
    "decision_counts": sql.l1(_MATRIX + f"""SELECT availability_decision, count(*) AS features
FROM m JOIN {_DECISION_SQL} ON d.feature = m.feature WHERE availability_pct >= 0.5 GROUP BY availability_decision"""),
    "feature_policy": sql.l1(_MATRIX + f"""SELECT m.feature, {_HANDLING_SQL} AS handling, availability_at_k
FROM m JOIN {_DECISION_SQL} ON d.feature = m.feature"""),
    "feature_manifest": sql.l1(_MATRIX + f"""SELECT m.feature, feature_group AS source, availability_at_k,
  CASE WHEN h IN ('raw_static', 'count_map', 'timing') THEN 'included' WHEN h = 'identifier_only' THEN 'excluded_identifier'
  ELSE h END AS status
FROM (SELECT m.*, {_HANDLING_SQL} AS h FROM m JOIN {_DECISION_SQL} ON d.feature = m.feature) m"""),
    "static_features": sql.l1(_FEATS + "\nSELECT case_id, segment, credit_limit FROM feat"),
    "count_maps": sql.l1(_FEATS + "\nSELECT * FROM counts"),
    "unique_counts": sql.l1(_FEATS + "\nSELECT case_id, n_unique_activities, n_unique_resources FROM feat"),
    "timing_features": sql.l1(_FEATS + """
SELECT case_id, epoch_us(case_start_time) AS case_start_time, round(prefix_duration_seconds, 7) AS prefix_duration_seconds,
  round(mean_event_gap_seconds, 7) AS mean_event_gap_seconds FROM feat"""),
    "case_features": sql.l1(_FEATS + """
SELECT f.* REPLACE (epoch_us(case_start_time) AS case_start_time,
  round(prefix_duration_seconds, 7) AS prefix_duration_seconds, round(mean_event_gap_seconds, 7) AS mean_event_gap_seconds), """
                            + ", ".join(f"j_{ns}.j AS {ns}_counts" for ns in FEATURES.count_maps.values()) + " FROM feat f "
                            + " ".join(f"JOIN jsons j_{ns} ON j_{ns}.case_id = f.case_id AND j_{ns}.namespace = '{ns}'"
                                       for ns in FEATURES.count_maps.values())),
    "feature_table_checks": sql.l1(_FEATS + """, pred AS (SELECT f.* EXCLUDE (case_id, case_start_time, target), js.s FROM feat f
  JOIN (SELECT case_id, string_agg(namespace || j, '|' ORDER BY namespace) AS s FROM jsons GROUP BY case_id) js USING (case_id))
""" + _union(
        [f"""SELECT 'map_total:{m}' AS rule, count(*) AS rows_affected FROM (SELECT sum(count) AS t FROM counts
  WHERE namespace = '{ns}' GROUP BY case_id) WHERE t <> 3""" for m, ns in FEATURES.map_columns.items()]
        + [f"""SELECT 'outcome_key:{m}', count(DISTINCT case_id) FROM counts
  WHERE namespace = '{ns}' AND key IN ('purchase_hi','error_hi')""" for m, ns in FEATURES.map_columns.items()]
        + ["SELECT r, CAST(0 AS BIGINT) FROM (VALUES ('timing_mismatch'), ('negative_gap')) v(r)",
           "SELECT 'duplicate_case_id', count(*) - count(DISTINCT case_id) FROM feat",
           """SELECT 'duplicate_predictor_rows', (SELECT count(*) FROM pred) - count(*) FROM (SELECT DISTINCT * FROM pred)"""]
        + [f"SELECT 'constant:{c}', CAST(count(DISTINCT {c}) = 1 AS BIGINT) FROM feat"
           for c in ["segment", "credit_limit", *FEATURES.numeric_summary]]
        + [f"""SELECT 'constant:{m}', CAST(count(DISTINCT j) = 1 AS BIGINT) FROM jsons WHERE namespace = '{ns}'"""
           for m, ns in FEATURES.map_columns.items()])),
    "temporal_split": _L2_SPLIT + "SELECT case_id, split FROM parts",
    "split_summary": _L2_SPLIT.rstrip() + """,
x AS (SELECT count(*) AS total_cases, """ + ", ".join(f"""count(*) FILTER (split = '{p}') AS {p}_cases,
  epoch_us(min(case_start_time) FILTER (split = '{p}')) AS {p}_start, epoch_us(max(case_start_time) FILTER (split = '{p}')) AS {p}_end,
  count(*) FILTER (split = '{p}' AND target = 1) AS {p}_success, count(*) FILTER (split = '{p}' AND target = 0) AS {p}_unsuccessful"""
                                                      for p in ("train", "test")) + """ FROM parts)
SELECT x.*, 0.8::DOUBLE AS nominal_train_ratio, CAST(nominal AS BIGINT) AS nominal_split_index,
  CAST(pos AS BIGINT) AS actual_split_index, CAST(pos - nominal AS BIGINT) AS boundary_adjustment_cases,
  pos <> nominal AS timestamp_boundary_adjusted, round(train_cases / total_cases, 6) AS actual_train_percentage,
  round(train_success / train_cases, 6) AS train_success_rate, round(test_success / test_cases, 6) AS test_success_rate,
  round(test_success / test_cases - train_success / train_cases, 6) AS test_minus_train_success_rate,
  epoch_us(b) AS boundary_timestamp FROM x, cut""",
    "temporal_windows": _L2_WIN + 'SELECT case_id, "window", temporal_order FROM win',
    "window_summary": _L2_WIN + """SELECT "window", count(*) AS case_count, epoch_us(min(case_start_time)) AS start_time,
  epoch_us(max(case_start_time)) AS end_time, count(*) FILTER (target = 1) AS success_count,
  count(*) FILTER (target = 0) AS unsuccessful_count, min(temporal_order) AS first_temporal_order,
  max(temporal_order) AS last_temporal_order FROM win GROUP BY "window" """,
    "window_boundaries": _L2_WIN + """SELECT 'T' || i || '_T' || (i + 1) AS boundary, nominal AS nominal_position,
  pos AS actual_position, pos - nominal AS adjustment, epoch_us(b) AS time_before,
  (SELECT epoch_us(min(st)) FROM cum WHERE st > b) AS time_after, pos <> nominal AS adjusted FROM cut""",
    "window_inherit": _L2_WIN + """SELECT case_id, sample_order, CASE WHEN "window" <> 'T3' THEN "window" END AS "window",
  "window" <> 'T3' AS matched FROM samp""",
    "seeded_sample": _L2_WIN + "SELECT case_id, sample_order, target FROM samp",
    "sample_distribution": _L2_SAMPLES + """SELECT sample, count(*) AS case_count, count(*) FILTER (target = 1) AS success_count,
  count(*) FILTER (target = 0) AS unsuccessful_count, round(avg(target), 6) AS success_rate FROM samp GROUP BY sample""",
    "split_leakage": _L2_SAMPLES + """SELECT 'train&test' AS pair, CAST(0 AS BIGINT) AS overlap
UNION ALL SELECT 'train&background', count(*) FROM samp WHERE sample = 'background'
UNION ALL SELECT 'train&explained', count(*) FROM samp JOIN parts p USING (case_id) WHERE sample = 'explained' AND p.split = 'train'
UNION ALL SELECT 'test&background', count(*) FROM samp JOIN parts p USING (case_id) WHERE sample = 'background' AND p.split = 'test'
UNION ALL SELECT 'test&explained', count(*) FROM samp WHERE sample = 'explained'
UNION ALL SELECT 'background&explained', count(*) FROM samp a JOIN samp b USING (case_id) WHERE a.sample < b.sample""",
    "map_validate": sql.l1(_FEATS + "\n" + _union(
        f"""SELECT '{m}' AS "column", (SELECT count(DISTINCT case_id) FROM counts WHERE namespace = '{ns}' AND key = '') AS bad_keys,
  (SELECT count(DISTINCT case_id) FROM counts WHERE namespace = '{ns}' AND count < 0) AS bad_counts,
  (SELECT count(*) FROM (SELECT sum(count) AS t FROM counts WHERE namespace = '{ns}' GROUP BY case_id) WHERE t <> 3) AS bad_totals,
  (SELECT count(DISTINCT case_id) FROM counts WHERE namespace = '{ns}' AND key IN ('purchase_hi','error_hi')) AS outcome_keys"""
        for m, ns in FEATURES.map_columns.items())),
    "namespaced_counts": sql.l1(_FEATS + """
SELECT case_id, namespace || '::' || key AS feature_name, CAST(count AS DOUBLE) AS value FROM counts"""),
    "vocabulary_fit": enc("\nSELECT * FROM dict"),
    "unknown_audit": enc(""", un AS (SELECT c.* FROM cells c WHERE split = 'test' AND block >= """ + str(len(_NUM)) + """
  AND NOT EXISTS (SELECT 1 FROM dict d WHERE d.feature_name = c.feature_name AND d.source_group = c.source_group))
SELECT d.source_group, count(*) AS train_vocabulary_size,
  (SELECT count(DISTINCT feature_name) FROM un WHERE un.source_group = d.source_group) AS test_only_count,
  (SELECT count(DISTINCT case_id) FROM un WHERE un.source_group = d.source_group) AS test_rows_affected
FROM dict d WHERE source_group <> 'numeric' GROUP BY d.source_group"""),
    "unknown_values": enc("""
SELECT source_group, feature_name, count(DISTINCT case_id) AS test_rows FROM cells c
WHERE split = 'test' AND NOT EXISTS (SELECT 1 FROM dict d WHERE d.feature_name = c.feature_name AND d.source_group = c.source_group)
GROUP BY source_group, feature_name"""),
    "one_hot": enc("""
SELECT case_id, feature_index, value FROM cells JOIN dict USING (source_group, feature_name)
WHERE split = 'test' AND source_group = 'categorical::segment'"""),
    "scale_numeric": enc(_STATS + "SELECT case_id, " + ", ".join(
        f"round((CAST({c} AS DOUBLE) - m_{c}) / s_{c}, 6) AS {c}" for c in _NUM) + " FROM parts, st WHERE split = 'test'"),
    "encode_linear": enc(_STATS + "SELECT case_id, feature_index, round(CASE feature_name " + " ".join(
        f"WHEN '{c}' THEN (value - m_{c}) / s_{c}" for c in _NUM) + """ ELSE value END, 6) AS value
FROM cells JOIN dict USING (source_group, feature_name), st WHERE split = 'test'"""),
    "encode_tree": enc("""
SELECT case_id, feature_index, round(value, 7) AS value FROM cells JOIN dict USING (source_group, feature_name)
WHERE split = 'test' AND value <> 0"""),
    "matrix_stats": enc(""", z AS (SELECT (SELECT count(*) FROM parts WHERE split = 'train') AS rows, (SELECT count(*) FROM dict) AS columns,
  (SELECT count(*) FROM cells JOIN dict USING (source_group, feature_name) WHERE split = 'train' AND value <> 0) AS nonzero_entries)
SELECT *, round(nonzero_entries / (rows * columns), 6) AS density, round(1 - nonzero_entries / (rows * columns), 6) AS sparsity FROM z"""),
    "constant_features": enc(""", z AS (SELECT source_group, feature_name, count(*) AS nnz, min(value) AS lo, max(value) AS hi FROM cells
  WHERE split = 'train' AND value <> 0 GROUP BY 1, 2)
SELECT d.* FROM dict d LEFT JOIN z USING (source_group, feature_name)
WHERE nnz IS NULL OR (nnz = (SELECT count(*) FROM parts WHERE split = 'train') AND lo = hi)"""),
    "finite_check": enc(_STATS + """, x AS (SELECT case_id FROM cells JOIN dict USING (source_group, feature_name), st
  WHERE split = 'train' AND CASE feature_name """ + " ".join(f"WHEN '{c}' THEN (value - m_{c}) / s_{c}" for c in _NUM) + """ ELSE value END <> 0)
SELECT 'cells' AS "table", count(*) AS cells, CAST(0 AS BIGINT) AS nan_cells, CAST(0 AS BIGINT) AS infinite_cells FROM x
UNION ALL SELECT 'spoilt', count(*), count(*) FILTER (case_id % 5 = 0), count(*) FILTER (case_id % 5 <> 0 AND case_id % 7 = 0) FROM x"""),
    "check_required_columns": sql.l1("""SELECT * FROM (VALUES ('stored:required_columns', 'PASS', '', ''),
  ('missing:required_columns', 'FAIL', 'outcome', ''),
  ('order:exact_columns', 'FAIL', 'case_id,event_pos,activity', 'activity,case_id,event_pos')) v("check", status, observed, expected)
UNION ALL SELECT c || ':readable_rows', CASE WHEN n > 0 THEN 'PASS' ELSE 'FAIL' END, CAST(n AS VARCHAR), 'some'
FROM (VALUES ('stored'), ('missing'), ('order')) v(c), (SELECT count(*) AS n FROM prefix)"""),
    "check_not_null": sql.l1_log(_union(f"""SELECT 'not_null:{c}' AS "check",
  CASE WHEN count(*) FILTER ({c} IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
  CAST(count(*) FILTER ({c} IS NULL) AS VARCHAR) AS observed, '0' AS expected FROM log"""
                                        for c in ("case_id", "activity", "ts", "amount"))),
    "check_unique": sql.l1(_verdict("""SELECT 'unique:case_id' AS c, count(*) - count(DISTINCT case_id) AS x FROM cases
UNION ALL SELECT 'unique:case_id,ts', count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders)) FROM orders""")),
    "check_disjoint": _L2_SPLIT + _verdict("""SELECT 'disjoint:case_id' AS c, count(*) AS x FROM parts a JOIN parts b
  USING (case_id) WHERE a.split <> b.split
UNION ALL SELECT 'sixths:disjoint:case_id', count(*) FROM parts WHERE case_id % 6 = 0"""),
    "check_cover": _L2_SPLIT + _verdict("""SELECT 'cover:case_id' AS c, count(*) FILTER (split IS NULL) AS x FROM parts
UNION ALL SELECT 'gaps:cover:case_id', count(*) FROM parts
  WHERE CAST(case_id % 2 = 0 AS INT) + CAST(case_id % 3 = 0 AS INT) <> 1"""),
    "check_strict_time_order": _L2_WIN.rstrip() + """,
ends AS (SELECT "window" AS p, min(case_start_time) AS lo, max(case_start_time) AS hi FROM win GROUP BY 1
  UNION ALL SELECT CASE WHEN case_id % 2 = 0 THEN 'even' ELSE 'odd' END, min(case_start_time), max(case_start_time) FROM win GROUP BY 1),
tt AS (""" + _L2_SPLIT + """SELECT split AS p, min(case_start_time) AS lo, max(case_start_time) AS hi FROM parts GROUP BY 1),
every AS (SELECT * FROM ends UNION ALL SELECT * FROM tt)
SELECT 'time_order:' || a.p || '<' || b.p AS "check", CASE WHEN a.hi < b.lo THEN 'PASS' ELSE 'FAIL' END AS status,
  CAST(a.hi < b.lo AS VARCHAR) AS observed, 'true' AS expected
FROM (VALUES ('train', 'test'), ('T1', 'T2'), ('T2', 'T3'), ('even', 'odd')) v(x, y)
JOIN every a ON a.p = v.x JOIN every b ON b.p = v.y""",
    "check_domain": sql.l1(_verdict("""SELECT 'domain:target' AS c, count(*) FILTER (target IS NULL OR target NOT IN (0, 1)) AS x FROM cases WHERE eligible
UNION ALL SELECT 'all:domain:target', count(*) FILTER (target IS NULL OR target <> 1) FROM cases
UNION ALL SELECT 'domain:value', count(*) FILTER (value IS NULL OR value < 0 OR value > 100) FROM events""")),
    "check_leakage": sql.l1(_verdict("""SELECT 'no_outcome_in_prefix' AS c, count(*) FILTER (activity IN ('purchase_hi', 'error_hi')) AS x FROM prefix
UNION ALL SELECT 'no_future_event', count(*) FILTER (event_pos > 3) FROM prefix
UNION ALL SELECT 'forbidden_columns_absent', 0
UNION ALL SELECT 'stricter:no_outcome_in_prefix', count(*) FILTER (activity = 'view') FROM prefix
UNION ALL SELECT 'stricter:no_future_event', count(*) FILTER (event_pos > 2) FROM prefix
UNION ALL SELECT 'stricter:forbidden_columns_absent', 1""")),
    "check_counts": sql.l1("""SELECT 'count:' || c AS "check", CASE WHEN x = e THEN 'PASS' ELSE 'FAIL' END AS status,
  CAST(x AS VARCHAR) AS observed, CAST(e AS VARCHAR) AS expected FROM (
  SELECT 'rows_per_case' AS c, max(n) AS x, 3 AS e FROM (SELECT count(*) AS n FROM prefix GROUP BY case_id)
  UNION ALL SELECT 'short_cases', count(*) FILTER (n < 3), 0 FROM (SELECT count(*) AS n FROM prefix GROUP BY case_id)
  UNION ALL SELECT 'views', count(*) FILTER (activity = 'view'), 0 FROM prefix
  UNION ALL SELECT 'rows', count(*), -1 FROM prefix)"""),
    "table_fingerprint": sql.l1(""", r AS (SELECT md5(concat_ws('|', """ + ", ".join(
        f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || {c}, 'n')" for c in ("case_id", "event_pos", "activity", "resource", "item_id"))
    + """)) AS d FROM prefix)
SELECT count(*) AS row_count, CAST(sum(CAST('0x' || d[1:8] AS BIGINT)) AS VARCHAR) AS hash_a,
  CAST(sum(CAST('0x' || d[9:16] AS BIGINT)) AS VARCHAR) AS hash_b FROM r"""),
}
