"""Profiling and population queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions.columns import micros, rounded
from tracewell.operators import contracts as C
from tracewell.operators import population as P
from tracewell.operators import profile as E
from tracewell.operators.order import core_columns, order_events
from tracewell.plans import sql
from tracewell.plans.tables import (
    L1_K, L1_OUTCOMES, L1_SPARSE, L1_SPEC, L2_STATIC, PRIORITY_GROUPS, flags, l1, l1_cases, l1_ordered,
    l1_prefix, l2, table,
)
from tracewell.sources.logs import normalization_summary, write_checked
from tracewell.sources.xes import read_xes, write_xes
from tracewell.session import cut_lineage, scratch_path

OUTS = L1_OUTCOMES.activities
L1_COLS = ["case_id", "activity", "ts", "order_key", *L1_SPEC.static_cols, *L1_SPEC.event_cols]
L2_COLS = ["case_id", "activity", "ts", "order_key", "c_mktsegment", "c_acctbal", "o_orderpriority", "o_totalprice"]
CORE = ["case_id", "activity", "ts"]
BY_VALUE = ["event_type", "resource", "accepted", "selected", "item_id"]


def _us(df, *cols):
    return df.withColumns({c: micros(F.col(c)) for c in cols})


def _ordered_once(s, d):
    """The core columns in order, checkpointed: labels and events come from one ordering."""
    return cut_lineage(order_events(core_columns(l1(s, d))))


def _l2_cases(s, d):
    return E.case_table(l2(s, d), L2_STATIC)


def _dup_rows(s, d):
    # Exact copies arise from projecting the log to its descriptive columns.
    df = l2(s, d).select("case_id", "activity", "o_orderpriority")
    return E.duplicate_count(df, df.columns)


def _reconcile(s, d):
    log = cut_lineage(l2(s, d))
    cases = cut_lineage(E.case_table(log, L2_STATIC))
    n = F.count(F.lit(1))
    return C.union_checks([
        C.check_equal_total(E.value_distribution(cases, "c_mktsegment"), "segment_total",
                            F.sum("case_count"), cases, n),
        C.check_equal_total(E.activity_frequency(log), "activity_total", F.sum("event_count"), log, n),
        C.check_equal_total(E.activity_group(log, "o_orderpriority", "^([0-9])-", PRIORITY_GROUPS),
                            "group_total", F.sum("event_count"), log, n),
        C.check_equal_total(E.trace_lengths(log), "trace_event_total", F.sum("event_count"), log, n),
        C.check_equal_total(E.trace_lengths(log), "trace_case_total", n, log, F.count_distinct("case_id")),
    ])


def _write_checked(s, d):
    cases = P.eligible_cases(l1_cases(s, d)).select("case_id", "n_events", "outcome_activity", "target")
    out = []
    for fmt in ("parquet", "csv"):
        checks = write_checked(cases, scratch_path(s, f"eligible-{fmt}"), ["case_id"], fmt)
        out.append(checks.withColumn("check", F.concat(F.lit(f"{fmt}:"), "check")))
    # every case twice: the key check has to count them
    twice = write_checked(cases.unionByName(cases), scratch_path(s, "eligible-twice"), ["case_id"])
    out.append(twice.withColumn("check", F.concat(F.lit("twice:"), "check")))
    return C.union_checks(out).filter("check not like '%exact_columns'").select("check", "status", "observed")


def _xes(s, d):
    path = scratch_path(s, "log-xes")
    # microseconds, and characters that XML has to escape
    log = l1_ordered(s, d).withColumn("ts", F.col("ts") + F.expr("make_dt_interval(0, 0, 0, (order_key % 1000) / 1000000)"))
    log = log.withColumn("note", F.concat(F.lit("<a&\"b\">\n\t"), "resource"))
    write_xes(log, path, ["event_type", "resource", "note"], ["segment"])
    log = read_xes(s, path, {"segment": "string"},
                   {"event_type": "string", "resource": "string", "note": "string", "order_key": "int"})
    return _us(log.select(F.col("case_id").cast("long").alias("case_id"), "activity", "ts", "order_key",
                          "segment", "event_type", "resource", "note"), "ts")


QUERIES = {
    # sources
    "log_normalize": lambda s, d: normalization_summary(l1(s, d)),
    "xes_ingest": _xes,
    "write_checked": _write_checked,
    # shape
    "schema_overview": lambda s, d: E.schema_overview(l1(s, d)).drop("data_type"),
    "first_rows": lambda s, d: E.first_rows(l1(s, d).select("case_id", "activity", "order_key", "value")),
    "log_overview": lambda s, d: _us(E.log_overview(l1(s, d)), "start_time", "end_time"),
    "distinct_activities": lambda s, d: E.distinct_activities(l1(s, d)),
    "column_cardinality": lambda s, d: E.column_cardinality(l2(s, d), [c for c in L2_COLS if c != "ts"]),
    "missing_summary": lambda s, d: rounded(E.missing_summary(l1(s, d), L1_COLS)),
    "critical_nulls": lambda s, d: E.missing_summary(l1(s, d), CORE).select("column", "missing_count"),
    "case_attr_missing": lambda s, d: E.missing_summary(l2(s, d), L2_STATIC).select("column", "missing_count"),
    "categorical_profile": lambda s, d: E.categorical_profile(l1(s, d), BY_VALUE),
    "attribute_location": lambda s, d: E.attribute_location(l1(s, d), L1_SPARSE),
    # duplicates
    "dup_event_id": lambda s, d: E.duplicate_count(l2(s, d), ["order_key"]).select("extra_rows"),
    "dup_rows": lambda s, d: _dup_rows(s, d).select("extra_rows"),
    "dup_event_key": lambda s, d: E.duplicate_count(l2(s, d), ["case_id", "activity", "ts"]),
    "dup_event_key_sample": lambda s, d: _us(E.duplicate_members(
        l2(s, d).select("case_id", "activity", "ts", "order_key", "o_orderpriority"),
        ["case_id", "activity", "ts"], ["case_id", "ts", "activity", "order_key"]), "ts"),
    "same_case_ts": lambda s, d: E.duplicate_count(l2(s, d), ["case_id", "ts"]),
    # case attributes
    "case_attr_consistency": lambda s, d: E.case_attr_consistency(
        l2(s, d), [*L2_STATIC, "o_orderpriority"]),
    "case_table": _l2_cases,
    "value_distribution": lambda s, d: rounded(E.value_distribution(_l2_cases(s, d), "c_mktsegment")),
    "distribution_reconcile": _reconcile,
    "numeric_summary": lambda s, d: rounded(E.numeric_summary(_l2_cases(s, d), "c_acctbal")),
    "numeric_percentiles": lambda s, d: rounded(E.numeric_percentiles(
        _l2_cases(s, d), "c_acctbal", [0.50, 0.75, 0.90, 0.95, 0.99, 0.995])),
    "iqr_outliers": lambda s, d: rounded(E.iqr_outliers(table(s, d, "events"), "value")),
    "top_n_cases": lambda s, d: E.top_n_cases(_l2_cases(s, d), "c_acctbal"),
    "zero_value_check": lambda s, d: rounded(E.zero_value_check(
        E.case_table(l1(s, d), ["segment", "credit_limit"]), "credit_limit", ["segment"])),
    "negative_value_check": lambda s, d: E.negative_value_check(_l2_cases(s, d), "c_acctbal"),
    "amount_by_category": lambda s, d: rounded(E.amount_by_category(
        _l2_cases(s, d), "c_mktsegment", "c_acctbal")),
    "histogram_bins": lambda s, d: rounded(E.histogram(table(s, d, "events"), "value", 50)),
    "histogram_bins_p99": lambda s, d: rounded(E.histogram_up_to(table(s, d, "events"), "value", 40, 0.99)),
    "boxplot_stats": lambda s, d: rounded(E.boxplot_stats(table(s, d, "events"), "value")),
    # activities and traces
    "activity_frequency": lambda s, d: rounded(E.activity_frequency(l1(s, d))),
    "activity_group": lambda s, d: rounded(E.activity_group(
        l2(s, d), "o_orderpriority", "^([0-9])-", PRIORITY_GROUPS)),
    "trace_length": lambda s, d: rounded(E.numeric_summary(E.trace_lengths(l2(s, d)), "event_count")),
    "trace_length_percentiles": lambda s, d: rounded(E.numeric_percentiles(
        E.trace_lengths(l2(s, d)), "event_count", [0.50, 0.75, 0.90, 0.95, 0.99])),
    "longest_cases": lambda s, d: E.longest_cases(l2(s, d)),
    # outcomes
    "target_presence": lambda s, d: E.target_presence(l1(s, d), OUTS),
    "target_distribution": lambda s, d: rounded(E.target_distribution(l1(s, d), OUTS)),
    "unresolved_last_state": lambda s, d: E.unresolved_last_state(l1(s, d), OUTS, "s"),
    # population
    "order_events": lambda s, d: order_events(l2(s, d)).select("case_id", "order_key", "event_pos"),
    "case_outcomes": lambda s, d: _us(P.case_outcomes(l1_ordered(s, d), L1_OUTCOMES).drop("target"),
                                      "case_start_time"),
    "contradictory_outcomes": lambda s, d: P.contradictory_outcomes(l1(s, d), L1_OUTCOMES),
    "target_mapping": lambda s, d: P.target_mapping(
        P.case_outcomes(l1_ordered(s, d), L1_OUTCOMES).filter("valid_target").drop("target"),
        L1_OUTCOMES).select("case_id", "outcome_activity", "target"),
    "eligibility": lambda s, d: l1_cases(s, d).select(
        "case_id", "valid_target", "has_k_events", "outcome_after_k", "eligible"),
    "eligibility_funnel": lambda s, d: P.eligibility_funnel(l1_cases(s, d), L1_K),
    "safe_prefix": lambda s, d: l1_prefix(s, d).select("case_id", "event_pos", "order_key", "activity", "value"),
    "future_suffix": lambda s, d: (lambda ordered: P.future_suffix(ordered, flags(ordered), L1_K).select(
        "case_id", "event_pos", "order_key", "activity"))(_ordered_once(s, d)),
    "prefix_summary": lambda s, d: (lambda ordered: P.prefix_summary(ordered, flags(ordered), L1_OUTCOMES, L1_K))(
        _ordered_once(s, d)),
    "eligible_cases": lambda s, d: _us(P.eligible_cases(l1_cases(s, d)), "case_start_time"),
}


def _cardinality_sql() -> str:
    cols = [c for c in L2_COLS if c != "ts"]
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values FROM log" for c in cols)


def _missing_sql(cols, percent: bool = True) -> str:
    pct = ", round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 6) AS missing_percent" if percent else ""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing_count" + pct.format(c=c) + " FROM log"
        for c in cols)


def _hist_sql(bins: int, where: str) -> str:
    return f"""WITH b AS (SELECT value FROM events {where}),
m AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / {bins}.0 AS w FROM b),
c AS (SELECT least(CAST(floor((value - lo) / w) AS BIGINT), {bins - 1}) AS bin, count(*) AS n FROM b, m GROUP BY 1)
SELECT r.bin AS bin, round(lo + r.bin * w, 6) AS left_edge, round(lo + (r.bin + 1) * w, 6) AS right_edge,
  coalesce(c.n, 0) AS case_count
FROM (SELECT CAST(range AS BIGINT) AS bin FROM range({bins})) r CROSS JOIN m LEFT JOIN c ON c.bin = r.bin"""


def _summary_sql(src: str, col: str) -> str:
    return f"""SELECT count({col}) AS count, round(avg({col}), 6) AS mean, round(stddev_samp({col}), 6) AS std,
  round(CAST(min({col}) AS DOUBLE), 6) AS min, round(CAST(max({col}) AS DOUBLE), 6) AS max,
  round(skewness({col}), 6) AS skewness,
  round(quantile_cont({col}, 0.25), 6) AS q25, round(quantile_cont({col}, 0.5), 6) AS median,
  round(quantile_cont({col}, 0.75), 6) AS q75 FROM {src}"""


def _percentiles_sql(src: str, col: str, probs) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({p} AS DOUBLE) AS probability, round(quantile_cont({col}, {p}), 6) AS value FROM {src}"
        for p in probs)


_FENCES = """WITH q AS (SELECT quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q75 FROM events),
f AS (SELECT *, q75 - q25 AS iqr, q25 - 1.5 * (q75 - q25) AS lower_bound, q75 + 1.5 * (q75 - q25) AS upper_bound FROM q)
"""
_O = "('purchase_hi','error_hi')"

SQL = {
    "log_normalize": sql.l1_log("""SELECT count(*) AS events, count(*) FILTER (case_id IS NULL) AS null_case_id,
  count(*) FILTER (activity IS NULL) AS null_activity, count(*) FILTER (ts IS NULL) AS null_ts FROM log"""),
    "xes_ingest": sql.l1_log("""SELECT case_id, activity, epoch_us(ts) + order_key % 1000 AS ts, order_key, segment,
  event_type, resource, '<a&"b">' || chr(10) || chr(9) || resource AS note FROM log"""),
    "write_checked": sql.l1("""SELECT f || ':' || c AS "check", CASE WHEN x = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
  CAST(x AS VARCHAR) AS observed FROM (
  SELECT f, 'same_keys' AS c, CAST(0 AS BIGINT) AS x FROM (VALUES ('parquet'), ('csv'), ('twice')) a(f)
  UNION ALL SELECT f, 'unique:case_id', (SELECT count(*) * n - count(DISTINCT case_id) FROM cases WHERE eligible)
  FROM (VALUES ('parquet', 1), ('csv', 1), ('twice', 2)) a(f, n))"""),
    "schema_overview": sql.l1_log("SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{c}')" for i, c in enumerate(L1_COLS)) +
        ") v(position, \"column\"), (SELECT count(*) AS row_count FROM log)"),
    "first_rows": sql.l1_log("SELECT case_id, activity, order_key, value FROM log ORDER BY order_key LIMIT 5"),
    "log_overview": sql.l1_log("""SELECT count(*) AS events, count(DISTINCT case_id) AS cases,
  count(DISTINCT activity) AS activities, epoch_us(min(ts)) AS start_time, epoch_us(max(ts)) AS end_time FROM log"""),
    "distinct_activities": sql.l1_log("SELECT DISTINCT activity FROM log WHERE activity IS NOT NULL"),
    "column_cardinality": sql.l2(_cardinality_sql()),
    "missing_summary": sql.l1_log(_missing_sql(L1_COLS)),
    "critical_nulls": sql.l1_log(_missing_sql(CORE, False)),
    "case_attr_missing": sql.l2(_missing_sql(L2_STATIC, False)),
    "categorical_profile": sql.l1_log(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS row_count FROM log GROUP BY {c}" for c in BY_VALUE)),
    "attribute_location": sql.l1_log(" UNION ALL ".join(
        f"SELECT activity, '{c}' AS attribute, count(*) AS row_count FROM log WHERE {c} IS NOT NULL GROUP BY activity"
        for c in L1_SPARSE)),
    "dup_event_id": sql.l2("SELECT count(*) - count(DISTINCT order_key) AS extra_rows FROM log"),
    "dup_rows": sql.l2("""SELECT CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM
  (SELECT count(*) AS n FROM log GROUP BY case_id, activity, o_orderpriority)"""),
    "dup_event_key": sql.l2("""SELECT CAST(sum(n - 1) AS BIGINT) AS extra_rows,
  CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_involved
FROM (SELECT count(*) AS n FROM log GROUP BY case_id, activity, ts)"""),
    "dup_event_key_sample": sql.l2("""SELECT case_id, activity, epoch_us(ts) AS ts, order_key, o_orderpriority FROM
  (SELECT *, count(*) OVER (PARTITION BY case_id, activity, ts) AS n FROM log) WHERE n > 1
ORDER BY case_id, ts, activity, order_key LIMIT 20"""),
    "same_case_ts": sql.l2("""SELECT CAST(sum(n - 1) AS BIGINT) AS extra_rows,
  CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_involved
FROM (SELECT count(*) AS n FROM log GROUP BY case_id, ts)"""),
    "case_attr_consistency": sql.l2(" UNION ALL ".join(
        f"""SELECT '{c}' AS attribute, count(*) FILTER (n > 1) AS inconsistent_cases FROM
  (SELECT count(DISTINCT {c}) + max(CAST({c} IS NULL AS INT)) AS n FROM log GROUP BY case_id)"""
        for c in [*L2_STATIC, "o_orderpriority"])),
    "case_table": sql.l2("SELECT case_id, c_mktsegment, c_acctbal FROM cases"),
    "value_distribution": sql.l2("""SELECT c_mktsegment, count(*) AS case_count,
  round(100.0 * count(*) / (SELECT count(*) FROM cases), 6) AS percent FROM cases GROUP BY c_mktsegment"""),
    "distribution_reconcile": sql.l2("""SELECT 'segment_total' AS "check", 'PASS' AS status,
  CAST(count(*) AS VARCHAR) AS observed, CAST(count(*) AS VARCHAR) AS expected FROM cases
UNION ALL SELECT 'trace_case_total', 'PASS', CAST(count(*) AS VARCHAR), CAST(count(*) AS VARCHAR) FROM cases
UNION ALL SELECT n, 'PASS', CAST(c AS VARCHAR), CAST(c AS VARCHAR) FROM (SELECT count(*) AS c FROM log),
  (VALUES ('activity_total'), ('group_total'), ('trace_event_total')) v(n)"""),
    "numeric_summary": sql.l2(_summary_sql("cases", "c_acctbal")),
    "numeric_percentiles": sql.l2(_percentiles_sql("cases", "c_acctbal", [0.50, 0.75, 0.90, 0.95, 0.99, 0.995])),
    "iqr_outliers": _FENCES + """SELECT round(q25, 6) AS q25, round(q75, 6) AS q75, round(iqr, 6) AS iqr,
  round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound,
  (SELECT count(*) FROM events, f WHERE value < lower_bound OR value > upper_bound) AS outlier_count,
  round(100.0 * (SELECT count(*) FROM events, f WHERE value < lower_bound OR value > upper_bound)
    / (SELECT count(*) FROM events), 6) AS outlier_percent FROM f""",
    "top_n_cases": sql.l2("SELECT case_id, c_mktsegment, c_acctbal FROM cases ORDER BY c_acctbal DESC, case_id LIMIT 10"),
    "zero_value_check": sql.l1_log("""
, ct AS (SELECT case_id, arg_min(segment, order_key) AS segment, arg_min(credit_limit, order_key) AS a FROM log GROUP BY 1),
t AS (SELECT count(*) AS n FROM ct)
SELECT '(all)' AS dimension, '(all)' AS value, count(*) FILTER (a = 0) AS zero_cases,
  round(100.0 * count(*) FILTER (a = 0) / (SELECT n FROM t), 6) AS percent_of_cases FROM ct
UNION ALL SELECT 'segment', segment, count(*), round(100.0 * count(*) / (SELECT n FROM t), 6)
FROM ct WHERE a = 0 GROUP BY segment""".lstrip()),
    "negative_value_check": sql.l2("SELECT count(*) FILTER (c_acctbal < 0) AS negative_cases FROM cases"),
    "amount_by_category": sql.l2("""SELECT c_mktsegment, count(c_acctbal) AS count, round(avg(c_acctbal), 6) AS mean,
  round(min(c_acctbal), 6) AS min, round(max(c_acctbal), 6) AS max, round(median(c_acctbal), 6) AS median
FROM cases GROUP BY c_mktsegment"""),
    "histogram_bins": _hist_sql(50, ""),
    "histogram_bins_p99": _hist_sql(40, "WHERE value <= (SELECT quantile_cont(value, 0.99) FROM events)"),
    "boxplot_stats": _FENCES + """SELECT round(median, 6) AS median, round(q25, 6) AS q25, round(q75, 6) AS q75,
  round((SELECT min(value) FROM events, f WHERE value BETWEEN lower_bound AND upper_bound), 6) AS whisker_low,
  round((SELECT max(value) FROM events, f WHERE value BETWEEN lower_bound AND upper_bound), 6) AS whisker_high,
  (SELECT count(*) FROM events, f WHERE value < lower_bound OR value > upper_bound) AS fliers FROM f""",
    "activity_frequency": sql.l1_log("""SELECT activity, count(*) AS event_count,
  round(100.0 * count(*) / (SELECT count(*) FROM log), 6) AS percent FROM log GROUP BY activity"""),
    "activity_group": sql.l2("""SELECT CASE regexp_extract(o_orderpriority, '^([0-9])-', 1)
    WHEN '1' THEN 'Urgent' WHEN '2' THEN 'High' WHEN '3' THEN 'Medium' ELSE '(ungrouped)' END AS activity_group,
  count(*) AS event_count, round(100.0 * count(*) / (SELECT count(*) FROM log), 6) AS percent FROM log GROUP BY 1"""),
    "trace_length": sql.l2(_summary_sql("(SELECT count(*) AS n FROM log GROUP BY case_id)", "n")),
    "trace_length_percentiles": sql.l2(_percentiles_sql(
        "(SELECT count(*) AS n FROM log GROUP BY case_id)", "n", [0.50, 0.75, 0.90, 0.95, 0.99])),
    "longest_cases": sql.l2("""SELECT case_id, count(*) AS event_count FROM log GROUP BY case_id
ORDER BY event_count DESC, case_id LIMIT 10"""),
    "target_presence": sql.l1("""SELECT count(*) FILTER (distinct_outcome_count = 0) AS cases_with_no_target,
  count(*) FILTER (distinct_outcome_count = 1) AS cases_with_one_target,
  count(*) FILTER (distinct_outcome_count > 1) AS cases_with_multiple_targets FROM cases"""),
    "target_distribution": sql.l1_log(f""", t AS (SELECT activity AS target, count(DISTINCT case_id) AS case_count
  FROM log WHERE activity IN {_O} GROUP BY activity)
SELECT target, case_count, round(100.0 * case_count / (SELECT sum(case_count) FROM t), 6) AS percent FROM t"""),
    "unresolved_last_state": sql.l1("""SELECT last_activity, count(*) AS case_count FROM (
  SELECT o.case_id, arg_max(o.activity, o.event_pos) AS last_activity FROM ord o JOIN cases c USING (case_id)
  WHERE c.outcome_event_count = 0 AND starts_with(o.activity, 's') GROUP BY o.case_id) GROUP BY last_activity"""),
    "order_events": sql.l2("""SELECT case_id, order_key,
  row_number() OVER (PARTITION BY case_id ORDER BY ts, order_key) AS event_pos FROM log"""),
    "case_outcomes": sql.l1("""SELECT case_id, epoch_us(case_start_time) AS case_start_time, n_events,
  outcome_event_count, distinct_outcome_count, outcome_activity, outcome_position, valid_target FROM cases"""),
    "contradictory_outcomes": sql.l1("""SELECT case_id, 'error_hi | purchase_hi' AS labels FROM cases
WHERE distinct_outcome_count > 1"""),
    "target_mapping": sql.l1("SELECT case_id, outcome_activity, target FROM cases WHERE valid_target"),
    "eligibility": sql.l1("SELECT case_id, valid_target, has_k_events, outcome_after_k, eligible FROM cases"),
    "eligibility_funnel": sql.l1("""SELECT CAST(3 AS BIGINT) AS prediction_point, count(*) AS total_cases,
  count(*) FILTER (valid_target) AS valid_target_cases, count(*) FILTER (NOT valid_target) AS unresolved_cases,
  count(*) FILTER (NOT has_k_events) AS cases_lt_k_events,
  count(*) FILTER (outcome_position <= 3) AS outcome_at_or_before_k,
  count(*) FILTER (eligible) AS eligible_cases,
  count(*) FILTER (eligible AND target = 1) AS eligible_success,
  count(*) FILTER (eligible AND target = 0) AS eligible_unsuccessful,
  count(*) FILTER (outcome_event_count = 0) AS no_outcome_cases,
  count(*) FILTER (distinct_outcome_count > 1) AS ambiguous_cases,
  count(*) FILTER (valid_target AND outcome_event_count > 1) AS repeated_same_outcome,
  count(*) FILTER (valid_target AND NOT has_k_events) AS excluded_short,
  count(*) FILTER (has_k_events AND outcome_position <= 3) AS excluded_early_outcome FROM cases"""),
    "safe_prefix": sql.l1("SELECT case_id, event_pos, order_key, activity, value FROM prefix"),
    "future_suffix": sql.l1("SELECT case_id, event_pos, order_key, activity FROM elog WHERE event_pos > 3"),
    "prefix_summary": sql.l1(f"""SELECT CAST(3 AS BIGINT) AS prediction_point, count(*) AS total_cases,
  count(*) FILTER (outcome_event_count > 0) AS cases_with_outcome,
  count(*) FILTER (distinct_outcome_count = 1) AS cases_with_one_distinct_outcome,
  count(*) FILTER (distinct_outcome_count > 1) AS cases_with_ambiguous_outcome,
  count(*) FILTER (outcome_event_count > distinct_outcome_count) AS cases_with_repeated_outcome_events,
  count(*) FILTER (outcome_event_count = 0) AS cases_without_outcome,
  count(*) FILTER (outcome_position <= 3) AS cases_with_outcome_by_k,
  count(*) FILTER (eligible) AS eligible_cases,
  (SELECT count(*) FROM prefix) AS prefix_rows,
  (SELECT count(*) FROM elog WHERE event_pos > 3) AS future_rows,
  (SELECT count(*) FROM prefix WHERE activity IN {_O}) AS outcome_inside_prefix FROM cases"""),
    "eligible_cases": sql.l1("""SELECT case_id, epoch_us(case_start_time) AS case_start_time, n_events, outcome_activity,
  outcome_position, target FROM cases WHERE eligible"""),
}
