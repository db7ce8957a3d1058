"""Streaming prefixes, linear attribution, and the operators beyond the reference's own steps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import micros, rounded
from tracewell.operators import cube as CU
from tracewell.operators import difference as DF
from tracewell.operators import encode as N
from tracewell.operators import exact_forest as X
from tracewell.operators import linear_attribution as LA
from tracewell.operators import models as K
from tracewell.operators import redundancy as RD
from tracewell.operators import sketches as SK
from tracewell.operators import temporal_join as TJ
from tracewell.operators import uncertainty as U
from tracewell.plans import model_queries as M
from tracewell.plans import sql
from tracewell.plans.feature_queries import ENCODE, FEATURES, GAP_DIGITS, _NUM, _STATS, _encoded, enc
from tracewell.plans.tables import L1_K, WINDOWS, l1, table
from tracewell.session import cut_lineage, scratch_path
from tracewell.spec import ACTIVITY, CASE, ORDER_KEY, TS
from tracewell.streaming.prefixes import run_available, stream_features

# --- streaming prefixes -----------------------------------------------------------------------

FILES = 6
WATERMARK = "1 day"


def _arrivals(s, d) -> tuple[str, str]:
    """The events as FILES files of successive times, each event up to half the watermark after its time; every
    tenth event arrives twice. Returns the folder and the schema."""
    log = l1(s, d).select(CASE, ACTIVITY, TS, ORDER_KEY, "segment", "credit_limit", "event_type", "resource", "k_bucket")
    path, us = scratch_path(s, "arrivals"), micros(F.col(TS))
    delay = F.pmod(F.xxhash64(ORDER_KEY), F.lit(12 * 3600)) * 1_000_000
    arrival = log.withColumn("__at", us + delay)
    again = arrival.filter(F.col(ORDER_KEY) % 10 == 0).withColumn("__at", F.col("__at") + 3600 * 1_000_000)
    arrival = cut_lineage(arrival.unionByName(again))
    lo, hi = arrival.agg(F.min("__at"), F.max("__at")).first()
    step = (hi - lo) // FILES + 1
    for i in range(FILES):
        part = arrival.filter((F.col("__at") >= lo + i * step) & (F.col("__at") < lo + (i + 1) * step)).drop("__at")
        part.coalesce(1).write.mode("append").parquet(path)
    return path, log.schema


def _stream_features(s, d) -> DataFrame:
    """The feature rows of all cases whose first events are certain when the input ends."""
    path, schema = _arrivals(s, d)
    out, state = scratch_path(s, "stream-features"), scratch_path(s, "stream-state")
    events = s.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    run_available(stream_features(events, L1_K, FEATURES, WATERMARK), out, state)
    table = s.read.parquet(out).withColumn("case_start_time", F.unix_micros("case_start_time"))
    for m in FEATURES.map_columns:
        table = table.withColumn(m, F.to_json(m))
    return rounded(table, GAP_DIGITS)


# --- linear attribution -------------------------------------------------------------------------

INTERCEPT = 0.25


def _stored_coefficients(s, d):
    """(explainer, test cells, test cases): a written coefficient table, the difference of class means per feature."""
    dictionary, train, test = M._encoded_split(s, d)
    cells = cut_lineage(N.encode_linear(train, train, dictionary, ENCODE))
    sizes = {r["target"]: r["n"] for r in train.groupBy("target").agg(F.count("*").alias("n")).collect()}
    of = lambda t: F.coalesce(F.sum(F.when(F.col("target") == t, F.col("value"))), F.lit(0.0)) / max(sizes.get(t, 0), 1)
    means = cells.join(train.select(CASE, "target"), CASE).groupBy("feature_index").agg((of(1) - of(0)).alias("coefficient"))
    path = scratch_path(s, "coefficients")
    dictionary.join(means, "feature_index", "left").na.fill(0.0, ["coefficient"]).write.parquet(path)
    explainer = LA.LinearExplainer.build(s.read.parquet(path), INTERCEPT, cells, sum(sizes.values()))
    return explainer, N.encode_linear(train, test, dictionary, ENCODE), test


def _linear(s, d) -> DataFrame:
    explainer, cells, _ = _stored_coefficients(s, d)
    return rounded(LA.linear_attribution(explainer, cells).drop("offset"))


def _linear_totals(s, d) -> DataFrame:
    return rounded(LA.case_totals(*_stored_coefficients(s, d)))


def _linear_importance(s, d) -> DataFrame:
    explainer, cells, test = _stored_coefficients(s, d)
    return rounded(LA.linear_importance(explainer, cells, test.count()).drop("rank"))


def _linear_additivity(s, d) -> DataFrame:
    """Of the fitted logistic model: rebuilt from its coefficients, and against probabilities moved for every third case."""
    dictionary, model, _, vectors = M._logistic(s, d)
    _, train, test = M._encoded_split(s, d)
    scored = cut_lineage(K.predict(model, vectors))
    cells = N.encode_linear(train, train, dictionary, ENCODE)
    explainer = LA.LinearExplainer.build(K.logistic_coefficients(model, dictionary), model.intercept, cells, train.count())
    totals = cut_lineage(LA.case_totals(explainer, N.encode_linear(train, test, dictionary, ENCODE), test))
    moved = scored.withColumn("y_prob", F.col("y_prob") + F.when(F.col(CASE) % 3 == 0, 1e-3 * F.col("y_prob") * (1 - F.col("y_prob"))).otherwise(0.0))
    rows = [LA.linear_additivity(totals, p).select(F.lit(n).alias("against"), "case_count", "above_1e_09", "above_1e_06")
            for n, p in (("model", scored), ("moved", moved))]
    return rows[0].unionByName(rows[1])


# --- uncertainty of the area ----------------------------------------------------------------------

def _models_by_window(s, d) -> DataFrame:
    """Two scores of the same cases: the length, and the length of every third case turned round."""
    windowed = M._windowed(s, d).select("window", CASE, "y_true", "y_prob")
    other = windowed.withColumn("y_prob", F.when(F.col(CASE) % 3 == 0, 1 - F.col("y_prob")).otherwise(F.col("y_prob")))
    return windowed.withColumn("model", F.lit("length")).unionByName(other.withColumn("model", F.lit("turned")))


# --- exact forest ------------------------------------------------------------------------------------

@M._once
def _exact(s, d):
    dictionary, train, test = M._tree_vectors(s, d)
    return dictionary, X.fit_exact_forest(train), train, test


@M._once
def _whole_tree(s, d):
    """One tree over all cases and features."""
    _, train, _ = M._tree_vectors(s, d)
    width = len(train.first()["features"])
    return X.fit_exact_forest(train, trees=1, candidates=width, bootstrap=False, local_rows=max(50, train.count() // 2)), train


def _root_split(s, d) -> DataFrame:
    """Cases and positives of the root, and the purity of its best split."""
    forest, _ = _whole_tree(s, d)
    top = forest.nodes.filter("depth <= 1").select("depth", F.col("cases").cast("double").alias("n"), F.col("positives").cast("double").alias("p"))
    pure = (F.col("p") * F.col("p") + (F.col("n") - F.col("p")) * (F.col("n") - F.col("p"))) / F.col("n")
    of = lambda c, depth: F.sum(F.when(F.col("depth") == depth, c))
    return rounded(top.agg(of(F.col("n"), 0).cast("long").alias("cases"), of(F.col("p"), 0).cast("long").alias("positives"), of(pure, 1).alias("purity")))


def _training_errors(s, d) -> DataFrame:
    """A tree grown to purity errs only where cases with the same features have different labels."""
    forest, train = _whole_tree(s, d)
    scored = X.predict_exact(forest, train)
    return scored.agg(F.count(F.lit(1)).alias("cases"), F.count(F.when(F.col("y_true") != F.col("y_pred"), 1)).alias("errors"))


# --- versions, states in force, trailing time, cubes ----------------------------------------------------

def _difference(s, d) -> DataFrame:
    """The orders against a version with some changed, some removed and some added, all in a few stretches of keys."""
    orders = table(s, d, "orders")
    key, planted = F.col("o_orderkey"), F.col("o_orderkey") % 4000 < 60
    changed = orders.filter(~planted | (key % 3 != 1)).withColumn("o_totalprice", F.when(planted & (key % 3 == 0), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    added = orders.filter(planted & (key % 3 == 2)).withColumn("o_orderkey", -key - 1)
    a = DF.write_version(orders, scratch_path(s, "version-a"), ["o_orderkey"], rows_per_range=500)
    b = DF.write_version(changed.unionByName(added), scratch_path(s, "version-b"), ["o_orderkey"], like=a)
    out = DF.differences(s, a, b)
    return rounded(out.withColumn("o_orderdate", micros(F.col("o_orderdate"))))


def _state_in_force(s, d) -> DataFrame:
    """The item that each event's case handled last, and by which activity."""
    log = l1(s, d).select(CASE, ACTIVITY, TS, ORDER_KEY, "item_id")
    states = log.filter("item_id is not null")
    return TJ.as_of_join(log.drop("item_id"), states, [CASE], TS, TS, {ACTIVITY: "state", "item_id": "item"}, tie=[ORDER_KEY]).drop(TS, ACTIVITY)


def _after_purchase(s, d) -> DataFrame:
    """What a user did in the six hours from each purchase on."""
    events = table(s, d, "events").select("user_id", F.col("ts").alias("at"), "event_type", "value")
    bought = table(s, d, "events").filter("event_type = 'purchase'").select(
        "user_id", "event_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("end"))
    pairs = TJ.interval_join(events, bought, ["user_id"], "at", "start", "end", unit_seconds=600)
    return rounded(pairs.groupBy("user_id", "event_id").agg(
        F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"), F.max("value").alias("largest")))


def _trailing_load(s, d) -> DataFrame:
    """The load of each event's resource over the day before it; a few resources have all the events."""
    log = l1(s, d).select(ORDER_KEY, TS, "resource", "value")
    out = TJ.trailing(log, ["resource"], TS, 86_400, {"events": F.count(F.lit(1)), "total": F.sum("value"), "largest": F.max("value")},
                      {"events": "count", "total": "sum", "largest": "max"})
    return rounded(out.select(ORDER_KEY, "resource", "events", "total", "largest"), 4)


def _case_cube(s, d) -> DataFrame:
    return CU.cube_distinct(l1(s, d), ["event_type", "resource", "segment"])


# --- sketches and redundant features ---------------------------------------------------------------------

QUANTILES = {"q10": 0.1, "q50": 0.5, "q90": 0.9, "q99": 0.99}


def _sketched(s, d) -> tuple[DataFrame, DataFrame]:
    """Profiles of weeks from stored sketches of days, and the rows they stand for."""
    events = table(s, d, "events").withColumn("day", F.datediff("ts", F.lit("2024-01-01")))
    path = scratch_path(s, "sketches")
    SK.build_sketches(events, F.col("day"), ["value"], ["user_id", "value"]).write.parquet(path)
    week = F.floor(F.col("period") / 7).cast("long")
    profile = SK.sketch_profile(SK.merge_sketches(s.read.parquet(path), week), QUANTILES)
    return cut_lineage(profile), events.select(F.floor(F.col("day") / 7).cast("long").alias("span"), "user_id", "value")


def _sketch_profile(s, d) -> DataFrame:
    """What sketches keep exactly, and whether distinct counts are within four standard errors of the exact ones."""
    profile, rows = _sketched(s, d)
    exact = rows.groupBy("span").agg(F.count_distinct("user_id").alias("user_id"), F.count_distinct("value").alias("value"))
    exact = exact.unpivot("span", ["user_id", "value"], "column", "exact")
    close = F.abs(F.col("distinct") - F.col("exact")) <= 1 + 4 * SK.distinct_error() * F.col("exact")
    return rounded(profile.join(exact, ["span", "column"]).select("span", "column", "rows", "non_null", "smallest", "largest", close.alias("distinct_within")))


def _sketch_quantiles(s, d) -> DataFrame:
    profile, rows = _sketched(s, d)
    return SK.rank_violations(profile, rows, "value", QUANTILES, SK.rank_error()).groupBy("span").agg(
        F.count(F.lit(1)).alias("quantiles"), F.count(F.when(~F.col("within"), 1)).alias("violations"))


def _redundant(s, d) -> DataFrame:
    """The dimensions of the vectors and four linear copies of some, one of a copy."""
    base = table(s, d, "embeddings").select(F.col("vec_id").alias(CASE), F.posexplode("embedding").alias("feature_index", "v"))
    base = cut_lineage(base.select(CASE, F.col("feature_index").cast("long").alias("feature_index"), F.col("v").cast("double").alias("value")))
    copies = [(3, 1000, 2.0, 1.0), (3, 1001, -0.5, 0.0), (7, 1002, 10.0, -3.0), (11, 1003, -1.0, 0.25)]
    cells = base
    for source, index, a, b in copies:
        cells = cells.unionByName(base.filter(F.col("feature_index") == source).select(CASE, F.lit(index).cast("long").alias("feature_index"), (F.col("value") * a + b).alias("value")))
    dictionary = cells.select("feature_index").distinct().select("feature_index", F.concat(F.lit("f"), F.lpad(F.col("feature_index").cast("string"), 4, "0")).alias("feature_name"))
    return rounded(RD.redundant_features(cells, base.select(CASE).distinct(), dictionary, 0.999))


QUERIES = {
    "stream_prefix_features": _stream_features,
    "linear_attribution": _linear,
    "linear_case_totals": _linear_totals,
    "linear_importance": _linear_importance,
    "linear_additivity": _linear_additivity,
    "auc_intervals": lambda s, d: rounded(U.auc_intervals(M._windowed(s, d), ["window"])),
    "auc_findings": lambda s, d: rounded(U.auc_changes(M._windowed(s, d), WINDOWS)),
    "auc_model_differences": lambda s, d: rounded(U.auc_differences(_models_by_window(s, d), ["length", "turned"], ["window"]), 5),
    "exact_forest": lambda s, d: X.predict_exact(_exact(s, d)[1], _exact(s, d)[3]),
    "exact_forest_structure": lambda s, d: X.exact_structure(_exact(s, d)[1]),
    "exact_forest_importance": lambda s, d: X.exact_importance(_exact(s, d)[1], _exact(s, d)[0]),
    "exact_forest_checks": lambda s, d: X.exact_checks(_exact(s, d)[1]),
    "exact_forest_roots": lambda s, d: _exact(s, d)[1].nodes.filter("depth = 0").select("tree", "cases", "positives"),
    "exact_root_split": _root_split,
    "exact_training_errors": _training_errors,
    "table_difference": _difference,
    "state_in_force": _state_in_force,
    "events_after_purchase": _after_purchase,
    "trailing_load": _trailing_load,
    "case_cube": _case_cube,
    "sketch_profile": _sketch_profile,
    "sketch_quantiles": _sketch_quantiles,
    "redundant_features": _redundant,
}


# --- SQL ------------------------------------------------------------------------------------------

_WIDE = ", ".join(f"j_{ns}.j AS {ns}_counts" for ns in FEATURES.count_maps.values())
_JOINS = " ".join(f"JOIN jsons j_{ns} ON j_{ns}.case_id = f.case_id AND j_{ns}.namespace = '{ns}'" for ns in FEATURES.count_maps.values())
# The watermark ends a day before the newest event; a prefix is certain when its third event is not younger.
_STREAM = f"""WITH {sql.L1_LOG},
ord AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, order_key) AS event_pos FROM log),
prefix AS (SELECT * FROM ord WHERE event_pos <= 3),
feat AS (SELECT case_id, epoch_us(min(ts)) AS case_start_time, epoch_us(max(ts)) AS third, arg_min(segment, event_pos) AS segment,
    arg_min(credit_limit, event_pos) AS credit_limit, count(DISTINCT activity) AS n_unique_activities, count(DISTINCT resource) AS n_unique_resources,
    round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 7) AS prefix_duration_seconds,
    round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 2, 7) AS mean_event_gap_seconds
  FROM prefix GROUP BY case_id HAVING count(*) = 3),
counts AS ({" UNION ALL ".join(f"SELECT case_id, '{ns}' AS namespace, {src} AS key, count(*) AS count FROM prefix GROUP BY case_id, {src}"
                                for src, ns in FEATURES.count_maps.items())}),
jsons AS (SELECT case_id, namespace, '{{' || string_agg('"' || key || '":' || count, ',' ORDER BY key) || '}}' AS j FROM counts GROUP BY ALL)
SELECT f.* EXCLUDE (third), {_WIDE} FROM feat f {_JOINS}
WHERE (third + 999) // 1000 <= (SELECT epoch_us(max(ts)) // 1000 - 86400000 FROM log)"""

_LINEAR = _STATS.rstrip() + """, lin AS (SELECT case_id, split, feature_index, feature_name, CASE feature_name """ + " ".join(
    f"WHEN '{c}' THEN (value - m_{c}) / s_{c}" for c in _NUM) + f""" ELSE value END AS value
  FROM cells JOIN dict USING (source_group, feature_name), st),
coef AS (SELECT d.feature_index, d.feature_name,
    coalesce(sum(l.value) FILTER (p.target = 1), 0) / (SELECT count(*) FROM parts WHERE split = 'train' AND target = 1)
    - coalesce(sum(l.value) FILTER (p.target = 0), 0) / (SELECT count(*) FROM parts WHERE split = 'train' AND target = 0) AS w,
    coalesce(sum(l.value), 0) / (SELECT count(*) FROM parts WHERE split = 'train') AS m
  FROM dict d LEFT JOIN (SELECT * FROM lin WHERE split = 'train') l USING (feature_index) LEFT JOIN parts p ON p.case_id = l.case_id GROUP BY ALL),
phi AS (SELECT p.case_id, c.feature_index, c.feature_name AS feature, coalesce(l.value, 0) AS value, coalesce(l.value, 0) <> 0 AS present,
    w * (coalesce(l.value, 0) - m) AS shap_value
  FROM (SELECT case_id FROM parts WHERE split = 'test') p CROSS JOIN coef c
  LEFT JOIN lin l ON l.case_id = p.case_id AND l.feature_index = c.feature_index)
"""

_Z95 = "1.959963984540054"
# Placements by ranks: a score's cases of the other class below it, and half of those at it.
_PLACED = M._S1W + """,
m AS (SELECT "window", case_id, 'length' AS model, y_true, y_prob FROM w
  UNION ALL SELECT "window", case_id, 'turned', y_true, CASE WHEN case_id % 3 = 0 THEN 1 - y_prob ELSE y_prob END FROM w),
v AS (SELECT "window", case_id, model, y_true, CASE WHEN y_true = 1
    THEN (coalesce(sum(1 - y_true) OVER below, 0) + sum(1 - y_true) OVER tied / 2) / sum(1 - y_true) OVER whole
    ELSE (coalesce(sum(y_true) OVER above, 0) + sum(y_true) OVER tied / 2) / sum(y_true) OVER whole END AS place FROM m
  WINDOW whole AS (PARTITION BY "window", model), tied AS (PARTITION BY "window", model, y_prob),
    below AS (PARTITION BY "window", model ORDER BY y_prob RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP),
    above AS (PARTITION BY "window", model ORDER BY y_prob RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING EXCLUDE GROUP)),
auc AS (SELECT "window", model, count(*) FILTER (y_true = 1) AS positives, count(*) FILTER (y_true = 0) AS negatives,
    avg(place) FILTER (y_true = 1) AS roc_auc, var_samp(place) FILTER (y_true = 1) / count(*) FILTER (y_true = 1)
      + var_samp(place) FILTER (y_true = 0) / count(*) FILTER (y_true = 0) AS variance FROM v GROUP BY ALL)
"""

SQL = {
    "stream_prefix_features": _STREAM,
    "linear_attribution": enc(_LINEAR + """SELECT case_id, feature_index, feature, round(value, 6) AS value, round(shap_value, 6) AS shap_value
FROM phi WHERE present"""),
    "linear_case_totals": enc(_LINEAR + f""", t AS (SELECT case_id, count(*) FILTER (present) AS present_features,
    {INTERCEPT} + (SELECT sum(w * m) FROM coef) AS base_value, coalesce(sum(shap_value) FILTER (present), 0) AS present_value,
    coalesce(sum(shap_value) FILTER (NOT present), 0) AS absent_value FROM phi GROUP BY case_id),
o AS (SELECT *, {INTERCEPT} + v AS log_odds FROM t JOIN (SELECT case_id, sum(w * value) AS v FROM phi JOIN coef USING (feature_index) GROUP BY 1) USING (case_id))
SELECT case_id, present_features, round(base_value, 6) AS base_value, round(present_value, 6) AS present_value,
  round(absent_value, 6) AS absent_value, round(log_odds, 6) AS log_odds, round(1 / (1 + exp(-log_odds)), 6) AS probability FROM o"""),
    "linear_importance": enc(_LINEAR + """SELECT feature, round(avg(abs(shap_value)), 6) AS mean_abs_shap, round(avg(shap_value), 6) AS mean_shap,
  round(avg(abs(shap_value)) / sum(avg(abs(shap_value))) OVER (), 6) AS share_of_total_importance FROM phi GROUP BY feature"""),
    "linear_additivity": enc("""SELECT 'model' AS against, count(*) AS case_count, 0::BIGINT AS above_1e_09, 0::BIGINT AS above_1e_06
FROM parts WHERE split = 'test'
UNION ALL SELECT 'moved', count(*), count(*) FILTER (case_id % 3 = 0), count(*) FILTER (case_id % 3 = 0) FROM parts WHERE split = 'test'"""),
    "auc_intervals": _PLACED + f"""SELECT "window", positives, negatives, round(roc_auc, 6) AS roc_auc, round(variance, 6) AS variance,
  round(sqrt(variance), 6) AS standard_error, round(greatest(roc_auc - {_Z95} * sqrt(variance), 0), 6) AS "lower",
  round(least(roc_auc + {_Z95} * sqrt(variance), 1), 6) AS "upper" FROM auc WHERE model = 'length'""",
    "auc_findings": _PLACED + f""", ch AS (SELECT a."window" || '_to_' || b."window" AS comparison, b.roc_auc - a.roc_auc AS d, a.variance + b.variance AS var
  FROM auc a JOIN auc b ON a.model = 'length' AND b.model = 'length' AND (a."window", b."window") IN (('T1', 'T2'), ('T2', 'T3'), ('T1', 'T3')))
SELECT comparison, round(d, 6) AS delta_roc_auc, round(var, 6) AS variance, round(sqrt(var), 6) AS standard_error,
  round(d - {_Z95} * sqrt(var), 6) AS "lower", round(d + {_Z95} * sqrt(var), 6) AS "upper",
  CASE WHEN d - {_Z95} * sqrt(var) > 0 THEN 'rose' WHEN d + {_Z95} * sqrt(var) < 0 THEN 'fell' ELSE 'no change shown' END AS finding FROM ch""",
    "auc_model_differences": _PLACED + f""", p AS (SELECT a."window", a.y_true, a.place AS x, b.place AS y FROM v a JOIN v b
  ON a."window" = b."window" AND a.case_id = b.case_id AND a.model = 'length' AND b.model = 'turned'),
c AS (SELECT "window", count(*) FILTER (y_true = 1) AS positives, count(*) FILTER (y_true = 0) AS negatives,
    avg(x) FILTER (y_true = 1) AS roc_auc_a, avg(y) FILTER (y_true = 1) AS roc_auc_b,
    covar_samp(x, y) FILTER (y_true = 1) / count(*) FILTER (y_true = 1) + covar_samp(x, y) FILTER (y_true = 0) / count(*) FILTER (y_true = 0) AS covariance
  FROM p GROUP BY "window"),
e AS (SELECT c.*, roc_auc_b - roc_auc_a AS difference, (SELECT sum(variance) FROM auc WHERE auc."window" = c."window") - 2 * covariance AS variance FROM c)
SELECT "window", 'length' AS model_a, 'turned' AS model_b, positives, negatives, round(roc_auc_a, 5) AS roc_auc_a, round(roc_auc_b, 5) AS roc_auc_b,
  round(difference, 5) AS difference, round(covariance, 5) AS covariance, round(variance, 5) AS variance, round(sqrt(variance), 5) AS standard_error,
  round(greatest(difference - {_Z95} * sqrt(variance), -1), 5) AS "lower", round(least(difference + {_Z95} * sqrt(variance), 1), 5) AS "upper",
  round(difference / sqrt(variance), 5) AS z FROM e""",
    "exact_forest_checks": "SELECT property, 0::BIGINT AS violations FROM (VALUES "
        "('leaves_hold_the_root'), ('no_empty_node'), ('no_pure_node_is_split'), ('names_are_unique')) v(property)",
    "exact_forest_roots": enc(f""", drawn AS (SELECT t.tree, p.case_id, p.target, CAST('0x' || md5('42:' || t.tree || ':' || p.case_id)[1:13] AS BIGINT)::DOUBLE / 16::DOUBLE ** 13 AS u
  FROM parts p CROSS JOIN (SELECT unnest(range(300)) AS tree) t WHERE split = 'train'),
counted AS (SELECT tree, target, {" + ".join(f"(u >= {sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))!r})::INT" for k in range(12))} AS w FROM drawn)
SELECT tree::INT AS tree, sum(w)::BIGINT AS cases, sum(w * target)::BIGINT AS positives FROM counted GROUP BY tree"""),
    "exact_root_split": enc(""", x AS (SELECT p.case_id, p.target, d.feature_index, coalesce(c.value, 0) AS v
  FROM parts p CROSS JOIN dict d LEFT JOIN cells c ON c.case_id = p.case_id AND c.source_group = d.source_group AND c.feature_name = d.feature_name
  WHERE p.split = 'train'),
g AS (SELECT feature_index, v, count(*) AS n, sum(target) AS p FROM x GROUP BY ALL),
r AS (SELECT sum(n) OVER w AS ln, sum(p) OVER w AS lp, sum(n) OVER f AS n, sum(p) OVER f AS p FROM g
  WINDOW w AS (PARTITION BY feature_index ORDER BY v), f AS (PARTITION BY feature_index))
SELECT max(n)::BIGINT AS cases, max(p)::BIGINT AS positives,
  round(max((lp * lp + (ln - lp) * (ln - lp)) / ln + ((p - lp) * (p - lp) + (n - ln - p + lp) * (n - ln - p + lp)) / (n - ln)), 6) AS purity
FROM r WHERE ln < n"""),
    "exact_training_errors": enc(""", same AS (SELECT count(*) AS n, sum(target) AS p FROM parts JOIN (
    SELECT case_id, string_agg(namespace || j, '|' ORDER BY namespace) AS s FROM jsons GROUP BY case_id) USING (case_id)
  WHERE split = 'train' GROUP BY s, segment, """ + ", ".join(_NUM) + """)
SELECT sum(n)::BIGINT AS cases, sum(least(p, n - p))::BIGINT AS errors FROM same"""),
    "table_difference": """WITH a AS (SELECT * REPLACE (epoch_us(o_orderdate) AS o_orderdate, round(o_totalprice, 6) AS o_totalprice) FROM orders),
b AS (SELECT * REPLACE (CASE WHEN o_orderkey % 4000 < 60 AND o_orderkey % 3 = 0 THEN round(o_totalprice + 1, 6) ELSE o_totalprice END AS o_totalprice)
    FROM a WHERE o_orderkey % 4000 >= 60 OR o_orderkey % 3 <> 1
  UNION ALL SELECT * REPLACE (-o_orderkey - 1 AS o_orderkey) FROM a WHERE o_orderkey % 4000 < 60 AND o_orderkey % 3 = 2),
n AS (SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)),
c AS (SELECT *, count(*) AS copies FROM n GROUP BY ALL)
SELECT *, CASE WHEN count(DISTINCT side) OVER (PARTITION BY o_orderkey) = 2 THEN 'changed' WHEN side = 'a' THEN 'removed' ELSE 'added' END AS change FROM c""",
    "state_in_force": sql.l1_log("""SELECT l.case_id, l.order_key, r.activity AS state, r.item_id AS item
FROM log l ASOF LEFT JOIN (SELECT case_id, ts, arg_max(activity, order_key) AS activity, arg_max(item_id, order_key) AS item_id
  FROM log WHERE item_id IS NOT NULL GROUP BY case_id, ts) r ON l.case_id = r.case_id AND l.ts >= r.ts"""),
    "events_after_purchase": """SELECT b.user_id, b.event_id, count(*) AS events, count(*) FILTER (e.event_type = 'error') AS errors, round(max(e.value), 6) AS largest
FROM events b JOIN events e ON e.user_id = b.user_id AND e.ts >= b.ts AND e.ts < b.ts + INTERVAL 6 HOURS WHERE b.event_type = 'purchase' GROUP BY ALL""",
    "trailing_load": sql.l1_log("""SELECT order_key, resource, count(*) OVER w AS events, round(sum(value) OVER w, 4) AS total, max(value) OVER w AS largest
FROM log WINDOW w AS (PARTITION BY resource ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)"""),
    "case_cube": sql.l1_log("""SELECT event_type, resource, segment, grouping_id(event_type, resource, segment)::BIGINT AS grouping_id,
  count(*) AS rows, count(DISTINCT case_id) AS cases FROM log GROUP BY CUBE (event_type, resource, segment)"""),
    "sketch_profile": """WITH r AS (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS span, value, user_id FROM events)
SELECT span, 'value' AS "column", count(*) AS rows, count(value) AS non_null, round(min(value), 6) AS smallest, round(max(value), 6) AS largest,
  true AS distinct_within FROM r GROUP BY span
UNION ALL SELECT span, 'user_id', count(*), count(user_id), NULL, NULL, true FROM r GROUP BY span""",
    "sketch_quantiles": """SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS span, 4::BIGINT AS quantiles, 0::BIGINT AS violations
FROM events GROUP BY span""",
    "redundant_features": """WITH base AS (SELECT vec_id AS case_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
x AS (SELECT * FROM base UNION ALL SELECT case_id, 1000, 2 * v + 1 FROM base WHERE i = 3 UNION ALL SELECT case_id, 1001, -0.5 * v FROM base WHERE i = 3
  UNION ALL SELECT case_id, 1002, 10 * v - 3 FROM base WHERE i = 7 UNION ALL SELECT case_id, 1003, 0.25 - v FROM base WHERE i = 11),
p AS (SELECT a.i AS a, b.i AS b, corr(a.v, b.v) AS r FROM x a JOIN x b ON a.case_id = b.case_id AND a.i < b.i GROUP BY ALL HAVING abs(corr(a.v, b.v)) >= 0.999)
SELECT 'f' || lpad(b::VARCHAR, 4, '0') AS feature_name, 'f' || lpad(min(a)::VARCHAR, 4, '0') AS earlier_feature, round(arg_min(r, a), 6) AS correlation,
  'f' || lpad(min(a)::VARCHAR, 4, '0') AS kept_feature FROM p GROUP BY b""",
}
