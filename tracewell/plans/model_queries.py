"""Metric, model, attribution and stability queries."""

from __future__ import annotations

import threading
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import count_where, rounded, scalar
from tracewell.operators import attribution as B
from tracewell.operators import contracts as C
from tracewell.operators import encode as N
from tracewell.operators import metrics as M
from tracewell.operators import models as K
from tracewell.operators import stability as Z
from tracewell.operators import temporal as T
from tracewell.operators.order import ranged_row_number
from tracewell.plans import sql
from tracewell.plans.feature_queries import ENCODE, enc, split_features
from tracewell.plans.tables import L1_K, WINDOWS, attributions, l1_cases, scores, table
from tracewell.session import cut_lineage, scratch_path

# Background rows of the explainer, a documented sample, and cases in a batch.
BACKGROUND_N = 500
BATCH = 1000
TOP_K = 10
BASE = 0.5


# --- scores (S1) --------------------------------------------------------------------------

def _windowed(s, d) -> DataFrame:
    return T.temporal_windows(scores(s, d), "case_id", WINDOWS)[0]


def _three_models(s, d) -> DataFrame:
    base = scores(s, d).select("case_id", "y_true", "y_prob")
    kinds = {"constant": F.lit(0.75), "length": F.col("y_prob"), "shortness": 1 - F.col("y_prob")}
    parts = [
        base.select("case_id", "y_true", p.alias("y_prob")).withColumn("y_pred", (F.col("y_prob") > 0.5).cast("int"))
        .withColumn("model", F.lit(m)) for m, p in kinds.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _audit(s, d):
    models = _three_models(s, d)
    population = scores(s, d).select("case_id", F.col("y_true").alias("target"))
    # The audit must find errors: one "model" misses the cases of a language and flips labels.
    partial = scores(s, d).filter("lang <> 'de'").withColumn("y_true", F.when(F.col("lang") == "fr", 1 - F.col("y_true"))
                                                             .otherwise(F.col("y_true")))
    return M.prediction_audit({"length": models.filter("model = 'length'"), "partial": partial}, population)


def _window_metrics(s, d):
    return M.window_metrics(_windowed(s, d))


def _deltas(s, d):
    return M.window_deltas(_window_metrics(s, d), WINDOWS)


def _check_close(s, d):
    """Metrics against a written table of them, as it is and with one language's values raised."""
    path = scratch_path(s, "metrics")
    M.prediction_metrics(scores(s, d), ["lang"]).write.parquet(path)
    stored = s.read.parquet(path)
    measured = cut_lineage(M.prediction_metrics(scores(s, d), ["lang"]))
    raised = stored.withColumns({m: F.col(m) + F.when(F.col("lang") == "de", 0.01).otherwise(0.0) for m in M.METRICS})
    checks = C.check_close(measured, raised, ["lang"], M.METRICS, 1e-12)
    return C.check_close(measured, stored, ["lang"], M.METRICS, 1e-12).unionByName(
        checks.withColumn("check", F.concat(F.lit("raised:"), "check")))


def _stored_predictions(s, d):
    """A written prediction table with rows left out, labels turned and probabilities moved."""
    path = scratch_path(s, "predictions")
    ours = scores(s, d).select("case_id", "y_pred", "y_prob")
    case = F.col("case_id")
    ours.filter(case % 11 != 0).withColumns({
        "y_pred": F.when(case % 7 == 0, 1 - F.col("y_pred")).otherwise(F.col("y_pred")),
        "y_prob": F.col("y_prob") + F.when(case % 5 == 0, 1e-6).otherwise(0.0),
    }).unionByName(ours.filter(case % 13 == 0).withColumn("case_id", -case - 1)).write.parquet(path)
    return M.stored_predictions_audit(ours, s.read.parquet(path))


# --- models on case features ----------------------------------------------------------------

KEEP = ["case_id", "target"]


_shared: dict[tuple, object] = {}
_lock = threading.RLock()


def _once(make):
    """One fitted result for a session and table folder: many queries look at the same model."""
    def get(s, d):
        key = (make.__name__, s.sparkContext.applicationId, d)
        with _lock:
            if key not in _shared:
                _shared[key] = make(s, d)
            return _shared[key]

    return get


@_once
def _encoded_split(s, d):
    """Dictionary, train and test: written once, since every fit, score and table of cells reads them."""
    train, test = (cut_lineage(x) for x in split_features(s, d))
    return N.frozen_dictionary(N.vocabulary_fit(train, ENCODE)), train, test


@_once
def _logistic(s, d):
    dictionary, train, test = _encoded_split(s, d)
    linear = [cut_lineage(N.assemble(N.scale_numeric(train, x, ENCODE.numeric), dictionary, ENCODE, KEEP)) for x in (train, test)]
    return dictionary, K.fit_logistic(linear[0]), *linear


@_once
def _tree_vectors(s, d):
    dictionary, train, test = _encoded_split(s, d)
    return dictionary, *[cut_lineage(N.assemble(x, dictionary, ENCODE, KEEP)) for x in (train, test)]


@_once
def _forest(s, d):
    dictionary, train, test = _tree_vectors(s, d)
    return dictionary, K.fit_stored_forest(train), train, test


def _refit(s, d):
    """The shared forest against another fit, and against a fit on other rows, which must differ."""
    dictionary, model, train, test = _forest(s, d)
    half = train.filter("case_id % 2 = 0")
    other = K.refit_equality(lambda x: model if x is train else K.fit_stored_forest(half), train, test, dictionary, again=half)
    same = K.refit_equality(lambda x: model if x is train else K.fit_stored_forest(train), train, test, dictionary, again=half)
    return same.unionByName(other.withColumn("check", F.concat(F.lit("half:"), "check")))


def _reload(s, d):
    _, model, _, test = _forest(s, d)
    return K.reload_equality(model, scratch_path(s, "reload"), test)


@_once
def _explained(s, d):
    dictionary, model, train, test = _forest(s, d)
    background = T.seeded_sample(train, "case_id", BACKGROUND_N)
    return dictionary, model, B.StoredExplainer.build(model, background), test


@_once
def _both_classes(s, d):
    """Attributions of both labels for every test case, from one pass."""
    dictionary, _, explainer, test = _explained(s, d)
    return cut_lineage(B.tree_attribution(explainer, test, dictionary, labels=(0, 1)))


def _of_class(s, d, label):
    return _both_classes(s, d).filter(F.col("label") == label)


def _tree(s, d):
    return _of_class(s, d, 1).drop("label")


def _tree_additivity(s, d):
    """Against the model's probabilities, and against probabilities moved for every third case."""
    _, model, _, test = _explained(s, d)
    right = K.predict(model, test)
    moved = right.withColumn("y_prob", F.col("y_prob") + F.when(F.col("case_id") % 3 == 0, 1e-3).otherwise(0.0))
    checks = [B.additivity_check(_of_class(s, d, 1), p).select(F.lit(n).alias("against"), "case_count", "above_1e_09", "above_1e_06")
              for n, p in (("model", right), ("moved", moved))]
    return checks[0].unionByName(checks[1])


def _class_zero(s, d):
    _, model, _, test = _explained(s, d)
    right = K.predict(model, test)
    swapped = right.withColumn("y_prob", 1 - F.col("y_prob"))
    checks = [B.class_zero_additivity(_of_class(s, d, 1), _of_class(s, d, 0), p).select(F.lit(n).alias("against"), "case_count", "status")
              for n, p in (("model", right), ("swapped", swapped))]
    return checks[0].unionByName(checks[1])


def _class_select(s, d):
    per_case = _both_classes(s, d).groupBy("case_id", "label").agg(
        F.max("base_value").alias("base_value"), F.sum("shap_value").alias("contribution"))
    return per_case.select("case_id", "label", (F.col("base_value") + F.col("contribution")).alias("probability"))


def _class_axis(s, d):
    """Both labels of each case add up to one, and label 1 is the positive class."""
    _, model, _, test = _explained(s, d)
    one = _class_select(s, d).groupBy("case_id").agg(
        F.sum("probability").alias("total"), F.max(F.when(F.col("label") == 1, F.col("probability"))).alias("positive"))
    both = one.join(K.predict(model, test).select("case_id", "y_prob"), "case_id")
    return both.agg(
        F.count("*").alias("cases"), count_where(F.abs(F.col("total") - 1) > 1e-9).alias("sums_off"),
        count_where(F.abs(F.col("positive") - F.col("y_prob")) > 1e-9).alias("positive_off"))


@_once
def _batches(s, d):
    """Computed once, and read back by a second call."""
    dictionary, _, explainer, test = _explained(s, d)
    ordered = ranged_row_number(test, ["case_id"], [], "n").withColumn("sample_order", F.col("n") - 1).drop("n")
    path = scratch_path(s, "batches")
    B.attribution_batches(explainer, ordered, dictionary, path, BATCH)
    return B.attribution_batches(explainer, ordered, dictionary, path, BATCH)


def _batch_coverage(s, d):
    """Cases, features and values of all batches, and how far they are from the model."""
    _, model, _, test = _explained(s, d)
    out = _batches(s, d)
    error = B.additivity_check(out, K.predict(model, test))
    return out.agg(
        F.count_distinct("batch").alias("batches"), F.count_distinct("case_id").alias("cases"),
        F.count_distinct("feature").alias("features"), F.count("*").alias("cells"),
    ).withColumn("above_1e_09", scalar(error, "above_1e_09"))


def _model_properties(s, d):
    """What must hold for any fitted model: the logistic gradient vanishes, importances add up to
    one, every test case has one prediction with a probability in 0 to 1."""
    _, logistic, train, test = _logistic(s, d)
    dictionary, forest, _, tree_test = _forest(s, d)
    w, n = logistic.coefficients.toArray(), train.count()
    residual = K.predict(logistic, train).select("case_id", (F.col("y_prob") - F.col("y_true")).alias("r"))
    cells = train.join(residual, "case_id").select("r", F.posexplode(vector_to_array("features")).alias("i", "x"))
    gradient = cells.groupBy("i").agg(F.sum(F.col("r") * F.col("x")).alias("g"))
    weights = s.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "i int, w double")
    steep = gradient.join(weights, "i").agg(F.max(F.abs(F.col("g") + F.col("w"))).alias("m"))
    importance = K.forest_importance(forest, dictionary).agg(F.sum("importance").alias("m"))
    rows = [
        steep.select(F.lit("gradient_vanishes").alias("property"), (F.col("m") / n < 1e-6).alias("holds"), F.lit(n).cast("long").alias("rows")),
        importance.select(F.lit("importance_sums_to_one").alias("property"), (F.abs(F.col("m") - 1) < 1e-9).alias("holds"),
                          F.lit(dictionary.count()).cast("long").alias("rows")),
    ]
    for name, model, data in (("logistic", logistic, test), ("forest", forest, tree_test)):
        p = K.predict(model, data)
        rows.append(p.agg(F.lit(f"{name}_probabilities").alias("property"),
                          (count_where(~F.coalesce(F.col("y_prob").between(0, 1), F.lit(False))) == 0).alias("holds"),
                          F.count_distinct("case_id").alias("rows")))
    return reduce(DataFrame.unionByName, rows)


# --- attribution tables (A1) ------------------------------------------------------------------

def _a1_dictionary(s, d) -> DataFrame:
    names = attributions(s, d).select(F.col("feature").alias("feature_name")).distinct()
    block = F.floor(F.substring("feature_name", 2, 2).cast("int") / 8).cast("string")
    return names.select("feature_name", F.concat(F.lit("block::"), block).alias("source_group"))


_GROUPS = {f"block::{i}": f"Group{i}" for i in range(8)}
_PREFIXES = {f"block::{i}": "f" for i in range(8)}


def _groups(s, d):
    return B.feature_groups(_a1_dictionary(s, d), _GROUPS, _PREFIXES)


def _predictions(s, d) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return table(s, d, "embeddings").select(
        F.col("vec_id").alias("case_id"), F.col("vec_id").alias("sample_order"),
        (F.col("label") % 2).cast("int").alias("y_true"), (total + BASE).alias("y_prob"),
    ).withColumn("y_pred", (F.col("y_prob") > 0.5).cast("int"))


def _a1(s, d):
    return attributions(s, d).withColumn("base_value", F.lit(BASE))


def _examples(s, d):
    return B.local_examples(_predictions(s, d))


def _contributions(s, d):
    return B.local_contributions(_examples(s, d), _a1(s, d))


def _tree_local(s, d):
    """Every feature of one case of each kind with its value, under the forest."""
    _, model, _, test = _explained(s, d)
    examples = B.local_examples(K.predict(model, test).withColumn("sample_order", F.col("case_id")))
    return B.local_contributions(examples, _tree(s, d))


def _a1_windowed(s, d):
    w, _ = T.temporal_windows(table(s, d, "embeddings").select(F.col("vec_id").alias("case_id")), "case_id", WINDOWS)
    return attributions(s, d, w)


def _importance(s, d):
    return Z.window_importance(_a1_windowed(s, d))


def _top(s, d):
    return Z.window_top_k(Z.window_rank(_importance(s, d)), TOP_K)


def _signed(s, d):
    return Z.signed_summary(Z.window_rank(_importance(s, d)), WINDOWS, TOP_K)


QUERIES = {
    # metrics
    "confusion": lambda s, d: M.confusion(scores(s, d), ["source"]),
    "threshold_metrics": lambda s, d: rounded(M.threshold_metrics(scores(s, d), ["source"])),
    "roc_auc": lambda s, d: rounded(M.roc_auc(scores(s, d), ["source"])),
    "roc_auc_overall": lambda s, d: rounded(M.roc_auc(scores(s, d))),
    "average_precision": lambda s, d: rounded(M.average_precision(scores(s, d), ["source"])),
    "roc_curve": lambda s, d: rounded(M.roc_curve(scores(s, d), ["lang"])),
    "pr_curve": lambda s, d: rounded(M.pr_curve(scores(s, d), ["lang"])),
    "model_comparison": lambda s, d: rounded(M.model_comparison(_three_models(s, d))),
    "metric_deltas": lambda s, d: rounded(M.metric_deltas(M.model_comparison(_three_models(s, d)), "constant")),
    "prediction_audit": _audit,
    "window_metrics": lambda s, d: rounded(_window_metrics(s, d)),
    "window_deltas": lambda s, d: rounded(_deltas(s, d)),
    "overall_vs_window": lambda s, d: rounded(M.overall_vs_window(_windowed(s, d))),
    "sample_prediction_audit": lambda s, d: rounded(M.sample_prediction_audit(
        T.seeded_sample(scores(s, d), "case_id", 100))),
    "early_outcome_class": lambda s, d: M.early_outcome_class(l1_cases(s, d), L1_K),
    "check_close": _check_close,
    # models
    "prior_model": lambda s, d: rounded(K.prior_model(*split_features(s, d))),
    "logistic_model": lambda s, d: (lambda dic, m, train, test: K.predict(m, test))(*_logistic(s, d)),
    "logistic_coefficients": lambda s, d: (lambda dic, m, *_: K.logistic_coefficients(m, dic))(*_logistic(s, d)),
    "coefficient_signs": lambda s, d: (lambda dic, m, *_: K.coefficient_signs(K.logistic_coefficients(m, dic)))(
        *_logistic(s, d)),
    "model_properties": _model_properties,
    "stored_predictions_audit": _stored_predictions,
    "forest_model": lambda s, d: (lambda dic, m, train, test: K.predict(m, train))(*_forest(s, d)),
    "forest_importance": lambda s, d: (lambda dic, m, *_: K.forest_importance(m, dic))(*_forest(s, d)),
    "forest_importance_top": lambda s, d: (lambda dic, m, *_: K.forest_importance(m, dic, TOP_K))(*_forest(s, d)),
    "forest_structure": lambda s, d: K.forest_structure(_forest(s, d)[1], s),
    "predict": lambda s, d: (lambda dic, m, train, test: K.predict(m, test))(*_forest(s, d)),
    "refit_equality": _refit,
    "reload_equality": _reload,
    # attribution
    "tree_attribution": _tree,
    "class_select": _class_select,
    "class_axis": _class_axis,
    "attribution_coverage": _batch_coverage,
    "attribution_batches": _batches,
    "batch_runtime": lambda s, d: B.batch_runtime(_batches(s, d)),
    "tree_additivity": _tree_additivity,
    "class_zero_additivity": _class_zero,
    "additivity_check": lambda s, d: rounded(B.additivity_check(
        _a1(s, d), _predictions(s, d).withColumn("y_prob", F.col("y_prob") + F.col("case_id") % 5 * 1e-3), (1e-9, 5e-4))),
    "attribution_numeric": lambda s, d: rounded(B.attribution_numeric(_a1(s, d))),
    "global_importance": lambda s, d: rounded(B.global_importance(_a1(s, d))),
    "feature_groups": _groups,
    "feature_group_counts": lambda s, d: B.group_counts(_groups(s, d)),
    "group_importance": lambda s, d: rounded(B.group_importance(B.global_importance(_a1(s, d)), _groups(s, d))),
    "local_examples": lambda s, d: rounded(_examples(s, d)),
    "local_contributions": lambda s, d: rounded(_contributions(s, d).drop("base_value")),
    "local_contributions_tree": _tree_local,
    "local_signed_top": lambda s, d: rounded(B.local_signed_top(_contributions(s, d))),
    "waterfall_data": lambda s, d: rounded(B.waterfall_data(_contributions(s, d))),
    "summary_points": lambda s, d: rounded(B.summary_points(attributions(s, d), B.global_importance(_a1(s, d)))),
    # stability
    "window_importance": lambda s, d: rounded(_importance(s, d)),
    "window_rank": lambda s, d: Z.window_rank(_importance(s, d)).select("window", "feature", "rank"),
    "window_top_k": lambda s, d: rounded(_top(s, d)),
    "jaccard_at_k": lambda s, d: rounded(Z.jaccard_at_k(_top(s, d), WINDOWS)),
    "spearman": lambda s, d: rounded(Z.spearman(_importance(s, d), WINDOWS, p_value=False)),
    "spearman_pvalue": lambda s, d: Z.spearman(_importance(s, d), WINDOWS),
    "stability_table": lambda s, d: rounded(Z.stability_table(_importance(s, d), WINDOWS, TOP_K, p_value=False)),
    "signed_summary": lambda s, d: rounded(_signed(s, d)),
    "importance_heatmap": lambda s, d: rounded(Z.importance_heatmap(Z.window_rank(_importance(s, d)), WINDOWS, TOP_K)),
    "window_group_importance": lambda s, d: rounded(Z.window_group_importance(_importance(s, d), _groups(s, d))),
    "synthesis": lambda s, d: rounded(Z.synthesis(
        _deltas(s, d), Z.stability_table(_importance(s, d), WINDOWS, TOP_K, p_value=False))),
    "feature_continuity": lambda s, d: Z.feature_continuity(_top(s, d), WINDOWS),
    "continuity_summary": lambda s, d: Z.continuity_summary(_top(s, d), WINDOWS),
    "temporary_sign_change": lambda s, d: Z.temporary_sign_change(_signed(s, d), WINDOWS),
    "findings": lambda s, d: rounded(Z.findings(_deltas(s, d), 1e-9)),
}


# --- SQL ----------------------------------------------------------------------------------------

_S1 = """WITH s AS (SELECT doc_id AS case_id, quality AS y_true, least(n_chars, 3000) / 3000.0::DOUBLE AS y_prob, source, lang,
  CASE WHEN least(n_chars, 3000) / 3000.0::DOUBLE > 0.5 THEN 1 ELSE 0 END AS y_pred
  FROM documents JOIN labels USING (doc_id))"""
_S1W = _S1 + """,
o AS (SELECT *, row_number() OVER (ORDER BY case_id) AS rn, count(*) OVER () AS n FROM s),
w AS (SELECT * EXCLUDE (rn, n), CASE WHEN rn <= n // 3 THEN 'T1' WHEN rn <= n * 2 // 3 THEN 'T2' ELSE 'T3' END AS "window" FROM o)"""
_MODELS = _S1 + """,
m AS (SELECT case_id, y_true, model, y_prob, CASE WHEN y_prob > 0.5 THEN 1 ELSE 0 END AS y_pred FROM (
  SELECT case_id, y_true, 'constant' AS model, 0.75::DOUBLE AS y_prob FROM s
  UNION ALL SELECT case_id, y_true, 'length', y_prob FROM s
  UNION ALL SELECT case_id, y_true, 'shortness', 1 - y_prob FROM s))"""


def _cum(src: str, key: str) -> str:
    return f""",
g AS (SELECT {key} AS k, y_prob, sum(y_true)::DOUBLE AS pos, sum(1 - y_true)::DOUBLE AS neg FROM {src} GROUP BY 1, 2),
c AS (SELECT *, sum(neg) OVER (PARTITION BY k ORDER BY y_prob) AS cum_neg,
  sum(pos) OVER (PARTITION BY k ORDER BY y_prob DESC) AS tp, sum(neg) OVER (PARTITION BY k ORDER BY y_prob DESC) AS fp,
  sum(pos) OVER (PARTITION BY k) AS p, sum(neg) OVER (PARTITION BY k) AS n FROM g),
r AS (SELECT k, CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(pos * (cum_neg - neg / 2)) / (max(p) * max(n)) END AS roc_auc,
  CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(pos * tp / (tp + fp)) / max(p) END AS average_precision FROM c GROUP BY k),
cf AS (SELECT {key} AS k, count(*) AS n_all, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn,
  count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn,
  count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp FROM {src} GROUP BY 1),
t AS (SELECT *, (tp + tn) / n_all AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, (tp + fn) / n_all AS prevalence FROM cf)
"""


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_WM = _S1W + _cum("w", '"window"').rstrip() + """,
st AS (SELECT "window" AS k, count(*) AS n_cases, count(*) FILTER (y_true = 1) AS success_count,
  count(*) FILTER (y_true = 0) AS unsuccessful_count, avg(y_true) AS success_rate, avg(y_prob) AS mean_probability,
  stddev_pop(y_prob) AS std_probability, median(y_prob) AS median_probability FROM w GROUP BY 1),
wm AS (SELECT st.*, r.roc_auc, r.average_precision, t.* EXCLUDE (k, n_all, prevalence) FROM st JOIN r USING (k) JOIN t USING (k))"""
_PAIRS = "(VALUES ('T1', 'T2'), ('T2', 'T3'), ('T1', 'T3')) p(a, b)"
_DELTA = _WM + """,
dl AS (SELECT p.a || '_to_' || p.b AS comparison, """ + ", ".join(
    f"round(y.{m} - x.{m}, 6) AS delta_{m}" for m in M.DELTA_METRICS) + f"""
FROM {_PAIRS} JOIN wm x ON x.k = p.a JOIN wm y ON y.k = p.b)"""

_A1_BODY = """a AS (SELECT vec_id AS case_id, 'f' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS feature, (i - 1) // 8 AS blk,
  CAST(embedding[i] AS DOUBLE) AS shap_value FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
ao AS (SELECT vec_id AS case_id, CASE WHEN row_number() OVER (ORDER BY vec_id) <= (count(*) OVER ()) // 3 THEN 'T1'
  WHEN row_number() OVER (ORDER BY vec_id) <= (count(*) OVER ()) * 2 // 3 THEN 'T2' ELSE 'T3' END AS "window" FROM embeddings),
gi AS (SELECT feature, min(blk) AS blk, avg(abs(shap_value)) AS mean_abs_shap FROM a GROUP BY feature),
gr AS (SELECT *, row_number() OVER (ORDER BY mean_abs_shap DESC, feature) AS rank,
  mean_abs_shap / sum(mean_abs_shap) OVER () AS share_of_total_importance FROM gi),
wi AS (SELECT "window", feature, min(blk) AS blk, avg(abs(shap_value)) AS mean_abs_shap, avg(shap_value) AS mean_signed_shap,
  stddev_pop(abs(shap_value)) AS std_abs_shap FROM a JOIN ao USING (case_id) GROUP BY 1, 2),
wr AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY mean_abs_shap DESC, feature) AS rank FROM wi),
tp AS (SELECT * FROM wr WHERE rank <= 10),
fl AS (SELECT feature, max(CASE WHEN "window" = 'T1' THEN 1 ELSE 0 END) AS T1, max(CASE WHEN "window" = 'T2' THEN 1 ELSE 0 END) AS T2,
  max(CASE WHEN "window" = 'T3' THEN 1 ELSE 0 END) AS T3 FROM tp GROUP BY feature),
ar AS (SELECT "window", feature, rank() OVER (PARTITION BY "window" ORDER BY mean_abs_shap)
  + (count(*) OVER (PARTITION BY "window", mean_abs_shap) - 1) / 2 AS r FROM wi),
sp AS (SELECT p.a || '_to_' || p.b AS comparison, round(corr(x.r, y.r), 6) AS spearman_rho, count(*) AS features
  FROM (VALUES ('T1', 'T2'), ('T2', 'T3'), ('T1', 'T3')) p(a, b) JOIN ar x ON x."window" = p.a
  JOIN ar y ON y."window" = p.b AND y.feature = x.feature GROUP BY 1),
jc AS (SELECT p.a || '_to_' || p.b AS comparison, p.a AS window_a, p.b AS window_b,
  (SELECT count(*) FROM tp x JOIN tp y USING (feature) WHERE x."window" = p.a AND y."window" = p.b) AS intersection_count,
  (SELECT count(DISTINCT feature) FROM tp x WHERE x."window" IN (p.a, p.b)) AS union_count
  FROM (VALUES ('T1', 'T2'), ('T2', 'T3'), ('T1', 'T3')) p(a, b)),
sg AS (SELECT feature, max(mean_abs_shap) AS max_importance, """ + ", ".join(
    f"""max(mean_signed_shap) FILTER ("window" = '{w}') AS {w}_mean_signed_shap,
  max(mean_abs_shap) FILTER ("window" = '{w}') AS {w}""" for w in WINDOWS) + """ FROM wr GROUP BY feature HAVING min(rank) <= 10),
ss AS (SELECT *, """ + ", ".join(
    f"""CASE WHEN {w}_mean_signed_shap > 1e-12 THEN 'positive' WHEN {w}_mean_signed_shap < -1e-12 THEN 'negative' ELSE 'zero' END AS {w}_sign"""
    for w in WINDOWS) + """ FROM sg),
pr AS (SELECT vec_id AS case_id, vec_id AS sample_order, label % 2 AS y_true,
  0.5 + list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS y_prob FROM embeddings),
ex AS (SELECT *, CASE WHEN y_prob > 0.5 THEN 1 ELSE 0 END AS y_pred FROM pr),
lx AS (SELECT CASE WHEN y_true = 1 AND y_pred = 1 THEN 'TP' WHEN y_true = 0 AND y_pred = 0 THEN 'TN'
  WHEN y_true = 0 THEN 'FP' ELSE 'FN' END AS category, * FROM ex),
le AS (SELECT * FROM lx QUALIFY row_number() OVER (PARTITION BY category ORDER BY sample_order) = 1),
lc AS (SELECT le.category, le.sample_order, a.case_id, a.feature, a.shap_value, abs(a.shap_value) AS abs_shap_value,
  CASE WHEN shap_value > 0 THEN 'positive' WHEN shap_value < 0 THEN 'negative' ELSE 'zero' END AS direction
  FROM a JOIN le ON le.case_id = a.case_id)"""
_A1 = "WITH " + _A1_BODY + "\n"

SQL = {
    "confusion": _S1 + _cum("s", "source") + "SELECT k AS source, tn, fp, fn, tp FROM cf",
    "threshold_metrics": _S1 + _cum("s", "source") + f"SELECT k AS source, {_r('accuracy', 'precision', 'recall', 'f1')} FROM t",
    "roc_auc": _S1 + _cum("s", "source") + f"SELECT k AS source, {_r('roc_auc')} FROM r",
    "roc_auc_overall": _S1 + _cum("s", "1") + f"SELECT {_r('roc_auc')} FROM r",
    "average_precision": _S1 + _cum("s", "source") + f"SELECT k AS source, {_r('average_precision')} FROM r",
    "roc_curve": _S1 + _cum("s", "lang") + """SELECT k AS lang, round(y_prob, 6) AS threshold,
  CASE WHEN n > 0 THEN round(fp / n, 6) END AS fpr, CASE WHEN p > 0 THEN round(tp / p, 6) END AS tpr FROM c UNION ALL SELECT DISTINCT k, 'infinity'::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM c""",
    "pr_curve": _S1 + _cum("s", "lang") + """SELECT k AS lang, round(y_prob, 6) AS threshold, round(tp / (tp + fp), 6) AS precision,
  CASE WHEN p > 0 THEN round(tp / p, 6) END AS recall, round(p / (p + n), 6) AS prevalence FROM c
UNION ALL SELECT DISTINCT k, 'infinity'::DOUBLE, 1::DOUBLE, 0::DOUBLE, round(p / (p + n), 6) FROM c""",
    "model_comparison": _MODELS + _cum("m", "model") + f"SELECT k AS model, {_r(*M.METRICS, 'prevalence')} FROM r JOIN t USING (k)",
    "metric_deltas": _MODELS + _cum("m", "model").rstrip() + ", a AS (SELECT * FROM r JOIN t USING (k))\nSELECT x.k AS model, "
    + ", ".join(f"round(x.{m} - b.{m}, 6) AS delta_{m}" for m in M.METRICS)
    + " FROM a x, a b WHERE b.k = 'constant' AND x.k <> 'constant'",
    "prediction_audit": _S1 + """
SELECT 'length' AS model, CAST(0 AS BIGINT) AS coverage_errors, CAST(0 AS BIGINT) AS label_errors,
  CAST(0 AS BIGINT) AS probability_errors, CAST(0 AS BIGINT) AS target_disagreements
UNION ALL SELECT 'partial', count(*) FILTER (lang = 'de'), 0, 0, count(*) FILTER (lang IN ('de', 'fr')) FROM s""",
    "window_metrics": _WM + ' SELECT k AS "window", n_cases, success_count, unsuccessful_count, tn, fp, fn, tp, '
    + _r("success_rate", "mean_probability", "std_probability", "median_probability", *M.METRICS) + " FROM wm",
    "window_deltas": _DELTA + " SELECT * FROM dl",
    "overall_vs_window": _S1W + _cum("w", '"window"').rstrip() + """,
al AS (SELECT k AS part, tn, fp, fn, tp FROM cf UNION ALL SELECT '(all)', CAST(sum(tn) AS BIGINT), CAST(sum(fp) AS BIGINT),
  CAST(sum(fn) AS BIGINT), CAST(sum(tp) AS BIGINT) FROM cf)
SELECT *, round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
  round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, true AS windows_add_up FROM al""",
    "sample_prediction_audit": _S1 + """, q AS (SELECT * FROM s QUALIFY row_number() OVER (ORDER BY md5('42:' || case_id), case_id) <= 100),
z AS (SELECT count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
  count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp,
  round(min(y_prob), 6) AS min_probability, round(avg(y_prob), 6) AS mean_probability, round(max(y_prob), 6) AS max_probability FROM q)
SELECT *, tn > 0 AS has_tn, fp > 0 AS has_fp, fn > 0 AS has_fn, tp > 0 AS has_tp FROM z""",
    "early_outcome_class": sql.l1("""SELECT count(*) AS early_outcome_cases, count(*) FILTER (target = 1) AS early_success,
  count(*) FILTER (target = 0) AS early_unsuccessful FROM cases WHERE valid_target AND has_k_events AND outcome_position <= 3"""),
    "check_close": _S1 + _cum("s", "lang").rstrip() + ", a AS (SELECT * FROM r JOIN t USING (k))\n" + " UNION ALL ".join(
        f"""SELECT '{p}close:{m}' AS "check", CASE WHEN x = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(x AS VARCHAR) AS observed,
  '0' AS expected FROM (SELECT count(*) FILTER (k = 'de' AND {m} IS NOT NULL) * {f} AS x FROM a)"""
        for p, f in (("", 0), ("raised:", 1)) for m in M.METRICS),
    "prior_model": enc(""", rt AS (SELECT avg(target) AS p FROM parts WHERE split = 'train')
SELECT case_id, target AS y_true, round(p, 6) AS y_prob, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS y_pred
FROM parts, rt WHERE split = 'test'"""),
    "refit_equality": enc("""
SELECT p || 'predictions' AS "check", s AS status, count(*) AS rows FROM parts, (VALUES ('', 'PASS'), ('half:', 'FAIL')) v(p, s)
WHERE split = 'test' GROUP BY p, s
UNION ALL SELECT p || 'weights', s, count(*) FROM dict, (VALUES ('', 'PASS'), ('half:', 'FAIL')) v(p, s) GROUP BY p, s"""),
    "reload_equality": enc("""
SELECT 'reloaded_predictions' AS "check", 'PASS' AS status, count(*) AS rows FROM parts WHERE split = 'test'"""),
    "tree_additivity": enc("""
SELECT 'model' AS against, count(*) AS case_count, CAST(0 AS BIGINT) AS above_1e_09, CAST(0 AS BIGINT) AS above_1e_06 FROM parts WHERE split = 'test'
UNION ALL SELECT 'moved', count(*), count(*) FILTER (case_id % 3 = 0), count(*) FILTER (case_id % 3 = 0) FROM parts WHERE split = 'test'"""),
    "class_zero_additivity": enc("""
SELECT a AS against, count(*) AS case_count, s AS status FROM parts, (VALUES ('model', 'PASS'), ('swapped', 'FAIL')) v(a, s)
WHERE split = 'test' GROUP BY a, s"""),
    "additivity_check": _A1 + """SELECT count(*) AS case_count, round(max(e), 6) AS max_error, round(avg(e), 6) AS mean_error,
  round(min(e), 6) AS min_error, round(median(e), 6) AS median_error, count(*) FILTER (e > 5e-4) AS above_5e_04,
  count(*) FILTER (e > 1e-9) AS above_1e_09
FROM (SELECT abs(sum(shap_value) + 0.5 - any_value(y_prob) - case_id % 5 * 1e-3) AS e FROM a JOIN pr USING (case_id) GROUP BY case_id)""",
    "class_axis": enc("""
SELECT count(*) AS cases, CAST(0 AS BIGINT) AS sums_off, CAST(0 AS BIGINT) AS positive_off FROM parts WHERE split = 'test'"""),
    "attribution_coverage": enc("""
SELECT CAST(ceil(c / 1000.0) AS BIGINT) AS batches, c AS cases, f AS features, c * f AS cells, CAST(0 AS BIGINT) AS above_1e_09
FROM (SELECT count(*) AS c FROM parts WHERE split = 'test'), (SELECT count(*) AS f FROM dict)"""),
    "model_properties": enc("""
SELECT 'gradient_vanishes' AS property, true AS holds, count(*) AS rows FROM parts WHERE split = 'train'
UNION ALL SELECT 'importance_sums_to_one', true, count(*) FROM dict
UNION ALL SELECT m || '_probabilities', true, count(*) FROM parts, (VALUES ('logistic'), ('forest')) v(m) WHERE split = 'test' GROUP BY m"""),
    "stored_predictions_audit": _S1 + """
SELECT count(*) + count(*) FILTER (case_id % 13 = 0) AS cases, count(*) FILTER (case_id % 11 = 0) AS not_stored,
  count(*) FILTER (case_id % 13 = 0) AS not_recomputed, count(*) FILTER (case_id % 11 <> 0 AND case_id % 7 = 0) AS label_differences,
  count(*) FILTER (case_id % 11 <> 0 AND case_id % 5 = 0) AS probability_differences FROM s""",
    "attribution_numeric": _A1 + """SELECT count(*) AS values, round(min(shap_value), 6) AS min_value, round(max(shap_value), 6) AS max_value,
  round(avg(abs(shap_value)), 6) AS mean_abs_value, count(*) FILTER (isnan(shap_value)) AS nan_values,
  count(*) FILTER (isinf(shap_value)) AS infinite_values FROM a""",
    "global_importance": _A1 + "SELECT rank, feature, " + _r("mean_abs_shap", "share_of_total_importance") + " FROM gr",
    "feature_groups": _A1 + """SELECT feature, 'block::' || blk AS source_group, 'Group' || blk AS "group", true AS name_matches FROM gi""",
    "feature_group_counts": _A1 + """SELECT 'Group' || blk AS "group", count(*) AS feature_count FROM gi GROUP BY blk""",
    "group_importance": _A1 + """SELECT 'Group' || blk AS "group", count(*) AS feature_count,
  round(sum(mean_abs_shap), 6) AS group_total_importance, round(sum(share_of_total_importance), 6) AS share_of_total_importance,
  round(avg(mean_abs_shap), 6) AS group_mean_importance_per_feature FROM gr GROUP BY blk""",
    "local_examples": _A1 + "SELECT category, sample_order, case_id, y_true, y_pred, round(y_prob, 6) AS y_prob FROM le",
    "local_contributions": _A1 + "SELECT category, sample_order, case_id, feature, direction, "
    + _r("shap_value", "abs_shap_value") + " FROM lc",
    "local_signed_top": _A1 + """SELECT category, direction, rank, feature, round(shap_value, 6) AS shap_value FROM
  (SELECT *, row_number() OVER (PARTITION BY category, direction ORDER BY abs_shap_value DESC, feature) AS rank FROM lc
   WHERE direction <> 'zero') WHERE rank <= 5""",
    "waterfall_data": "WITH " + _A1_BODY + """,
wk AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY abs_shap_value DESC, feature) AS rk FROM lc),
ws AS (SELECT category, least(rk, 15) AS step, CASE WHEN least(rk, 15) < 15 THEN max(feature) ELSE '(rest)' END AS feature,
  sum(shap_value) AS contribution FROM wk GROUP BY category, least(rk, 15))
SELECT category, step, feature, round(contribution, 6) AS contribution, 0.5::DOUBLE AS base_value,
  round(0.5 + sum(contribution) OVER (PARTITION BY category ORDER BY step), 6) AS running_total FROM ws""",
    "summary_points": _A1 + """SELECT case_id, feature, round(shap_value, 6) AS shap_value FROM a
WHERE feature IN (SELECT feature FROM gr WHERE rank <= 20)""",
    "window_importance": _A1 + 'SELECT "window", feature, ' + _r("mean_abs_shap", "mean_signed_shap", "std_abs_shap") + " FROM wi",
    "window_rank": _A1 + 'SELECT "window", feature, rank FROM wr',
    "window_top_k": _A1 + 'SELECT "window", rank, feature, ' + _r("mean_abs_shap", "mean_signed_shap") + " FROM tp",
    "jaccard_at_k": _A1 + "SELECT *, round(intersection_count / union_count, 6) AS jaccard FROM jc",
    "spearman": _A1 + "SELECT * FROM sp",
    "stability_table": _A1 + """SELECT jc.*, round(intersection_count / union_count, 6) AS jaccard, spearman_rho, features, 10 AS top_k
FROM jc JOIN sp USING (comparison)""",
    "signed_summary": _A1 + "SELECT feature, " + _r("max_importance", *[f"{w}_mean_signed_shap" for w in WINDOWS])
    + ", T1_sign, T2_sign, T3_sign, T1_sign <> T2_sign AS sign_change_T1_T2, T2_sign <> T3_sign AS sign_change_T2_T3, "
    "T1_sign <> T3_sign AS sign_change_T1_T3 FROM ss",
    "importance_heatmap": _A1 + "SELECT feature, " + _r(*WINDOWS) + " FROM sg",
    "window_group_importance": _A1 + """SELECT "window", 'Group' || blk AS "group", count(*) AS feature_count,
  round(sum(mean_abs_shap), 6) AS group_total_importance, round(avg(mean_abs_shap), 6) AS group_mean_importance_per_feature,
  round(sum(mean_abs_shap) / any_value(tot), 6) AS share_of_total_importance
FROM (SELECT *, sum(mean_abs_shap) OVER (PARTITION BY "window") AS tot FROM wi) GROUP BY "window", blk""",
    "synthesis": _DELTA + ", " + _A1_BODY.replace("\na AS", "\na AS") + """
SELECT dl.*, window_a, window_b, round(intersection_count / union_count, 6) AS jaccard, spearman_rho,
  intersection_count AS top_intersection_count, union_count AS top_union_count
FROM dl JOIN jc USING (comparison) JOIN sp USING (comparison)""",
    "feature_continuity": _A1 + """SELECT *, T1 = 1 AND T2 = 1 AND T3 = 1 AS in_all_windows, T1 = 0 AND T2 = 1 AS "enters_T2",
  T1 = 1 AND T2 = 0 AS "leaves_T2", T2 = 0 AND T3 = 1 AS "enters_T3", T2 = 1 AND T3 = 0 AS "leaves_T3" FROM fl""",
    "continuity_summary": _A1 + """SELECT count(*) AS union_count, count(*) FILTER (T1 = 1 AND T2 = 1 AND T3 = 1) AS all_window_count,
  count(*) FILTER (T1 = 0 AND T2 = 1) AS "entering_T2", count(*) FILTER (T2 = 0 AND T3 = 1) AS "entering_T3",
  count(*) FILTER (T1 = 1 AND T2 = 0) AS "leaving_T2", count(*) FILTER (T2 = 1 AND T3 = 0) AS "leaving_T3",
  count(*) FILTER (T1 <> T3) = 0 AS first_last_identical FROM fl""",
    "temporary_sign_change": _A1 + "SELECT feature, T1_sign, T2_sign, T3_sign FROM ss WHERE T1_sign = T3_sign AND T2_sign <> T1_sign",
    "findings": _DELTA + " " + " UNION ALL ".join(
        f"""SELECT comparison, '{m}' AS measure, delta_{m} AS delta,
  CASE WHEN delta_{m} IS NULL THEN 'undefined' WHEN delta_{m} > 1e-9 THEN 'rose' WHEN delta_{m} < -1e-9 THEN 'fell' ELSE 'unchanged' END AS direction FROM dl"""
        for m in M.DELTA_METRICS),
}
