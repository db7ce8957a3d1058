import math
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from tracewell.functions.pvalue import correlation_pvalue
from tracewell.operators import metrics as M
from tracewell.operators import stability as Z
from tracewell.operators.contracts import ContractError


def scored(spark, n=400, seed=3):
    """Heavy ties and one group with most rows."""
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < 0.7 else "cold", int(rng.random() < 0.6), rng.choice([0.1, 0.5, 0.5, 0.9, rng.random()]))
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "case_id int, g string, y_true int, y_prob double").withColumn(
        "y_pred", (F.col("y_prob") > 0.5).cast("int"))


def brute_auc(rows):
    pos = [r[3] for r in rows if r[2] == 1]
    neg = [r[3] for r in rows if r[2] == 0]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def brute_ap(rows):
    total = sum(r[2] for r in rows)
    ap, last = 0.0, 0.0
    for t in sorted({r[3] for r in rows}, reverse=True):
        chosen = [r for r in rows if r[3] >= t]
        tp = sum(r[2] for r in chosen)
        ap += (tp / total - last) * tp / len(chosen)
        last = tp / total
    return ap


def test_ranking_metrics_equal_brute_force(spark):
    rows, df = scored(spark)
    got = {r.g: r for r in M.ranking_metrics(df, ["g"]).collect()}
    for g in ("hot", "cold"):
        part = [r for r in rows if r[1] == g]
        assert math.isclose(got[g].roc_auc, brute_auc(part), abs_tol=1e-12)
        assert math.isclose(got[g].average_precision, brute_ap(part), abs_tol=1e-12)
    whole = M.ranking_metrics(df).first()
    assert math.isclose(whole.roc_auc, brute_auc(rows), abs_tol=1e-12)


def test_auc_equals_spark_evaluator(spark):
    _, df = scored(spark)
    ev = BinaryClassificationEvaluator(rawPredictionCol="y_prob", labelCol="y_true", numBins=0)
    assert math.isclose(M.roc_auc(df).first()[0], ev.evaluate(df.withColumn("y_true", F.col("y_true").cast("double"))), abs_tol=1e-9)


def test_constant_score_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5)], "y_true int, y_prob double")
    r = M.ranking_metrics(df).first()
    assert r.roc_auc == 0.5 and math.isclose(r.average_precision, 2 / 3)
    only = df.filter("y_true = 1")
    assert M.ranking_metrics(only).first().roc_auc is None
    assert [p.fpr for p in M.roc_curve(only).collect() if not math.isinf(p.threshold)] == [None]


def test_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y_true int, y_pred int")
    r = M.threshold_metrics(df).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (1.0, 0.0, 0.0, 0.0)


def test_strict_windows_refuse_one_class(spark):
    df = spark.createDataFrame([("T1", 1, 1, 0.9), ("T1", 0, 0, 0.1), ("T2", 1, 1, 0.9)],
                               "window string, y_true int, y_pred int, y_prob double")
    with pytest.raises(ContractError):
        M.window_metrics(df, strict=True)
    got = {r.window: r for r in M.window_metrics(df).collect()}
    assert got["T1"].roc_auc == 1.0 and got["T2"].roc_auc is None


def test_window_confusions_add_up(spark):
    _, df = scored(spark)
    got = {r.part: r for r in M.overall_vs_window(df, "g").collect()}
    for c in M.CELLS:
        assert got["(all)"][c] == got["hot"][c] + got["cold"][c]
    assert all(r.windows_add_up for r in got.values())


# Published example values of three windows: metrics, their differences, and the stability of the
# ten leading features.
WINDOW_ROWS = [
    ("T1", 0.55544933078393877, 0.55776449968132569, 0.57777700664408793, 0.63406664398557222, 0.55544933078393877, 0.59034267912772587, 0.65232358003442337, 0.61978740801308263),
    ("T2", 0.55258126195028678, 0.55184512428298282, 0.57763240099961544, 0.62199791333975196, 0.56596558317399615, 0.59825673534072898, 0.65311418685121103, 0.62448304383788256),
    ("T3", 0.54110898661567874, 0.54763065646908859, 0.60730224896937568, 0.63556943295073831, 0.5822179732313576, 0.60436893203883491, 0.65989399293286222, 0.63091216216216217),
]
DELTA_ROC = {"T1_to_T2": -0.00014460564447249524, "T2_to_T3": 0.029669847969760244, "T1_to_T3": 0.029525242325287748}
DELTA_F1 = {"T1_to_T2": 0.0046956358247999264, "T2_to_T3": 0.0064291183242796146, "T1_to_T3": 0.011124754149079541}
TOP_TEN = {
    "T1": ["requested_amount", "mean_event_gap_seconds", "prefix_duration_seconds", "resource::User_1",
           "activity::A_Submitted", "activity::W_Handle leads", "loan_goal_Home improvement", "n_unique_resources",
           "loan_goal_Car", "application_type_New credit"],
    "T2": ["requested_amount", "mean_event_gap_seconds", "prefix_duration_seconds", "resource::User_1",
           "activity::A_Submitted", "activity::W_Handle leads", "n_unique_resources", "loan_goal_Home improvement",
           "application_type_New credit", "application_type_Limit raise"],
    "T3": ["requested_amount", "mean_event_gap_seconds", "prefix_duration_seconds", "activity::A_Submitted",
           "resource::User_1", "activity::W_Handle leads", "n_unique_resources", "loan_goal_Home improvement",
           "loan_goal_Car", "application_type_New credit"],
}
JACCARD = {"T1_to_T2": 9 / 11, "T2_to_T3": 9 / 11, "T1_to_T3": 1.0}
RHO_P = [(0.97285203630238348, 1.6098082545002068e-105), (0.97363496995038201, 1.5299966459737541e-106),
         (0.95695912160511254, 1.7348811731005127e-89)]
NAMES = ["T1", "T2", "T3"]


def test_published_deltas(spark):
    metrics = spark.createDataFrame(WINDOW_ROWS, "window string, " + ", ".join(f"{m} double" for m in M.DELTA_METRICS))
    deltas = M.window_deltas(metrics, NAMES)
    got = {r.comparison: r for r in deltas.collect()}
    for c in DELTA_ROC:
        assert math.isclose(got[c].delta_roc_auc, DELTA_ROC[c], abs_tol=1e-15)
        assert math.isclose(got[c].delta_f1, DELTA_F1[c], abs_tol=1e-15)
    facts = {(r.comparison, r.measure): r.direction for r in Z.findings(deltas).collect()}
    assert facts["T1_to_T2", "success_rate"] == facts["T2_to_T3", "success_rate"] == "fell"
    assert facts["T1_to_T2", "average_precision"] == "fell" and facts["T2_to_T3", "average_precision"] == "rose"


def top_table(spark):
    rows = [(w, i + 1, f) for w, fs in TOP_TEN.items() for i, f in enumerate(fs)]
    return spark.createDataFrame(rows, "window string, rank int, feature string")


def test_published_overlap_and_continuity(spark):
    got = {r.comparison: r.jaccard for r in Z.jaccard_at_k(top_table(spark), NAMES).collect()}
    assert got == JACCARD
    c = Z.continuity_summary(top_table(spark), NAMES).first()
    assert (c.union_count, c.all_window_count, c.first_last_identical) == (11, 9, True)
    flags = {r.feature: r for r in Z.feature_continuity(top_table(spark), NAMES).collect()}
    assert flags["application_type_Limit raise"].enters_T2 and flags["loan_goal_Car"].leaves_T2


def test_published_p_values():
    for rho, p in RHO_P:
        assert math.isclose(correlation_pvalue(rho, 165), p, rel_tol=1e-6)
    assert math.isclose(correlation_pvalue(0.0, 10), 1.0)


def test_temporary_sign_change(spark):
    rows = [("a", w, 1.0, s, 1) for w, s in zip(NAMES, (-1.0, 2.0, -3.0))] + [("b", w, 0.5, 1.0, 2) for w in NAMES]
    ranked = spark.createDataFrame(rows, "feature string, window string, mean_abs_shap double, mean_signed_shap double, rank int")
    signed = Z.signed_summary(ranked, NAMES, 10)
    assert [r.feature for r in Z.temporary_sign_change(signed, NAMES).collect()] == ["a"]
    r = signed.filter("feature = 'a'").first()
    assert r.sign_change_T1_T2 and r.sign_change_T2_T3 and not r.sign_change_T1_T3


def test_spearman_with_ties(spark):
    rows = [(w, f"f{i}", v) for w, vs in {"T1": [1, 2, 2, 4], "T2": [4, 3, 3, 1]}.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame([(w, f, float(v)) for w, f, v in rows], "window string, feature string, mean_abs_shap double")
    r = Z.spearman(df, ["T1", "T2"]).first()
    assert math.isclose(r.spearman_rho, -1.0) and r.spearman_pvalue < 1e-6
