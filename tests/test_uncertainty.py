import math
import random

import numpy as np
import pytest

from tracewell.operators.uncertainty import auc_changes, auc_differences, auc_intervals, placements


def definition(pos, neg):
    """Area and placements by looking at every pair."""
    psi = np.array([[1.0 if x > y else 0.5 if x == y else 0.0 for y in neg] for x in pos])
    return psi.mean(), psi.mean(1), psi.mean(0)


def variance(pos, neg):
    _, v10, v01 = definition(pos, neg)
    return v10.var(ddof=1) / len(pos) + v01.var(ddof=1) / len(neg)


def _rows(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        base = rng.gauss(0.8 * y, 1)
        rows.append((i, rng.choice(["T1", "T1", "T2", "T3"]), y, round(base, 1), round(0.6 * base + 0.8 * rng.gauss(0.3 * y, 1), 1)))  # rounded: many ties
    return rows


def _groups(rows, col):
    return {w: ([r[col] for r in rows if r[1] == w and r[2] == 1], [r[col] for r in rows if r[1] == w and r[2] == 0]) for w in {r[1] for r in rows}}


def test_intervals_equal_the_definition_over_pairs(spark):
    rows = _rows()
    df = spark.createDataFrame([(i, w, y, float(p)) for i, w, y, p, _ in rows], "case_id long, window string, y_true int, y_prob double")
    found = {r.window: r for r in auc_intervals(df, ["window"]).collect()}
    for w, (pos, neg) in _groups(rows, 3).items():
        area, se = definition(pos, neg)[0], math.sqrt(variance(pos, neg))
        r = found[w]
        assert (r.positives, r.negatives) == (len(pos), len(neg))
        assert np.allclose([r.roc_auc, r.standard_error], [area, se], atol=1e-12)
        assert np.allclose([r.lower, r.upper], [max(area - 1.959963984540054 * se, 0), min(area + 1.959963984540054 * se, 1)], atol=1e-12)
    changes = {r.comparison: r for r in auc_changes(df, ["T1", "T2", "T3"]).collect()}
    assert set(changes) == {"T1_to_T2", "T2_to_T3", "T1_to_T3"}
    c = changes["T1_to_T2"]
    assert math.isclose(c.variance, variance(*_groups(rows, 3)["T1"]) + variance(*_groups(rows, 3)["T2"]), abs_tol=1e-12)
    assert c.finding == ("rose" if c.lower > 0 else "fell" if c.upper < 0 else "no change shown")


def test_placements_are_weighted_by_distinct_scores(spark):
    df = spark.createDataFrame([(1, 0.5)] * 700 + [(0, 0.5)] * 200 + [(0, 0.1)] * 100, "y_true int, y_prob double")
    t = {r.y_prob: r for r in placements(df).collect()}
    assert len(t) == 2 and math.isclose(t[0.5].pos_placement, (100 + 100) / 300) and math.isclose(t[0.1].neg_placement, 1.0)


def test_differences_of_paired_models_equal_the_definition(spark):
    rows = _rows(seed=4)
    long = [(i, w, m, y, float(p)) for i, w, y, a, b in rows for m, p in (("a", a), ("b", b), ("minus a", -a))]
    df = spark.createDataFrame(long, "case_id long, window string, model string, y_true int, y_prob double")
    found = {(r.window, r.model_a, r.model_b): r for r in auc_differences(df, ["a", "b", "minus a"], ["window"]).collect()}
    assert len(found) == 9
    for w in ("T1", "T2", "T3"):
        pa, na = _groups(rows, 3)[w]
        pb, nb = _groups(rows, 4)[w]
        (aa, a10, a01), (ab, b10, b01) = definition(pa, na), definition(pb, nb)
        cov = np.cov(a10, b10)[0, 1] / len(pa) + np.cov(a01, b01)[0, 1] / len(na)
        var = variance(pa, na) + variance(pb, nb) - 2 * cov
        r = found[w, "a", "b"]
        assert np.allclose([r.roc_auc_a, r.roc_auc_b, r.covariance, r.variance, r.z], [aa, ab, cov, var, (ab - aa) / math.sqrt(var)], atol=1e-9)
        turned = found[w, "a", "minus a"]
        assert math.isclose(turned.roc_auc_b, 1 - aa, abs_tol=1e-12) and math.isclose(turned.covariance, -variance(pa, na), abs_tol=1e-9)


@pytest.mark.parametrize("labels", [[], [1], [1, 1], [1, 0], [0, 0, 0]])
def test_too_few_cases_have_no_interval(spark, labels):
    df = spark.createDataFrame([(i, y, 0.1 * i) for i, y in enumerate(labels)], "case_id long, y_true int, y_prob double")
    r = auc_intervals(df).first()
    assert (r.positives, r.negatives) == (sum(labels), len(labels) - sum(labels))
    assert r.standard_error is None and r.lower is None and r.upper is None


def test_a_case_that_one_model_did_not_score_is_left_out(spark):
    rows = [(i, m, i % 2, (i * 7 % 11) / 11) for i in range(20) for m in "ab" if not (m == "b" and i == 4)]
    r = auc_differences(spark.createDataFrame(rows, "case_id long, model string, y_true int, y_prob double"), ["a", "b"]).first()
    assert (r.positives, r.negatives) == (10, 9)
