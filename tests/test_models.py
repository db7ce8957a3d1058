import glob
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tracewell.operators import attribution as B
from tracewell.operators import exact_forest as X
from tracewell.operators import encode as N
from tracewell.operators import models as K
from tracewell.session import scratch_path

SPEC = N.EncodeSpec(["amount"], ["color"], {"act_counts": "act"})


def features(spark, rows):
    return spark.createDataFrame(rows, "case_id int, target int, amount double, color string, act_counts map<string,long>")


TRAIN = [(1, 1, 2.0, "red", {"x": 2, "y": 1}), (2, 0, 4.0, "blue", {"x": 3}), (3, 1, 9.0, "red", {"x": 1, "y": 2})]
TEST = [(4, 1, 5.0, "green", {"x": 1, "z": 2}), (5, 0, 0.0, "blue", {"y": 3})]


def test_vocabulary_ignores_the_test_rows(spark):
    train, test = features(spark, TRAIN), features(spark, TEST)
    dic = [tuple(r) for r in N.vocabulary_fit(train, SPEC).orderBy("feature_index").collect()]
    assert [d[1] for d in dic] == ["amount", "color_blue", "color_red", "act::x", "act::y"]
    assert [d[0] for d in dic] == list(range(5))
    audit = {r.source_group: r for r in N.unknown_audit(train, test, SPEC).collect()}
    assert (audit["categorical::color"].test_only_count, audit["categorical::color"].test_rows_affected) == (1, 1)
    assert (audit["structured_map::act"].test_only_count, audit["structured_map::act"].test_rows_affected) == (1, 1)


def test_vector_equals_long_cells(spark):
    train, test = features(spark, TRAIN), features(spark, TEST)
    dic = N.frozen_dictionary(N.vocabulary_fit(train, SPEC))
    vec = {r.case_id: r.x for r in N.assemble(test, dic, SPEC, ["case_id"]).select(
        "case_id", vector_to_array("features").alias("x")).collect()}
    long = {4: [0.0] * 5, 5: [0.0] * 5}
    for r in N.encode_tree(test, dic, SPEC).collect():
        long[r.case_id][r.feature_index] = r.value
    assert vec == long == {4: [5.0, 0.0, 0.0, 1.0, 0.0], 5: [0.0, 1.0, 0.0, 0.0, 3.0]}


def test_a_null_numeric_value_is_an_error_in_both_forms(spark):
    train = features(spark, TRAIN)
    dic = N.frozen_dictionary(N.vocabulary_fit(train, SPEC))
    holed = features(spark, [(9, 1, None, "red", {"x": 1})])
    for df in (N.encode_tree(holed, dic, SPEC), N.assemble(holed, dic, SPEC, ["case_id"])):
        with pytest.raises(Exception, match="null"):
            df.collect()


def test_partial_layouts(spark):
    train = features(spark, TRAIN)
    for spec, width in ((N.EncodeSpec(["amount"], [], {}), 1), (N.EncodeSpec([], ["color"], {}), 2),
                        (N.EncodeSpec([], [], {"act_counts": "act"}), 2)):
        dic = N.vocabulary_fit(train, spec)
        assert dic.count() == width
        assert {r.feature_index for r in N.encode_tree(train, dic, spec).collect()} == set(range(width))


def test_large_dictionary_joins_by_shuffle(spark, monkeypatch):
    import tracewell.functions.tables as tables

    train = features(spark, TRAIN)
    dic = N.vocabulary_fit(train, SPEC)
    small = sorted(map(tuple, N.encode_tree(train, dic, SPEC).collect()))
    monkeypatch.setattr(tables, "MAX_BROADCAST_ROWS", 1)
    assert sorted(map(tuple, N.encode_tree(train, dic, SPEC).collect())) == small


def test_scaling_uses_population_variance_and_guards_constants(spark):
    train = features(spark, TRAIN)
    got = {r.case_id: r.amount for r in N.scale_numeric(train, train, ["amount"]).collect()}
    v = np.array([2.0, 4.0, 9.0])
    assert np.allclose([got[1], got[2], got[3]], (v - v.mean()) / v.std())
    same = train.withColumn("amount", F.lit(7.0))
    assert {r.amount for r in N.scale_numeric(same, same, ["amount"]).collect()} == {0.0}


def test_constant_features_are_reported(spark):
    train = features(spark, [(1, 1, 3.0, "red", {"x": 1}), (2, 0, 3.0, "red", {"x": 1, "y": 2})])
    dic = N.vocabulary_fit(train, SPEC)
    got = N.constant_features(N.encode_tree(train, dic, SPEC), train, dic).collect()
    assert {r.feature_name for r in got} == {"amount", "color_red", "act::x"}


def test_map_validate(spark):
    bad = features(spark, [(1, 1, 0.0, "a", {"": 3}), (2, 1, 0.0, "a", {"x": -1, "y": 4}), (3, 1, 0.0, "a", {"won": 1})])
    r = N.map_validate(bad, {"act_counts": "act"}, ["won"], 3).first()
    assert (r.bad_keys, r.bad_counts, r.bad_totals, r.outcome_keys) == (1, 1, 1, 1)


@pytest.fixture(scope="module")
def four(spark):
    """Four features, a target from two of them with noise."""
    rng = np.random.default_rng(0)
    x = np.round(rng.random((300, 4)), 3)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)) ^ (rng.random(300) < 0.1)
    df = spark.createDataFrame([(i, int(t), [float(c) for c in r]) for i, (r, t) in enumerate(zip(x, y))],
                               "case_id int, target int, x array<double>").withColumn("features", array_to_vector("x"))
    dic = spark.createDataFrame([(i, f"f{i}", "numeric") for i in range(4)],
                                "feature_index long, feature_name string, source_group string")
    return df.cache(), dic


def test_logistic_gradient_vanishes(four):
    df, dic = four
    model = K.fit_logistic(df, c=1.0)
    w, b = model.coefficients.toArray(), model.intercept
    rows = df.collect()
    x, y = np.array([r.x for r in rows]), np.array([r.target for r in rows])
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + w).max() < 1e-3 and abs((p - y).sum()) < 1e-3
    assert K.coefficient_signs(K.logistic_coefficients(model, dic)).first().zero == 0


def test_predict_and_prior(spark, four):
    df, _ = four
    model = K.fit_forest(df, num_trees=5, max_depth=4)
    for r in K.predict(model, df).collect():
        assert 0 <= r.y_prob <= 1 and r.y_pred == int(r.y_prob > 0.5)
    tie = spark.createDataFrame([(1, 0), (2, 1)], "case_id int, target int")
    assert {(r.y_prob, r.y_pred) for r in K.prior_model(tie, tie).collect()} == {(0.5, 0)}


def brute_shapley(f, x, background):
    """Average marginal contribution over all feature orders, per background row."""
    n = len(x)
    phi = np.zeros(n)
    for b in background:
        for order in itertools.permutations(range(n)):
            z = b.copy()
            last = f(z)
            for j in order:
                z[j] = x[j]
                now = f(z)
                phi[j] += now - last
                last = now
    return phi / (len(background) * math.factorial(n))


def test_forest_shapley_equals_brute_force(four):
    df, _ = four
    model = K.fit_forest(df, num_trees=6, max_depth=6)
    leaves = B.forest_trees(model)
    x = np.array([r.x for r in df.orderBy("case_id").limit(12).collect()])
    rows, bg = x[:4], x[4:]
    got = B.forest_shapley(leaves, 6, rows, bg)
    for i, r in enumerate(rows):
        for label in (0, 1):
            want = brute_shapley(lambda z: B.forest_probability(leaves, 6, z[None, :])[0, label], r, bg)
            assert np.abs(got[i, :, label] - want).max() < 1e-12


def test_tree_attribution_adds_up(spark, four):
    df, dic = four
    model = K.fit_forest(df, num_trees=8, max_depth=8)
    e = B.ForestExplainer.build(model, df.limit(40))
    out = B.tree_attribution(e, df, dic)
    assert out.count() == 300 * 4
    r = B.additivity_check(out, K.predict(model, df)).first()
    assert r.case_count == 300 and r.max_error < 1e-9 and r.above_1e_09 == 0
    both = B.tree_attribution(e, df, dic, labels=(0, 1))
    assert both.count() == 300 * 4 * 2
    other = both.filter("label = 0")
    assert B.class_zero_additivity(out, other, K.predict(model, df)).first().status == "PASS"


def test_blocks_do_not_change_values(four, monkeypatch):
    df, _ = four
    leaves = B.forest_trees(K.fit_forest(df, num_trees=3, max_depth=5))
    x = np.array([r.x for r in df.collect()])
    whole = B.forest_shapley(leaves, 3, x, x[:20])
    monkeypatch.setattr(B, "ROWS_PER_BLOCK", 7)
    assert np.allclose(B.forest_shapley(leaves, 3, x, x[:20]), whole, atol=0, rtol=0)


def _batches(spark, four, trees=3):
    df, dic = four
    model = K.fit_forest(df, num_trees=trees, max_depth=4)
    data = df.filter("case_id < 95").withColumn("sample_order", F.col("case_id").cast("long"))
    return model, B.ForestExplainer.build(model, df.limit(10)), data, dic, scratch_path(spark, "resume")


def _entries(spark, path):
    return spark.read.parquet(*glob.glob(f"{path}/*/ledger"))


def test_batches_resume(spark, four):
    model, e, data, dic, path = _batches(spark, four)
    first = B.attribution_batches(e, data.filter("case_id < 50"), dic, path, 25)
    seconds = {r.case_id: r.seconds for r in first.collect()}
    again = B.attribution_batches(e, data, dic, path, 25)
    rows = again.collect()
    assert len(rows) == 95 * 4 and len({r.case_id for r in rows}) == 95
    assert all(r.seconds == seconds[r.case_id] for r in rows if r.case_id < 50)  # not computed again
    assert _entries(spark, path).count() == 4
    assert B.batch_runtime(again).first().batches == 4
    # a smaller input gives its own batches only
    assert {r.case_id for r in B.attribution_batches(e, data.filter("case_id < 25"), dic, path, 25).collect()} == set(range(25))


def test_batches_of_another_model_or_background_are_not_reused(spark, four):
    df, _ = four
    model, e, data, dic, path = _batches(spark, four)
    B.attribution_batches(e, data, dic, path, 25)
    other = K.fit_forest(df, num_trees=3, max_depth=3)
    for m, x in ((other, B.ForestExplainer.build(other, df.limit(10))), (model, B.ForestExplainer.build(model, df.filter("case_id > 200")))):
        out = B.attribution_batches(x, data, dic, path, 25)
        assert B.additivity_check(out, K.predict(m, data)).first().max_error < 1e-9


def test_batches_follow_a_changed_and_a_reverted_input(spark, four):
    model, e, data, dic, path = _batches(spark, four)
    before = {(r.case_id, r.feature): r.shap_value for r in B.attribution_batches(e, data, dic, path, 25).collect()}
    changed = data.withColumn("x", F.transform("x", lambda v: 1 - v)).withColumn("features", array_to_vector("x"))
    out = B.attribution_batches(e, changed, dic, path, 25)
    assert B.additivity_check(out, K.predict(model, changed)).first().max_error < 1e-9
    after = {(r.case_id, r.feature): r.shap_value for r in B.attribution_batches(e, data, dic, path, 25).collect()}
    assert after == before


def test_a_batch_that_does_not_add_up_is_not_done(spark, four):
    from dataclasses import replace

    from tracewell.operators.contracts import ContractError

    _, e, data, dic, path = _batches(spark, four)
    broken = replace(e)
    broken.__dict__["base_values"] = e.base_values + 0.01
    with pytest.raises(ContractError, match="do not add up"):
        B.attribution_batches(broken, data, dic, path, 25)
    assert B.attribution_batches(e, data, dic, path, 25).select("case_id").distinct().count() == 95



def test_thousands_of_rows_take_one_walk(monkeypatch):
    """A leaf is worked out once for all rows of a block, and a row's values are the same to the bit in any company."""
    rng, seen = np.random.default_rng(2), []
    x = rng.integers(0, 12, (3000, 5)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] * x[:, 2] > 30)).astype(float)
    nodes = list(X.grow(0, X.root_of(1, 0), 0, x, y, np.ones(3000), 3, 8))
    frame = pd.concat([pd.DataFrame(level) for level in nodes])
    trees = B._trees(X._pack(5)(frame))
    monkeypatch.setattr(B, "_leaf_values", lambda *a, real=B._leaf_values: seen.append(1) or real(*a))
    whole = B.forest_shapley(trees, 1, x, x[:50])
    assert 50 < len(seen) <= len(trees)
    assert np.array_equal(B.forest_shapley(trees, 1, x[17:29], x[:50]), whole[17:29])
    gap = whole.sum(1) + B.forest_probability(trees, 1, x[:50]).mean(0) - B.forest_probability(trees, 1, x)
    assert np.abs(gap).max() < 1e-12


def test_refit_and_reload(spark, four):
    df, dic = four
    fit = lambda d: K.fit_forest(d, num_trees=4, max_depth=4)
    assert {r.status for r in K.refit_equality(fit, df, df, dic).collect()} == {"PASS"}
    assert {r.status for r in K.refit_equality(K.fit_logistic, df, df, dic).collect()} == {"PASS"}
    assert K.reload_equality(fit(df), scratch_path(spark, "m"), df).first().status == "PASS"
    s = K.forest_structure(fit(df), spark).first()
    assert s.trees == 4 and s.depth_max <= 4 and s.leaves_min >= 2


def test_a_stored_forest_is_explained_by_chunks(spark, four, monkeypatch):
    """The forest stays in a table: no task and no driver holds all trees, and the values still add up."""
    from tracewell.operators import exact_forest as X

    df, dic = four
    model = K.fit_stored_forest(df, num_trees=6, max_depth=6)
    monkeypatch.setattr(X, "MAX_SENT_NODES", 60)
    monkeypatch.setattr(B, "STORED_BLOCK", 90)
    e = B.StoredExplainer.build(model, df.limit(20))
    assert len(X.tree_chunks(model)) > 2
    both = B.tree_attribution(e, df, dic, labels=(0, 1)).cache()
    one, other = both.filter("label = 1"), both.filter("label = 0")
    p = K.predict(model, df)
    assert both.count() == 300 * 4 * 2 and B.additivity_check(one, p).first().max_error < 1e-9
    assert B.class_zero_additivity(one, other, p).first().status == "PASS"
    x = np.array([r.x for r in df.orderBy("case_id").collect()])
    whole = B.forest_shapley(B._trees(model.packed.toPandas()), 6, x, e.background)
    got = {(r.case_id, r.feature): r.shap_value for r in one.collect()}
    names = {r.feature_index: r.feature_name for r in dic.collect()}
    for i, r in enumerate(df.orderBy("case_id").collect()):
        assert all(abs(got[r.case_id, names[f]] - whole[i, f, 1]) < 1e-12 for f in range(4))
    path = scratch_path(spark, "stored")
    data = df.filter("case_id < 95").withColumn("sample_order", F.col("case_id").cast("long"))
    rows = B.attribution_batches(e, data, dic, path, 25).collect()
    assert len(rows) == 95 * 4 and all(abs(r.shap_value - got[r.case_id, r.feature]) < 1e-12 for r in rows)
    assert {r.status for r in K.refit_equality(lambda d: K.fit_stored_forest(d, 3, 4), df, df, dic).collect()} == {"PASS"}
    assert K.reload_equality(model, scratch_path(spark, "stored-model"), df).first().status == "PASS"
