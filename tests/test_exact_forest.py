import random

import numpy as np
import pytest
import xxhash
from pyspark.ml.linalg import Vectors

from tracewell.operators import exact_forest as X


def _data(n=200, features=5, seed=1, values=12):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [float(rng.randrange(values)) / 4 for _ in range(features - 1)] + [1.0]  # the last feature is constant
        y = int((x[0] > 1) ^ (x[1] + rng.random() > 2))
        rows.append((i, y, Vectors.dense(x)))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, ["case_id", "target", "features"])


def brute_tree(rows, seed, tree, candidates):
    """Nodes by trying every threshold of every candidate with plain loops."""
    def h(s):
        v = xxhash.xxh64_intdigest(s, seed=42)
        return v - 2**64 if v >= 2**63 else v

    out = {}

    def node(name, depth, part):
        n, p = len(part), sum(y for _, y in part)
        split = None
        if 0 < p < n:
            width = len(part[0][0])
            order = sorted(range(width), key=lambda f: h(f"{name}:{f}"))
            best = None
            for rank, f in enumerate(order):
                if rank >= candidates and best:
                    break
                values = sorted({x[f] for x, _ in part})
                for a, b in zip(values, values[1:]):
                    left = [y for x, y in part if x[f] <= a]
                    right = [y for x, y in part if x[f] > a]
                    purity = sum((sum(s) ** 2 + (len(s) - sum(s)) ** 2) / len(s) for s in (left, right))
                    if best is None or purity > best[0]:
                        best = (purity, f, a / 2 + b / 2)
            split = best and best[1:]
        out[name] = (depth, n, p, split)
        if split:
            f, t = split
            node(h(f"{name}/0"), depth + 1, [r for r in part if r[0][f] <= t])
            node(h(f"{name}/1"), depth + 1, [r for r in part if r[0][f] > t])

    node(h(f"{seed}:{tree}"), 0, [(tuple(v.toArray()), y) for _, y, v in rows])
    return out


def _nodes(forest):
    return {(r.tree, r.node): (r.depth, r.cases, r.positives, None if r.feature is None else (r.feature, r.threshold)) for r in forest.nodes.collect()}


@pytest.mark.parametrize("candidates, local_rows", [(5, 10**6), (5, 60), (2, 10**6), (2, 60)])
def test_a_tree_equals_brute_force(spark, candidates, local_rows):
    """In one task, and with the upper levels spread over all tasks."""
    rows = _data()
    forest = X.fit_exact_forest(_frame(spark, rows), trees=1, candidates=candidates, seed=7, bootstrap=False, local_rows=local_rows)
    want = brute_tree(rows, 7, 0, candidates)
    got = _nodes(forest)
    assert {n: v for (_, n), v in got.items()} == want


def test_how_rows_are_spread_does_not_matter(spark):
    df = _frame(spark, _data(400, 6, seed=3))
    one = X.fit_exact_forest(df, trees=4, seed=5)
    two = X.fit_exact_forest(df.repartition(7), trees=4, seed=5, local_rows=200)
    assert _nodes(one) == _nodes(two)
    assert _nodes(one) != _nodes(X.fit_exact_forest(df, trees=4, seed=6))


def test_depth_has_no_limit(spark):
    """Labels that alternate along one feature need a chain of splits or many levels."""
    rows = [(i, i % 2, Vectors.dense([float(i)])) for i in range(300)]
    forest = X.fit_exact_forest(_frame(spark, rows), trees=1, bootstrap=False)
    s = X.exact_structure(forest).first()
    assert s.leaves_max == 300 and s.depth_max > 30
    p = X.predict_exact(forest, _frame(spark, rows)).collect()
    assert all(r.y_prob == r.y_true for r in p)  # grown to purity


def test_scores_equal_a_walk_by_hand(spark, monkeypatch):
    rows = _data(150, 5, seed=9)
    forest = X.fit_exact_forest(_frame(spark, rows), trees=5, seed=2)
    nodes = {(r.tree, r.node): r for r in forest.nodes.collect()}

    def walk(tree, x):
        r = nodes[tree, X.root_of(2, tree)]
        while r.feature is not None:
            r = nodes[tree, r.left if x[r.feature] <= r.threshold else r.right]
        return r.positives / r.cases

    want = {i: sum(walk(t, v) for t in range(5)) / 5 for i, _, v in rows}
    for limit in (10**6, 10):  # in one pass, and one tree at a time
        monkeypatch.setattr(X, "MAX_SENT_NODES", limit)
        got = {r.case_id: r.y_prob for r in X.predict_exact(forest, _frame(spark, rows)).collect()}
        assert got.keys() == want.keys() and np.allclose([got[i] for i in want], [want[i] for i in want], atol=1e-12)


def test_checks_importance_and_bootstrap(spark):
    df = _frame(spark, _data(300, 5, seed=4))
    forest = X.fit_exact_forest(df, trees=30, seed=1)
    assert {r.property: r.violations for r in X.exact_checks(forest).collect()} == dict.fromkeys(
        ["leaves_hold_the_root", "no_empty_node", "no_pure_node_is_split", "names_are_unique"], 0)
    dictionary = spark.createDataFrame([(i, f"f{i}") for i in range(5)], "feature_index long, feature_name string")
    shares = {r.feature_index: r.importance for r in X.exact_importance(forest, dictionary).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares[4] == 0 and min(shares[0], shares[1]) > max(shares[2], shares[3])
    roots = [r.cases for r in forest.nodes.filter("depth = 0").collect()]
    assert len(set(roots)) > 5 and abs(sum(roots) / len(roots) - 300) < 20  # Poisson counts of mean one


@pytest.mark.parametrize("labels", [[0], [1, 1, 1], [0, 1]])
def test_small_inputs(spark, labels):
    rows = [(i, y, Vectors.dense([1.0, 2.0])) for i, y in enumerate(labels)]
    forest = X.fit_exact_forest(_frame(spark, rows), trees=1, bootstrap=False)
    r = forest.nodes.collect()
    assert len(r) == 1 and (r[0].cases, r[0].positives, r[0].feature) == (len(labels), sum(labels), None)
    assert {p.y_prob for p in X.predict_exact(forest, _frame(spark, rows)).collect()} == {sum(labels) / len(labels)}


def test_nodes_do_not_pass_through_the_driver(spark, monkeypatch):
    """Scores and importance come from packed trees; a chunk of trees and a block of rows meet in a task."""
    from pyspark.sql.classic.dataframe import DataFrame

    df = _frame(spark, _data(200, 5, seed=2))
    forest = X.fit_exact_forest(df, trees=6, seed=3)
    want = {r.case_id: r.y_prob for r in X.predict_exact(forest, df).collect()}

    def refuse(self):
        raise AssertionError("a table came to the driver")

    monkeypatch.setattr(DataFrame, "toPandas", refuse)
    monkeypatch.setattr(X, "ROWS_PER_BLOCK", 30)
    monkeypatch.setattr(X, "MAX_SENT_NODES", 100)
    assert len(X.tree_chunks(forest)) > 2
    got = {r.case_id: r.y_prob for r in X.predict_exact(forest, df).collect()}
    assert got.keys() == want.keys() and np.allclose([got[i] for i in want], list(want.values()), atol=1e-12)


def test_a_tree_is_grown_a_level_at_a_time(monkeypatch):
    """Features of a node are ordered once a node, and rows are sorted once a level and candidate."""
    rng = np.random.default_rng(1)
    x, y, w = rng.random((3000, 6)), rng.integers(0, 2, 3000), np.ones(3000, np.int64)
    sorts = []
    monkeypatch.setattr(X.np, "lexsort", lambda keys, f=np.lexsort: sorts.append(1) or f(keys))
    levels = list(X.grow(0, 5, 0, x, y, w, 2))
    inner = sum(int((v["feature"] >= 0).sum()) for v in levels)
    assert inner > 500 and len(sorts) <= 6 * len(levels)


def test_bins_and_depth_bound_a_forest(spark):
    rows = [(i, int(i * 7 % 10 < 4), Vectors.dense([i / 3, float(i % 3)])) for i in range(900)]
    df = _frame(spark, rows)
    forest = X.fit_exact_forest(df, trees=4, seed=1, max_depth=5, bins=16)
    nodes = forest.nodes.collect()
    assert max(r.depth for r in nodes) == 5 and {r.property: r.violations for r in X.exact_checks(forest).collect()}["leaves_hold_the_root"] == 0
    cuts = {f: {r.threshold for r in nodes if r.feature == f} for f in (0, 1)}
    assert 2 < len(cuts[0]) <= 15 and cuts[1] <= {0.5, 1.5}
    # a threshold sends the training rows where the grower sent them
    by = {(r.tree, r.node): r for r in nodes}
    whole = X.fit_exact_forest(df, trees=1, bootstrap=False, max_depth=3, bins=16)
    by = {r.node: r for r in whole.nodes.collect()}

    def count(name, part):
        r = by[name]
        assert (len(part), sum(y for _, y, _ in part)) == (r.cases, r.positives)
        if r.feature is not None:
            count(r.left, [p for p in part if p[2][r.feature] <= r.threshold])
            count(r.right, [p for p in part if p[2][r.feature] > r.threshold])

    count(X.root_of(42, 0), rows)


def test_a_draw_takes_one_hash(spark):
    from pyspark.sql import functions as F

    assert str(X.bootstrap_count(F.col("case_id"), F.col("t"), 1)).count("md5") == 1


def test_rows_go_to_a_task_and_not_to_each_tree(spark, monkeypatch):
    """Rows sent to the growers of small forests, in multiples of the table, and the trees they make."""
    from pyspark.sql.classic.dataframe import DataFrame

    df, sent = _frame(spark, _data(100, 5, seed=6)), []
    monkeypatch.setattr(DataFrame, "repartitionById", lambda self, n, *c, f=DataFrame.repartitionById: sent.append((n, self.count())) or f(self, n, *c))
    forest = X.fit_exact_forest(df, trees=100, seed=3)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    assert len(sent) == 1 and sent[0][0] <= tasks < 50 and sent[0][1] == 100 * sent[0][0]
    assert forest.nodes.select("tree").distinct().count() == 100


@pytest.mark.parametrize("dense", [0, 1, 8])
def test_counted_and_sorted_values_give_one_tree(monkeypatch, dense):
    rng = np.random.default_rng(2)
    x = np.stack([rng.integers(0, k, 500) / 3 for k in (2, 5, 60, 10**6)], axis=1)
    y, w = rng.integers(0, 2, 500), rng.integers(0, 3, 500)
    want = [{k: np.asarray(v).tolist() for k, v in level.items() if k != "threshold"} for level in X.grow(0, 5, 0, x[w > 0], y[w > 0], w[w > 0], 2)]
    monkeypatch.setattr(X, "DENSE", dense)
    assert [{k: np.asarray(v).tolist() for k, v in level.items() if k != "threshold"} for level in X.grow(0, 5, 0, x, y, w, 2)] == want
