import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import redundancy as RD
from tracewell.operators import sketches as SK

PROBS = {"q05": 0.05, "q50": 0.5, "q95": 0.95}


def _rows(spark, n=40_000):
    return spark.range(n).select(
        (F.col("id") % 10).alias("day"), F.when(F.col("id") % 50 > 0, F.exp(F.randn(5))).alias("v"), (F.col("id") * 7 % 9000).alias("who"), F.lit(None).cast("double").alias("empty"))


def test_merged_periods_are_within_the_bounds(spark):
    rows = _rows(spark).cache()
    days = SK.build_sketches(rows, F.col("day"), ["v", "empty"], ["who", "v"])
    assert days.count() == 30
    profile = SK.sketch_profile(SK.merge_sketches(days, (F.col("period") >= 5).cast("int")), PROBS)
    got = {(r.span, r.column): r for r in profile.collect()}
    pdf = rows.toPandas()
    for span in (0, 1):
        part = pdf[(pdf["day"] >= 5) == span]
        v = part["v"].dropna().to_numpy()
        r = got[span, "v"]
        assert (r["rows"], r.non_null) == (len(part), len(v)) and np.isclose(r.smallest, v.min()) and np.isclose(r.largest, v.max())
        for name, p in PROBS.items():
            assert abs((v <= r[name]).mean() - p) <= SK.rank_error() + 1 / len(v)
        assert abs(got[span, "who"].distinct - part["who"].nunique()) <= 4 * SK.distinct_error() * part["who"].nunique()
        assert got[span, "empty"].q50 is None and got[span, "empty"].non_null == 0 and got[span, "who"].q50 is None
    exact = rows.select((F.col("day") >= 5).cast("int").alias("span"), F.col("v").alias("value"))
    bad = SK.rank_violations(profile, exact, "v", PROBS, SK.rank_error())
    assert bad.count() == 6 and bad.filter("not within").count() == 0
    assert SK.rank_violations(profile.withColumn("q50", F.col("q95")), exact, "v", PROBS, SK.rank_error()).filter("not within").count() == 2


def test_a_merged_profile_reads_no_rows(spark, tmp_path):
    SK.build_sketches(_rows(spark), F.col("day"), ["v"], ["who"]).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    merged = SK.sketch_profile(SK.merge_sketches(stored), PROBS)
    assert merged.count() == 2 and all(str(tmp_path / "s") in f for f in merged.inputFiles())
    # sketches of sketches: any grouping of the days gives the same counts and extremes
    again = SK.sketch_profile(SK.merge_sketches(stored.filter("period < 3").unionByName(stored.filter("period >= 3"))), PROBS)
    assert {(r.column, r["rows"], r.smallest) for r in merged.collect()} == {(r.column, r["rows"], r.smallest) for r in again.collect()}


def _cells(spark, columns: dict[int, np.ndarray]):
    rows = [(i, f, float(v)) for f, x in columns.items() for i, v in enumerate(x) if v != 0]
    n = len(next(iter(columns.values())))
    dictionary = spark.createDataFrame([(f, f"f{f}") for f in columns], "feature_index long, feature_name string")
    return spark.createDataFrame(rows, "case_id long, feature_index long, value double"), spark.range(n).select(F.col("id").alias("case_id")), dictionary


def test_linear_copies_are_found_among_many_features(spark):
    rng = np.random.default_rng(1)
    x = {f: rng.normal(size=200) * (rng.random(200) < (0.3 if f % 2 else 1)) for f in range(60)}
    x |= {100: 3 * x[4] + 1, 101: -x[4], 102: x[4] * 0.5, 103: -2 * x[9], 104: np.full(200, 5.0), 105: np.full(200, 5.0)}
    cells, cases, dictionary = _cells(spark, x)
    got = {r.feature_name: (r.earlier_feature, round(r.correlation, 9), r.kept_feature) for r in RD.redundant_features(cells, cases, dictionary).collect()}
    assert got == {"f100": ("f4", 1.0, "f4"), "f101": ("f4", -1.0, "f4"), "f102": ("f4", 1.0, "f4"), "f103": ("f9", -1.0, "f9")}  # constants are no copies


@pytest.mark.parametrize("similarity", [0.95, 0.99])
def test_correlated_pairs_equal_the_full_matrix(spark, similarity):
    rng = np.random.default_rng(2)
    x = {f: rng.normal(size=400) for f in range(30)}
    for f in range(30, 60):
        x[f] = x[f - 30] * rng.choice([-1, 1]) + rng.normal(size=400) * rng.choice([0.01, 0.1, 0.2, 0.5, 1])
    cells, cases, _ = _cells(spark, x)
    full = np.corrcoef(np.stack([x[f] for f in range(60)]))
    want = {(a, b): full[a, b] for a in range(60) for b in range(a + 1, 60) if abs(full[a, b]) >= similarity}
    got = {(r.a, r.b): r.correlation for r in RD.correlated_pairs(cells, cases, similarity).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k], atol=1e-9) for k in want) and len(want) > 5


def test_a_group_of_copies_is_no_pair_table(spark):
    rng = random.Random(3)
    x = np.array([rng.gauss(0, 1) for _ in range(50)])
    cells, cases, dictionary = _cells(spark, {f: x * (f + 1) for f in range(40)})
    assert RD.correlated_pairs(cells, cases).count() == 39
    assert {r.kept_feature for r in RD.redundant_features(cells, cases, dictionary).collect()} == {"f0"}
