import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators.contracts import ContractError
from tracewell.operators.order import exact_quantiles, order_events, ordered_cumsum, ranged_row_number
from tracewell.operators.temporal import assign_parts, find_boundaries, seeded_sample, temporal_order


def skewed(spark, n=3000):
    """One key holds most rows and one value is heavily tied."""
    rng = random.Random(1)
    rows = [(("hot" if rng.random() < 0.6 else f"k{rng.randrange(50)}"),
             7 if rng.random() < 0.4 else rng.randrange(200), i) for i in range(n)]
    return spark.createDataFrame(rows, "k string, v long, id long").repartition(7)


def test_ordered_cumsum_equals_window(spark):
    df = skewed(spark)
    got = ordered_cumsum(df, ["v"], {"n": F.lit(1), "s": F.col("id")}, ["k"])
    merged = df.groupBy("k", "v").agg(F.count("id").alias("n"), F.sum("id").alias("s"))
    w = W.partitionBy("k").orderBy("v")
    whole = W.partitionBy("k")
    want = merged.select("k", "v", "n", "s", F.sum("n").over(w).alias("cum_n"), F.sum("s").over(w).alias("cum_s"),
                         F.sum("n").over(whole).alias("total_n"), F.sum("s").over(whole).alias("total_s"))
    got = got.select(want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_ordered_cumsum_without_keys_and_with_shuffled_totals(spark, monkeypatch):
    import tracewell.functions.tables as tables

    monkeypatch.setattr(tables, "MAX_BROADCAST_ROWS", 1)  # the way beyond the size bound
    df = skewed(spark)
    got = [tuple(r) for r in ordered_cumsum(df, ["v"], {"n": F.lit(1)}).select("v", "cum_n").orderBy("v").collect()]
    counts = np.bincount([r.v for r in df.collect()])
    running = np.cumsum(counts)
    assert got == [(v, running[v]) for v in range(len(counts)) if counts[v]]


def test_ranged_row_number(spark):
    df = skewed(spark)
    got = ranged_row_number(df, ["v", "id"], ["k"], "rn").select("k", "id", "rn")
    want = df.select("k", "id", F.row_number().over(W.partitionBy("k").orderBy("v", "id")).cast("long").alias("rn"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_ranges_follow_the_rows_and_any_number_of_cuts_agrees(spark, monkeypatch):
    import tracewell.operators.order as order

    df = skewed(spark)
    monkeypatch.setattr(order, "ROWS_PER_RANGE", 40)
    nested, ranges = order.range_number(df, ["k", "v", "id"])
    assert ranges == 75
    monkeypatch.setattr(order, "_NESTED_CUTS", 3)
    searched, _ = order.range_number(df, ["k", "v", "id"])
    both = df.select(nested.alias("a"), searched.alias("b"), "k", "v", "id")
    assert both.where("a <> b").count() == 0 and both.groupBy("a").count().agg(F.max("count")).first()[0] == 40
    bounds = both.groupBy("a").agg(F.min(F.struct("k", "v", "id")).alias("lo"), F.max(F.struct("k", "v", "id")).alias("hi")).orderBy("a").collect()
    assert all(x.hi < y.lo for x, y in zip(bounds, bounds[1:]))


def test_huge_case_is_ordered_by_ranges(spark):
    rows = [("hot" if i % 3 else f"c{i % 40}", "a", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i % 97), i)
            for i in range(2000)]
    log = spark.createDataFrame(rows, "case_id string, activity string, ts timestamp, order_key long").repartition(5)
    cols = ["case_id", "order_key", "event_pos"]
    plain = order_events(log).select(cols)
    split = order_events(log, max_case_rows=500).select(cols)
    assert plain.exceptAll(split).count() == 0 and split.count() == 2000


def test_order_is_independent_of_row_order(spark):
    rows = [("a", "x", dt.datetime(2024, 1, 1), k) for k in (3, 1, 2)] + [("a", "y", dt.datetime(2023, 1, 1), 9)]
    schema = "case_id string, activity string, ts timestamp, order_key long"
    for shuffled in (rows, rows[::-1]):
        got = order_events(spark.createDataFrame(shuffled, schema)).orderBy("event_pos").collect()
        assert [r.order_key for r in got] == [9, 1, 2, 3]


def test_exact_quantiles(spark):
    df = skewed(spark).withColumn("v", F.when(F.col("id") % 11 == 0, None).otherwise(F.col("v")))
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.995, "e": 1.0}
    pdf = df.toPandas()
    got = {r.k: r for r in exact_quantiles(df, "v", probs, ["k"]).collect()}
    for k, part in pdf.groupby("k"):
        want = part["v"].dropna().quantile(list(probs.values()))
        assert np.allclose([got[k][n] for n in probs], want)
    one = exact_quantiles(df, "v", probs).first()
    assert np.allclose([one[n] for n in probs], pdf["v"].quantile(list(probs.values())))


def starts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "case_id long, start long")


@pytest.mark.parametrize(
    "values, ratio, position",
    [
        ([1, 2, 3, 4, 5], 0.8, 4),
        ([1, 2, 3, 3, 3, 3, 4, 5, 6, 7], 0.3, 2),  # tied group 2..6: its start is nearer
        ([1, 2, 3, 3, 3, 3, 4, 5, 6, 7], 0.5, 6),  # its end is nearer
        ([1, 1, 2, 2, 3, 3, 4, 4], 0.375, 2),  # equal distance: the earlier cut
    ],
)
def test_boundary(spark, values, ratio, position):
    df = starts(spark, values)
    total, cuts = find_boundaries(df, "start", [ratio])
    assert (total, cuts[0].position) == (len(values), position)
    parts = assign_parts(df, "start", cuts, ["train", "test"], "split").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in parts} == {"train": position, "test": len(values) - position}


def test_no_cut_exists(spark):
    with pytest.raises(ContractError):
        find_boundaries(starts(spark, [5] * 10), "start", [0.8])
    with pytest.raises(ContractError):
        find_boundaries(starts(spark, [1, 1, 1, 1, 2, 2]), "start", [1 / 3, 2 / 3])


def test_timestamp_cuts_keep_ties_together(spark):
    times = [dt.datetime(2024, 1, 1 + i // 4) for i in range(20)]
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(list(enumerate(times)), "case_id long, start timestamp")
        df = df.withColumn("start", F.col("start").cast(kind))
        _, cuts = find_boundaries(df, "start", [0.5])
        split = assign_parts(df, "start", cuts, ["a", "b"], "part")
        assert split.groupBy("start").agg(F.count_distinct("part").alias("n")).filter("n > 1").count() == 0
        assert split.filter("part = 'a'").count() == 8


def test_seeded_sample(spark):
    df = spark.range(500).withColumnRenamed("id", "case_id").withColumn("target", F.col("case_id") % 2)
    a = seeded_sample(df, "case_id", 40).orderBy("sample_order").collect()
    b = seeded_sample(df.repartition(13).withColumn("target", F.lit(0)), "case_id", 40).orderBy("sample_order").collect()
    assert [r.case_id for r in a] == [r.case_id for r in b] and len({r.case_id for r in a}) == 40
    assert [r.sample_order for r in a] == list(range(40))
    assert [r.case_id for r in seeded_sample(df, "case_id", 40, seed=7).collect()] != [r.case_id for r in a]
    assert seeded_sample(df, "case_id", 1000).count() == 500


def test_temporal_order(spark):
    got = temporal_order(starts(spark, [5, 3, 3, 9]), "start", "case_id").collect()
    assert {r.case_id: r.temporal_order for r in got} == {1: 0, 2: 1, 0: 2, 3: 3}
