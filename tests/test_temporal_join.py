import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewell.operators import temporal_join as TJ
from tracewell.operators.cube import case_bitmaps, cube_distinct


def at(seconds):
    return None if seconds is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def _events(n=1500, seed=1, hot=0.5):
    """One key holds half of the rows; many times tie."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < hot else rng.choice(["a", "b", "c", None]), None if rng.random() < 0.02 else rng.randrange(4000), i, rng.choice("xyz")) for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame([(k, at(t), i, s) for k, t, i, s in rows], "k string, ts timestamp, id long, state string").repartition(6)


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_join_equals_looking_at_all_pairs(spark, strict):
    left, right = _events(seed=2), _events(400, seed=3)
    got = {r.id: (r.s, r.since) for r in TJ.as_of_join(
        _frame(spark, left), _frame(spark, right).withColumnRenamed("ts", "since"), ["k"], "ts", "since", {"state": "s", "since": "since"}, tie=["id"], strict=strict).collect()}
    assert len(got) == len(left)
    for k, t, i, _ in left:
        before = [(rt, ri, s) for rk, rt, ri, s in right if k is not None and rk == k and t is not None and rt is not None and (rt < t if strict else rt <= t)]
        want = max(before, default=None)
        assert got[i] == ((want[2], at(want[0])) if want else (None, None))


def test_a_state_is_handed_over_ranges_without_one(spark):
    """One state at the beginning of the hot key stays in force over all ranges; other keys have none."""
    left = [("hot", 10 + i, i, "") for i in range(3000)] + [("zz", i, 5000 + i, "") for i in range(50)] + [("a", i, 6000 + i, "") for i in range(50)]
    right = _frame(spark, [("hot", 5, 0, "first")])
    out = TJ.as_of_join(_frame(spark, left), right, ["k"], "ts", "ts", {"state": "found"})
    counts = {(r.k, r.found): r["count"] for r in out.groupBy("k", "found").count().collect()}
    assert counts == {("hot", "first"): 3000, ("zz", None): 50, ("a", None): 50}


def test_no_rows(spark):
    some, none = _frame(spark, _events(20)), _frame(spark, _events(20)).filter("false")
    assert TJ.as_of_join(some, none, ["k"], "ts", "ts", {"state": "s"}).filter("s is not null").count() == 0
    assert TJ.as_of_join(none, some, ["k"], "ts", "ts", {"state": "s"}).count() == 0
    assert TJ.trailing(none, ["k"], "ts", 5, {"n": F.count("*")}).count() == 0


def test_interval_join_equals_a_range_join(spark):
    rng = random.Random(5)
    points = _events(900, seed=6)
    intervals = []
    for i in range(300):
        start = rng.randrange(-200, 4200)
        length = rng.choice([0, 1, 2, 7, 60, 61, 500, 4000, -5])
        intervals.append((rng.choice(["hot", "a", "b", None]), start, start + length, i))
    p = _frame(spark, points).select("k", "ts", "id")
    v = spark.createDataFrame([(k, at(a), at(b), i) for k, a, b, i in intervals] + [("a", None, at(5), 999)], "k string, s timestamp, e timestamp, interval long")
    want = sorted((i, j) for k, t, i, _ in points for vk, a, b, j in intervals if k is not None and k == vk and t is not None and a <= t < b)
    for unit in (1, 7):
        got = sorted((r.id, r.interval) for r in TJ.interval_join(p, v, ["k"], "ts", "s", "e", unit_seconds=unit).collect())
        assert got == want
    left = TJ.interval_join(p, v, ["k"], "ts", "s", "e", how="left")
    alone = {r.id for r in left.filter("interval is null").collect()}
    assert alone == {i for _, _, i, _ in points} - {i for i, _ in want} and left.filter("interval is not null").count() == len(want)
    with pytest.raises(ValueError):
        TJ.interval_join(p, v.withColumn("id", F.lit(1)), ["k"], "ts", "s", "e")


def test_interval_join_is_on_equal_segments(spark):
    p, v = _frame(spark, _events(900)).select("k", "ts", "id"), spark.createDataFrame([("hot", at(3), at(3900), 1)], "k string, s timestamp, e timestamp, interval long")
    out = TJ.interval_join(p, v, ["k"], "ts", "s", "e", unit_seconds=1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in out._jdf.queryExecution().executedPlan().toString() and "block" in plan
    segments = v.select(F.explode(TJ._segments(F.lit(3), F.lit(3899), 8)).alias("s")).select("s.*").collect()
    cover = sorted(x for s in segments for x in range(s.block << s.level, (s.block + 1) << s.level))
    assert cover == list(range(3, 3900)) and len(segments) <= 2 * 8 + 3900 // 256


def test_trailing_equals_range_frames(spark):
    rows = _events(2000, seed=8, hot=0.7)
    for width in (0, 700, 100_000):
        got = {r.id: (r.n, r.least) for r in TJ.trailing(_frame(spark, rows), ["k"], "ts", width, {"n": F.count("*"), "least": F.min("id")}).collect()}
        con = duckdb.connect()
        con.execute("CREATE TABLE e (k VARCHAR, t BIGINT, id BIGINT)")
        con.executemany("INSERT INTO e VALUES (?, ?, ?)", [(k, t, i) for k, t, i, _ in rows])
        want = con.sql(f"SELECT id, count(*) OVER w, min(id) OVER w FROM e WINDOW w AS (PARTITION BY k ORDER BY t RANGE BETWEEN {width} PRECEDING AND CURRENT ROW)").fetchall()
        assert got == {i: (n, m) for i, n, m in want}


def test_a_hot_key_is_spread(spark):
    rows = _frame(spark, _events(4000, hot=0.9)).filter("k = 'hot'")
    out = TJ.trailing(rows, ["k"], "ts", 60, {"n": F.count("*")})
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 0.4 * sum(sizes)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" not in plan and "SinglePartition" not in plan


def test_cube_equals_sql(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(300)]), rng.choice("abc"), rng.choice([None, "x", "y"]), rng.randrange(2)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "case_id long, a string, b string, c int").repartition(5)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (case_id BIGINT, a VARCHAR, b VARCHAR, c INT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    want = con.sql("SELECT a, b, c, grouping_id(a, b, c), count(*), count(DISTINCT case_id) FROM t GROUP BY CUBE (a, b, c)").fetchall()
    got = [tuple(r) for r in cube_distinct(df, ["a", "b", "c"]).select("a", "b", "c", "grouping_id", "rows", "cases").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    some = [tuple(r) for r in cube_distinct(df, ["a", "b"], sets=[["a"], []]).select("a", "b", "grouping_id", "rows", "cases").collect()]
    assert sorted(some, key=repr) == sorted(con.sql("SELECT a, b, grouping_id(a, b), count(*), count(DISTINCT case_id) FROM t GROUP BY GROUPING SETS ((a), ()), b HAVING false").fetchall() + con.sql(
        "SELECT a, NULL, 1, count(*), count(DISTINCT case_id) FROM t GROUP BY a UNION ALL SELECT NULL, NULL, 3, count(*), count(DISTINCT case_id) FROM t").fetchall(), key=repr)


def test_cases_are_exchanged_once_whatever_the_sets(spark):
    df = spark.createDataFrame([(1, "a", "b")], "case_id long, x string, y string")
    plan = case_bitmaps(df, ["x", "y"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(case_id") == 1 and plan.count("Exchange hashpartitioning") == 2  # the other one carries bitmaps
    assert cube_distinct(df.filter("false"), ["x"]).filter("x is not null").count() == 0


def test_more_cases_than_a_bitmap_holds(spark):
    df = spark.range(100_000).selectExpr("id AS case_id", "id % 3 AS g", "id % 2 AS h").repartition(2)
    got = {(r.g, r.h): r.cases for r in cube_distinct(df, ["g", "h"]).collect()}
    assert got[None, None] == 100_000 and got[None, 0] == 50_000 and got[0, None] == 33_334 and sum(got[g, h] for g in range(3) for h in range(2)) == 100_000


def test_trailing_by_blocks_is_linear_and_equals_range_frames(spark):
    rows = [(k, t, i, None if i % 5 == 0 else i % 17) for i, (k, t, *_) in enumerate(_events(1500, seed=8, hot=0.7))]
    df = spark.createDataFrame([(k, None if t is None else at(t), i, v) for k, t, i, v in rows], "k string, ts timestamp, id long, v long")
    con = duckdb.connect()
    con.execute("CREATE TABLE e (k VARCHAR, t BIGINT, id BIGINT, v BIGINT)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?)", rows)
    for width in (1, 700):
        out = TJ.trailing(df, ["k"], "ts", width, {"n": F.count("*"), "s": F.sum("v"), "hi": F.max("v"), "lo": F.min("id")}, {"n": "count", "s": "sum", "hi": "max", "lo": "min"})
        want = con.sql("SELECT id, count(*) OVER w, sum(v) OVER w, max(v) OVER w, min(id) OVER w FROM e "
                       f"WINDOW w AS (PARTITION BY k ORDER BY t RANGE BETWEEN {width} PRECEDING AND CURRENT ROW)").fetchall()
        assert {r.id: (r.n, r.s, r.hi, r.lo) for r in out.collect()} == {i: tuple(v) for i, *v in want}
    # no frame is read anew for each row: all of them begin at the start of a block
    frames = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line]
    assert frames and all("unboundedpreceding" in f and "RangeFrame, -" not in f for f in frames)
