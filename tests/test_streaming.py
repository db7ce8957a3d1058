import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracewell.operators.features import FeatureSpec
from tracewell.streaming.prefixes import STORE, STORE_KEY, _set, completed_prefixes, run_available, stream_features

SCHEMA = "case_id string, activity string, ts timestamp, order_key long, goal string"
SPEC = FeatureSpec(statics={"goal": "goal"}, count_maps={"activity": "activity"}, uniques={"n_activities": "activity"})


def at(minute: float):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


class Feed:
    """A folder that files arrive in one after another, and the stream over it."""

    def __init__(self, spark, tmp_path, k=2, watermark="10 minutes"):
        self.spark, self.path, self.out, self.checkpoint = spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
        self.k, self.watermark = k, watermark

    def send(self, *rows):
        df = self.spark.createDataFrame([(c, a, at(m), o, g) for c, a, m, o, g in rows], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(self.path)

    def run(self, stream=None):
        events = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.path)
        prefixes = completed_prefixes(events, self.k, ["activity", "goal"], self.watermark) if stream is None else stream(events)
        run_available(prefixes, self.out, self.checkpoint)

    def prefixes(self):
        rows = self.spark.read.parquet(self.out).collect()
        assert len({r.case_id for r in rows}) == len(rows)  # no case leaves twice
        return {r.case_id: [(e.activity, e.order_key) for e in r.events] for r in rows}


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_a_prefix_leaves_when_it_is_certain(feed):
    feed.send(("a", "x", 0, 1, "g"), ("a", "y", 1, 2, "g"), ("b", "x", 2, 3, "g"), ("c", "x", 5, 4, "g"), ("c", "y", 30, 5, "g"))
    feed.run()
    # the watermark is at minute 20: a is complete and certain, b has one event, c's second one may still be preceded
    assert feed.prefixes() == {"a": [("x", 1), ("y", 2)]}


def test_order_of_arrival_does_not_matter_inside_the_watermark(feed):
    feed.send(("a", "late", 8, 9, "g"), ("a", "mid", 5, 5, "g"))
    feed.send(("a", "early", 1, 1, "g"), ("z", "x", 12, 6, "g"))  # takes its place before both
    feed.send(("z", "x", 100, 7, "g"), ("z", "x", 101, 8, "g"))
    feed.run()
    assert feed.prefixes() == {"a": [("early", 1), ("mid", 5)], "z": [("x", 6), ("x", 7)]} or feed.prefixes() == {"a": [("early", 1), ("mid", 5)]}


def test_a_late_event_is_dropped(feed):
    feed.send(("a", "x", 20, 1, "g"), ("z", "x", 60, 2, "g"))
    feed.send(("z", "x", 61, 3, "g"))  # the watermark is at minute 50 now
    feed.send(("a", "too late", 5, 4, "g"), ("a", "y", 70, 5, "g"))
    feed.send(("z", "x", 200, 6, "g"))
    feed.send(("z", "x", 201, 7, "g"))
    feed.run()
    assert feed.prefixes()["a"] == [("x", 1), ("y", 5)]


def test_the_same_event_twice_counts_once(feed):
    feed.send(("a", "x", 1, 1, "g"), ("a", "x", 1, 1, "g"))
    feed.send(("a", "x", 1, 1, "g"), ("b", "x", 2, 2, "g"))
    feed.send(("z", "x", 100, 3, "g"), ("b", "y", 95, 4, "g"))
    feed.send(("z", "x", 200, 5, "g"))
    feed.run()
    found = feed.prefixes()
    assert "a" not in found and found["b"] == [("x", 2), ("y", 4)]


def test_a_restart_goes_on_from_the_checkpoint(feed):
    feed.send(("a", "x", 1, 1, "g"), ("b", "x", 2, 2, "g"))
    feed.run()
    assert not [c for c in feed.prefixes()]
    feed.send(("a", "y", 3, 3, "g"), ("z", "x", 60, 4, "g"))
    feed.run()  # a new query: the first event of a comes from the stored state
    assert feed.prefixes() == {"a": [("x", 1), ("y", 3)]}
    feed.send(("a", "again", 61, 5, "g"), ("a", "again", 62, 6, "g"), ("z", "x", 300, 7, "g"))
    feed.send(("z", "x", 301, 8, "g"))
    feed.run()
    assert feed.prefixes()["a"] == [("x", 1), ("y", 3)] and "b" not in feed.prefixes()


def test_state_is_bounded_and_the_first_k_stay(feed):
    for file in range(4):
        feed.send(*[("hot", f"e{i}", i % 9, i, "g") for i in range(file, 400, 4)])
    feed.send(("z", "x", 100, 1000, "g"))
    feed.run()
    assert feed.prefixes()["hot"] == [("e0", 0), ("e9", 9)]


def test_features_and_the_session_keeps_its_settings(feed, spark):
    before = spark.conf.get(STORE_KEY)
    feed.send(("a", "x", 0, 1, "g"), ("a", "x", 3, 2, "other"), ("a", "y", 4, 3, "g"), ("z", "x", 100, 4, "g"))
    feed.run(lambda events: stream_features(events, 3, SPEC, "1 minute"))
    row = spark.read.parquet(feed.out).select("*", F.unix_micros("case_start_time").alias("us")).first()
    assert (row.case_id, row.goal, row.activity_counts, row.n_activities) == ("a", "g", {"x": 2, "y": 1}, 2)
    assert (row.prefix_duration_seconds, row.mean_event_gap_seconds) == (240.0, 120.0)
    assert spark.conf.get(STORE_KEY) == before


def test_cases_of_one_bucket_leave_each_at_its_own_time(feed):
    feed.send(("a", "x", 0, 1, "g"), ("a", "y", 1, 2, "g"), ("b", "x", 2, 3, "g"), ("b", "y", 25, 4, "g"), ("c", "x", 3, 5, "g"))
    feed.send(("z", "x", 30, 6, "g"))  # the watermark is at minute 20: a leaves, b waits
    shared = lambda events: completed_prefixes(events, 2, ["activity", "goal"], "10 minutes", buckets=1)
    feed.run(shared)
    assert feed.prefixes() == {"a": [("x", 1), ("y", 2)]}
    feed.send(("b", "before", 22, 7, "g"), ("a", "again", 31, 8, "g"), ("a", "again", 32, 9, "g"))
    feed.send(("z", "x", 60, 10, "g"))
    feed.run(shared)
    assert feed.prefixes() == {"a": [("x", 1), ("y", 2)], "b": [("x", 3), ("before", 7)]}
    feed.send(("c", "y", 61, 11, "g"), ("z", "x", 200, 12, "g"))
    feed.run(shared)
    assert feed.prefixes() == {"a": [("x", 1), ("y", 2)], "b": [("x", 3), ("before", 7)], "z": [("x", 6), ("x", 10)], "c": [("x", 5), ("y", 11)]}


def test_values_leave_as_they_came(feed, spark):
    feed.send(("a", "null", 0, 1, "g"), ("a", "nan", 1, 2, None), ("z", "x", 100, 3, "g"))
    big, real = F.when(F.col("activity") == "nan", F.lit(2**53 + 1)), F.when(F.col("activity") == "nan", F.lit(float("nan")))
    feed.run(lambda e: completed_prefixes(e.withColumns({"big": big, "real": real, "at": F.col("ts")}), 2, ["goal", "big", "real", "at"], "10 minutes"))
    (row,) = spark.read.parquet(feed.out).collect()
    first, last = row.events
    assert (first.goal, first.big, first.real, last.goal, last.big, str(last.real)) == ("g", None, None, None, 2**53 + 1, "nan")
    sent = spark.read.parquet(feed.path).filter("case_id = 'a'").orderBy("ts").collect()
    assert [e["at"] for e in row.events] == [r.ts for r in sent]


def test_the_keys_of_the_state_do_not_grow_with_the_cases(feed, spark):
    feed.send(*[(f"c{i}", "x", i / 100, i, "g") for i in range(300)])
    events = spark.readStream.schema(SCHEMA).parquet(feed.path)
    prefixes = completed_prefixes(events, 2, ["activity"], "10 minutes", buckets=4)
    with _set(spark, {STORE_KEY: STORE}):
        query = prefixes.writeStream.format("parquet").option("path", feed.out).option("checkpointLocation", feed.checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) <= 4
