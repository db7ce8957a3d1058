"""Prefix completion on a stream: a case's features leave as soon as its first k events are certain.

The state of a case is its k smallest events by (time, order key), at most k rows whatever arrives. Once it
holds k, it is due at the time of the k-th: when the watermark has passed it, no earlier event is
accepted any more, the prefix is final, and one row with the k events leaves. Until then an event that
arrives out of order takes its place in the prefix; one older than the watermark is late and dropped by
Spark. An event that arrives twice has the same (time, order key) and counts once. What remains of a
finished case is a marker, so that its later events start no second prefix.

Spark calls a Python processor once a key, makes an Arrow batch of what each call returns, and every use of the
state is a message to the JVM and back. So a key is a bucket of cases, by hash, and not a case: calls and
messages of a batch are a few for each bucket, however many cases it has. A bucket's cases are one value,
read and written whole; it has one timer, at the first moment one of its cases is certain.

The features are computed from the k events by the same column expressions as in batch, on the JVM.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell.functions.columns import micros
from tracewell.operators.features import FeatureSpec, count_map, mean_gap
from tracewell.spec import ACTIVITY, CASE, ORDER_KEY, TS

STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
# Buckets of cases, each a key of the state; more than the cores of a cluster.
BUCKETS = 1024
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstEvents(StatefulProcessor):
    """Keeps the k smallest events of each case of a bucket and emits them when no smaller one can come."""

    def __init__(self, k: int, event: T.StructType):
        self.k, self.event = k, event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("cases", "cases binary, timer long")

    def _stored(self) -> tuple[dict, int | None]:
        """The bucket's cases, each with its events by their place, or None where it has left; and the timer that is set."""
        stored = self.state.get()
        return (pickle.loads(stored[0]), stored[1]) if stored is not None else ({}, None)

    def _certain(self, held: dict | None) -> int | None:
        """The millisecond of the watermark from which a complete case is final: rows at or before the watermark are late."""
        return -(-max(held)[0] // 1000) if held and len(held) == self.k else None

    def _store(self, cases: dict, timer: int | None, old: int | None) -> None:
        self.state.update((pickle.dumps(cases), timer))
        if timer != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if timer is not None:
                self.handle.registerTimer(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        cases, old = self._stored()
        changed = set()
        for r in rows:
            e = r["event"]
            case, place = e[CASE], (e["us"], e[ORDER_KEY])
            held = cases.setdefault(case, {})
            if held is None or place in held:  # the same event again is no other event
                continue
            if len(held) == self.k:
                last = max(held)
                if place > last:
                    continue
                del held[last]
            held[place] = {n: e[n] for n in self.event.names}
            changed.add(case)
        if changed:
            # a case that was complete can only have become certain earlier, so a timer that is set is not too late
            due = [ms for c in changed if (ms := self._certain(cases[c])) is not None]
            self._store(cases, min([*due, *([] if old is None else [old])], default=None), old)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        cases, _ = self._stored()
        due = {c: ms for c, held in cases.items() if (ms := self._certain(held)) is not None}
        for case in [c for c, ms in due.items() if ms <= now]:
            held = cases[case]
            cases[case] = None
            yield Row(**{CASE: case, "events": [held[p] for p in sorted(held)]})
        # Spark deletes the timer that has fired
        self._store(cases, min((ms for ms in due.values() if ms > now), default=None), None)

    def close(self) -> None:
        pass


def completed_prefixes(events: DataFrame, k: int, columns: Sequence[str], watermark: str, buckets: int = BUCKETS) -> DataFrame:
    """(case_id, events): the first k events of each case, in order, once they are certain.

    `events` is a stream with the canonical log columns; an event holds its time in microseconds
    (`us`), the order key and `columns`. `watermark` is how far behind the newest event one may come.
    A bucket's cases are held by one task at a time; a checkpoint holds for one number of `buckets`.
    """
    # a time without zone counts as UTC; watermarks need one with a zone
    rows = events.select(CASE, F.timestamp_micros(micros(F.col(TS))).alias(TS), micros(F.col(TS)).alias("us"), ORDER_KEY, *columns)
    rows = rows.withWatermark(TS, watermark)
    event = T.StructType([f for f in rows.schema.fields if f.name not in (TS, CASE)])
    out = T.StructType([rows.schema[CASE], T.StructField("events", T.ArrayType(event))])
    # rows and not pandas frames, which would change NaN and whole numbers beside nulls; as one struct, since each column of a row costs
    whole = F.struct(CASE, *event.names).alias("event")
    bucketed = rows.select(F.pmod(F.xxhash64(CASE), F.lit(buckets)).alias("bucket"), TS, whole)
    return bucketed.groupBy("bucket").transformWithState(FirstEvents(k, event), out, "append", "EventTime")


def prefix_features(prefixes: DataFrame, spec: FeatureSpec) -> DataFrame:
    """One feature row per completed prefix, as `features.case_features` gives it but for the target."""
    def of(name: str) -> Column:
        return F.transform("events", lambda e: e[name])

    def complete(name: str) -> Column:
        values = of(name).cast("array<string>")
        missing = F.raise_error(F.lit(f"count-map source {name} has missing values")).cast("array<string>")
        return F.when(F.exists(values, lambda v: v.isNull()), missing).otherwise(values)

    first, last = F.element_at("events", 1), F.element_at("events", -1)
    seconds = (last["us"] - first["us"]) / F.lit(1e6)
    return prefixes.select(
        CASE, F.timestamp_micros(first["us"]).alias("case_start_time"),
        *[first[s].alias(o) for s, o in spec.statics.items()],
        *[count_map(complete(s)).alias(spec.map_column(ns)) for s, ns in spec.count_maps.items()],
        *[F.size(F.array_compact(F.array_distinct(of(s)))).cast("long").alias(o) for o, s in spec.uniques.items()],
        seconds.alias("prefix_duration_seconds"), mean_gap(seconds, F.size("events")).alias("mean_event_gap_seconds"))


def stream_features(events: DataFrame, k: int, spec: FeatureSpec, watermark: str) -> DataFrame:
    columns = dict.fromkeys([ACTIVITY, *spec.statics, *spec.count_maps, *spec.uniques.values()])
    return prefix_features(completed_prefixes(events, k, list(columns), watermark), spec)


@contextmanager
def _set(spark: SparkSession, settings: Mapping[str, str]):
    """Session settings for the time a query starts; a started query keeps its own copy."""
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends the rows of all input that is there now to Parquet files, and ends.

    Called again with the same checkpoint it goes on where it stopped. State goes to the RocksDB
    store, whose size does not count against the executors' heap.
    """
    with _set(stream.sparkSession, {STORE_KEY: STORE}):
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
