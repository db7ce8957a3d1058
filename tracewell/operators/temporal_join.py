"""Joins by time: the state in force at a moment, points in intervals, and sums over trailing time.

All three keep one key that has most of the rows spread: rows are dealt to ranges of (key, time), and what
a range needs from the ones before it is one state row (as-of join) or the rows of the trailing time
(sliding frames). The interval join cuts intervals into segments of a binary tree over time, so it is a
join on equal segments.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.columns import micros
from tracewell.functions.tables import measured_broadcast
from tracewell.operators.order import range_number
from tracewell.session import cut_lineage

_T, _PART, _SIDE, _KEY = "__time", "__range", "__side", "__key"


def _key(by: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{b}`") for b in by])


# --- the state in force ------------------------------------------------------------------------------

def as_of_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, columns: Mapping[str, str],
    tie: Sequence[str] = (), strict: bool = False,
) -> DataFrame:
    """Every left row with the latest right row of its key at or before its time (`strict`: before it).

    `columns` maps right columns to output names; they are null where no right row precedes. Among
    right rows of one key and time the one with the greatest `tie` columns counts. Rows with a null key or time
    have no state, and a null right time is never in force.

    Both sides are scanned in one order; inside a range the last right row is carried forward, and each
    range hands the next one the state of its last key.
    """
    by = list(by)
    state = F.struct(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(columns)])
    order = F.struct(*[F.col(f"`{c}`") for c in tie]) if tie else F.lit(None).cast("struct<x:int>")
    kind = right.select(state.alias("s")).schema["s"].dataType
    rows = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__row"), _key(by).alias(_KEY), micros(F.col(f"`{left_time}`")).alias(_T),
                       F.lit(0 if strict else 1).alias(_SIDE), F.lit(None).cast(kind).alias("__state"))
    states = right.select(_key(by).alias(_KEY), micros(F.col(f"`{right_time}`")).alias(_T), F.lit(1 if strict else 0).alias(_SIDE), state.alias("__state"), order.alias("__tie"))
    usable = F.col(_T).isNotNull()
    for i in range(len(by)):
        usable = usable & F.col(f"{_KEY}.`{by[i]}`").isNotNull()
    # one state for a key and time: the greatest of those that tie
    states = states.filter(usable).groupBy(_KEY, _T, _SIDE).agg(F.max_by("__state", F.struct("__tie", "__state")).alias("__state"))
    places = cut_lineage(rows.select(_KEY, _T).unionByName(states.select(_KEY, _T)))
    number, ranges = range_number(places, [_KEY, _T])
    both = rows.unionByName(states, allowMissingColumns=True).withColumn(_PART, number).repartitionById(ranges, _PART)
    inside = W.partitionBy(_PART, _KEY).orderBy(_T, _SIDE).rowsBetween(W.unboundedPreceding, W.currentRow)
    met = both.withColumn("__found", F.last("__state", ignorenulls=True).over(inside))
    # the last state of each key of a range; only a range's last key goes on, so one row a range is kept
    numbered = states.withColumn(_PART, number)
    last = numbered.groupBy(_PART, _KEY).agg(F.max_by("__state", _T).alias("__state"))
    ends = places.withColumn(_PART, number).groupBy(_PART).agg(F.max(_KEY).alias(_KEY))
    handed = ends.join(last, [_PART, _KEY], "left")
    firsts = places.withColumn(_PART, number).groupBy(F.col(_PART).alias("__to")).agg(F.min(_KEY).alias("__first"))
    carried = firsts.join(handed, (F.col("__first") == F.col(_KEY)) & (F.col(_PART) < F.col("__to")) & F.col("__state").isNotNull())
    carried = carried.groupBy("__to", "__first").agg(F.max_by("__state", _PART).alias("__carried"))
    out = met.filter("__row is not null").join(
        measured_broadcast(carried), (F.col(_PART) == F.col("__to")) & (F.col(_KEY) == F.col("__first")), "left")
    found = F.coalesce("__found", "__carried")
    usable_left = F.col(_T).isNotNull()
    return out.select("__row.*", *[F.when(usable_left, found[f"__c{i}"]).alias(name) for i, name in enumerate(columns.values())])


# --- points in intervals ---------------------------------------------------------------------------------

def _segments(first: Column, last: Column, top: int) -> Column:
    """The maximal aligned blocks of 2^level units that make up first..last, level at most `top`."""
    def at(level: int) -> Column:
        # what is left at this level, after odd ends were cut off below
        size = F.lit(1 << level)
        lo, hi = F.ceil(first / size).cast("long"), F.floor((last + 1) / size).cast("long")
        if level == top:
            return F.when(lo < hi, F.transform(F.sequence(lo, hi - 1), lambda b: F.struct(F.lit(level).alias("level"), b.alias("block")))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))
        left = F.when((lo < hi) & (lo % 2 != 0), F.array(F.struct(F.lit(level).alias("level"), lo.alias("block"))))
        right = F.when((lo < hi) & (hi % 2 != 0) & ~((lo % 2 != 0) & (hi == lo + 1)), F.array(F.struct(F.lit(level).alias("level"), (hi - 1).alias("block"))))
        none = F.array().cast("array<struct<level:int,block:bigint>>")
        return F.concat(F.coalesce(left, none), F.coalesce(right, none))
    return F.concat(*[at(level) for level in range(top + 1)])


def interval_join(
    points: DataFrame, intervals: DataFrame, by: Sequence[str], time: str, start: str, end: str, unit_seconds: float = 60.0, how: str = "inner",
) -> DataFrame:
    """Pairs of a point and an interval of its key with start <= time < end; columns of both sides, the key once.

    Time is cut into units; an interval becomes at most two segments a level and a point looks up the segments
    above it, so the join is on equal (key, level, block). Levels end where a block holds about one point in as
    many as there are tasks, so no segment gathers an unbounded share of the points. Exact times are compared
    after that. `how='left'` keeps points without an interval. Empty intervals and nulls meet nothing.
    """
    by, spark = list(by), points.sparkSession
    unit = max(1, round(unit_seconds * 1_000_000))
    clash = set(points.columns) & set(intervals.columns) - set(by)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    lo, hi = micros(F.col(f"`{start}`")), micros(F.col(f"`{end}`"))
    bounds = points.agg(F.min(micros(F.col(f"`{time}`"))).alias("a"), F.max(micros(F.col(f"`{time}`"))).alias("b")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    units = 1 if bounds["a"] is None else (bounds["b"] - bounds["a"]) // unit + 1
    top = max(0, (units // tasks).bit_length() - 1)
    # parts of an interval without any point are of no use
    first_point, last_point = (0, 0) if bounds["a"] is None else (bounds["a"] // unit, bounds["b"] // unit)
    first = F.greatest(F.floor(lo / unit).cast("long"), F.lit(first_point))
    last = F.least(F.floor((hi - 1) / unit).cast("long"), F.lit(last_point))
    cut = intervals.filter((lo < hi) & (lo <= F.lit(bounds["b"] or 0)) & (hi > F.lit(bounds["a"] or 0))).withColumn("__s", F.explode(_segments(first, last, top)))
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.floor(F.floor(micros(F.col(f"`{time}`")) / unit) / F.lit(1 << i)).cast("long").alias("block")) for i in range(top + 1)])
    looked = points.withColumn("__s", F.explode(levels))
    key = [*by, "__level", "__block"]
    right = cut.withColumns({"__level": F.col("__s.level"), "__block": F.col("__s.block")}).drop("__s")
    left = looked.withColumns({"__level": F.col("__s.level"), "__block": F.col("__s.block")}).drop("__s")
    moment = micros(F.col(f"`{time}`"))
    met = left.join(right, key).filter((moment >= lo) & (moment < hi)).drop("__level", "__block")
    if how == "inner":
        return met
    given = points.withColumn("__id", F.monotonically_increasing_id())
    given = cut_lineage(given)
    pairs = interval_join(given, intervals, by, time, start, end, unit_seconds)
    alone = given.join(pairs.select("__id").distinct(), "__id", "left_anti")
    return pairs.unionByName(alone, allowMissingColumns=True).drop("__id")


# --- trailing time -------------------------------------------------------------------------------------------

def _added(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


# How values over two parts of the rows make the value over all of them.
MERGES = {"count": _added, "sum": _added, "max": F.greatest, "min": F.least}


def trailing(
    df: DataFrame, by: Sequence[str], time: str, seconds: float, aggregates: Mapping[str, Column], kinds: Mapping[str, str] | None = None,
) -> DataFrame:
    """Each row with aggregates over the rows of its key from `seconds` before it up to its own time, rows of the same
    time included, as a RANGE frame has it.

    A range of (key, time) also gets the earlier rows that its first moments reach back to: its halo. A row goes
    to as many ranges as the trailing time after it covers. Rows without a time see only each other.

    `kinds` names the aggregates as in MERGES. With all of them named the work is linear in the rows, however many a frame
    has: time is cut into blocks of the frame's width, so a frame is the beginning of its own block and the end of the one
    before. Otherwise Spark's sliding frame reads each frame anew.
    """
    by, width = list(by), round(seconds * 1_000_000)
    names = df.columns
    rows = df.withColumns({_T: micros(F.col(f"`{time}`")), _KEY: _key(by)})
    places = cut_lineage(rows.select(_KEY, _T))
    number, ranges = range_number(places, [_KEY, _T])
    rows = rows.withColumn(_PART, number)
    # where each range begins: one row a range
    firsts = places.withColumn(_PART, number).groupBy(F.col(_PART).alias("__to")).agg(F.min(F.struct(_KEY, _T)).alias("f"))
    firsts = measured_broadcast(firsts.select("__to", F.col(f"f.{_KEY}").alias("__first"), F.col(f"f.{_T}").alias("__from")))
    reach = F.col(_KEY).eqNullSafe(F.col("__first")) & (F.col(_PART) < F.col("__to")) & (F.col(_T) >= F.col("__from") - F.lit(width))
    halo = rows.join(firsts, reach).drop(_PART, "__first", "__from").withColumnRenamed("__to", _PART)
    dealt = rows.withColumn("__own", F.lit(True)).unionByName(halo.withColumn("__own", F.lit(False))).repartitionById(ranges, _PART)
    if width > 0 and kinds is not None and set(aggregates) <= set(kinds):
        return _by_blocks(dealt, names, width, aggregates, kinds)
    frame = W.partitionBy(_PART, _KEY).orderBy(_T).rangeBetween(-width, W.currentRow)
    return dealt.select(*names, "__own", *[a.over(frame).alias(n) for n, a in aggregates.items()]).filter("__own").drop("__own")


def _by_blocks(dealt: DataFrame, names: Sequence[str], width: int, aggregates: Mapping[str, Column], kinds: Mapping[str, str]) -> DataFrame:
    """The frames of `trailing` from running values: up to each row in its block, and from each row to the end of its block."""
    block = "__block"
    frame = W.partitionBy(_PART, _KEY, block)
    up = frame.orderBy(_T).rangeBetween(W.unboundedPreceding, W.currentRow)
    down = frame.orderBy(F.desc(_T)).rangeBetween(W.unboundedPreceding, W.currentRow)
    state = lambda over: F.struct(*[a.over(over).alias(n) for n, a in aggregates.items()])
    cut = dealt.withColumn(block, F.floor(F.col(_T) / F.lit(width)).cast("long"))
    running = cut.withColumn("__head", state(up)).withColumn("__tail", state(down))
    # a row stands in its block with its tail, and asks at its frame's start in the block before
    stands = F.struct(F.lit(False).alias("asks"), F.col(block).alias("b"), F.col(_T).alias("t"))
    asks = F.struct(F.lit(True).alias("asks"), (F.col(block) - 1).alias("b"), (F.col(_T) - F.lit(width)).alias("t"))
    twice = running.withColumn("__as", F.explode(F.when(F.col("__own"), F.array(stands, asks)).otherwise(F.array(stands))))
    placed = twice.withColumns({block: F.col("__as.b"), _T: F.col("__as.t"), "__asks": F.col("__as.asks")})
    # rows of one time have one tail
    met = F.last(F.when(~F.col("__asks") & F.col(_T).isNotNull(), F.col("__tail")), ignorenulls=True).over(down)
    found = placed.withColumn("__met", met).filter("__asks")
    return found.select(*names, *[
        F.when(F.col("__met").isNull(), F.col(f"__head.{n}")).otherwise(MERGES[kinds[n]](F.col(f"__head.{n}"), F.col(f"__met.{n}"))).alias(n)
        for n in aggregates])
