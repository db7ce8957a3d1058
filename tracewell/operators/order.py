"""Total order at scale: positions in a case, running sums over a global order, quantiles.

A window without a partition key, or with one huge key, runs in one task. The helpers here
give the rows to ranges instead, sum inside each range, and add the total of the ranges
before it. Equal order values are merged first, so a tie never spans two ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.tables import measured_broadcast
from tracewell.session import cut_lineage
from tracewell.spec import ACTIVITY, CASE, ORDER_KEY, POS, TS

# A key with more rows than this is ordered by ranges instead of in one task.
MAX_ROWS_PER_TASK = 5_000_000

_PART = "__range"
# Rows a range holds on average at most, and sampled rows for each range when its bounds are chosen.
ROWS_PER_RANGE, SAMPLED = 5_000_000, 100
# Up to this many cuts are compiled as nested comparisons; more are searched in a literal array.
_NESTED_CUTS = 512


def range_of(key: Column, cuts: Sequence[Column]) -> Column:
    """Number of cuts at or below the key, by halving."""
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < cuts[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    if len(cuts) <= _NESTED_CUTS:
        return search(0, len(cuts))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    table = F.array(*cuts)
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(table, at + step - 1) <= key, step).otherwise(0))


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields)])
    return F.lit(value).cast(kind)


def range_number(df: DataFrame, sort_cols: Sequence[str], ranges: int | None = None) -> tuple[Column, int]:
    """(range number of a row with columns `sort_cols`, number of ranges): sorted ranges of about equal size.

    The bounds are literals from a sample of SAMPLED rows a range, so a range is a function of
    the row's own values and the same in every run of the plan, and for every table with these
    columns. There are as many ranges as shuffle partitions, and more where ROWS_PER_RANGE asks for them.
    """
    spark = df.sparkSession
    narrow = df.select(*[F.col(f"`{c}`") for c in sort_cols])
    rows = narrow.count()
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_RANGE))
    sample = narrow.sample(min(1.0, SAMPLED * ranges / max(rows, 1)), 7) if rows > SAMPLED * ranges else narrow
    ordered = sample.orderBy(*sort_cols).collect()
    step = len(ordered) / ranges
    cuts = list(dict.fromkeys(ordered[int(i * step)] for i in range(1, ranges))) if ordered else []
    kinds = [f.dataType for f in narrow.schema.fields]
    literals = [F.struct(*[_literal(v, kind) for v, kind in zip(row, kinds)]) for row in cuts]
    # structs compare field by field with nulls first, as the sort does
    return range_of(F.struct(*[F.col(f"`{c}`") for c in sort_cols]), literals).cast("int"), ranges


def _with_range_number(df: DataFrame, sort_cols: Sequence[str]) -> DataFrame:
    """Rows spread over sorted ranges of `sort_cols`, with the number of the range, by one shuffle;
    each range is a task of its own."""
    number, ranges = range_number(df, sort_cols)
    return df.withColumn(_PART, number).repartitionById(ranges, _PART)


def _add_offsets(
    local: DataFrame, totals: DataFrame, keys: Sequence[str], running: Sequence[str]
) -> DataFrame:
    """Add to each range's own running values the sum of the ranges before it.

    `totals` has one row per range and key, so its windows are small; they also give the key's
    grand total as `total_*`.
    """
    before = W.partitionBy(*keys).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    everywhere = W.partitionBy(*keys)
    offsets = measured_broadcast(totals.select(
        *keys,
        _PART,
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__before_{c}") for c in running],
        *[F.sum(c).over(everywhere).alias(f"__total_{c}") for c in running],
    ))
    condition = F.col(f"l.{_PART}") == F.col(f"o.{_PART}")
    for k in keys:
        condition = condition & F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}"))
    joined = local.alias("l").join(offsets.alias("o"), condition)
    kept = [c for c in local.columns if c not in running and c != _PART]
    return joined.select(
        *[F.col(f"l.{c}").alias(c) for c in kept],
        *[(F.col(f"l.{c}") + F.col(f"o.__before_{c}")).alias(c) for c in running],
        *[F.col(f"o.__total_{c}").alias(c.replace("cum_", "total_")) for c in running if c.startswith("cum_")],
    )


def ordered_cumsum(
    df: DataFrame,
    order_cols: Sequence[str],
    sums: Mapping[str, Column],
    keys: Sequence[str] = (),
) -> DataFrame:
    """One row per (keys, order value) with each sum, its inclusive running total `cum_*` and the
    key's grand total `total_*`.

    `sums` maps an output name to the expression that is summed. Works the same for one key
    holding every row as for many small keys. The merged rows are checkpointed, since bounds,
    totals and rows all look at them.
    """
    keys, order_cols = list(keys), list(order_cols)
    merged = cut_lineage(df.groupBy(*keys, *order_cols).agg(*[F.sum(e).alias(n) for n, e in sums.items()]))
    inside = (
        W.partitionBy(_PART, *keys)
        .orderBy(*order_cols)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    running = [f"cum_{n}" for n in sums]
    local = _with_range_number(merged, keys + order_cols).select(
        "*", *[F.sum(n).over(inside).alias(f"cum_{n}") for n in sums]
    )
    totals = local.groupBy(_PART, *keys).agg(*[F.sum(n).alias(f"cum_{n}") for n in sums])
    return _add_offsets(local, totals, keys, running)


def ranged_row_number(
    df: DataFrame, order_cols: Sequence[str], keys: Sequence[str], name: str
) -> DataFrame:
    """`row_number` per key for keys too large for one task; `order_cols` must be unique."""
    keys, order_cols = list(keys), list(order_cols)
    inside = W.partitionBy(_PART, *keys).orderBy(*order_cols)
    local = _with_range_number(df, keys + order_cols).withColumn(name, F.row_number().over(inside).cast("long"))
    totals = local.groupBy(_PART, *keys).agg(F.count(F.lit(1)).alias(name))
    return _add_offsets(local, totals, keys, [name])


_measured: dict[tuple, list] = {}


def oversized_keys(df: DataFrame, key: str, max_rows: int) -> DataFrame | None:
    """Keys with more than `max_rows` rows, or None. There are at most rows / max_rows of them.

    A log is measured once in a session, however many plans are made over it: what is remembered only decides how
    a key is ordered, not the result.
    """
    spark = df.sparkSession
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    asked = (spark.sparkContext.applicationId, counts.semanticHash(), max_rows)
    if asked not in _measured:
        _measured[asked] = [r[0] for r in counts.filter(F.col("n") > max_rows).select(key).collect()]
    return spark.createDataFrame([(k,) for k in _measured[asked]], counts.select(key).schema) if _measured[asked] else None


def order_events(log: DataFrame, max_case_rows: int = MAX_ROWS_PER_TASK) -> DataFrame:
    """Add `event_pos`: 1-based position by (ts, order_key) within the case.

    Ordinary cases take one window by case, whose partitioning later `groupBy(case_id)` steps
    reuse. Cases above `max_case_rows` are ordered by ranges; a log is measured for them once.
    """
    window = W.partitionBy(CASE).orderBy(TS, ORDER_KEY)
    position = F.row_number().over(window).cast("long")
    hot = oversized_keys(log, CASE, max_case_rows)
    if hot is None:
        return log.withColumn(POS, position)
    small = log.join(F.broadcast(hot), CASE, "left_anti").withColumn(POS, position)
    large = ranged_row_number(log.join(F.broadcast(hot), CASE, "left_semi"), [TS, ORDER_KEY], [CASE], POS)
    return small.unionByName(large)


def core_columns(log: DataFrame) -> DataFrame:
    """The four columns that labels and positions need."""
    return log.select(CASE, ACTIVITY, TS, ORDER_KEY)


def first_events(log: DataFrame, k: int) -> DataFrame:
    """The first k events of every case with `event_pos`.

    Spark keeps k rows per case in each input task (WindowGroupLimit) before the shuffle, so a
    huge case sends k rows per task and needs no special path.
    """
    window = W.partitionBy(CASE).orderBy(TS, ORDER_KEY)
    first = log.withColumn(POS, F.row_number().over(window)).filter(F.col(POS) <= k)
    return first.withColumn(POS, F.col(POS).cast("long"))


def exact_quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact linear-interpolation quantiles per key, one column per entry of `probs`.

    Spark's `percentile` holds every distinct value of a group in one buffer; this reads the
    two neighbouring ranks off the running counts instead. Null values and null keys are
    dropped.
    """
    keys = list(keys)
    clean = df.select(*keys, F.col(value).cast("double").alias("__v")).dropna()
    cum = ordered_cumsum(clean, ["__v"], {"n": F.lit(1)}, keys)
    aggs = []
    for name, p in probs.items():
        h = (F.col("total_n") - 1) * F.lit(float(p))
        lo = F.min(F.when(F.col("cum_n") >= F.floor(h) + 1, F.col("__v")))
        hi = F.min(F.when(F.col("cum_n") >= F.ceil(h) + 1, F.col("__v")))
        frac = F.max(h - F.floor(h))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    return cum.groupBy(*keys).agg(*aggs) if keys else cum.agg(*aggs)
