"""Reusable checks. Each gives rows (check, status, observed, expected)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import count_where, n_rows, scalar

CHECK_COLUMNS = ["check", "status", "observed", "expected"]


class ContractError(ValueError):
    """A strict check failed."""


def _row(df: DataFrame, name: str, ok: Column, observed: Column, expected: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("check"),
        F.when(ok, "PASS").otherwise("FAIL").alias("status"),
        observed.cast("string").alias("observed"),
        expected.cast("string").alias("expected"),
    )


def union_checks(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def enforce(checks: DataFrame) -> DataFrame:
    """Run the checks and raise on the first failures; one row per check reaches the driver."""
    failed = checks.filter(F.col("status") != "PASS").limit(20).collect()
    if failed:
        raise ContractError("; ".join(f"{r.check}: {r.observed} != {r.expected}" for r in failed))
    return checks


def check_required_columns(df: DataFrame, columns: Sequence[str], exact: bool = False) -> DataFrame:
    """Columns are present, or are exactly this list in this order."""
    missing = [c for c in columns if c not in df.columns]
    ok = df.columns == list(columns) if exact else not missing
    observed = ",".join(df.columns) if exact else ",".join(missing)
    expected = ",".join(columns) if exact else ""
    name = "exact_columns" if exact else "required_columns"
    return df.sparkSession.createDataFrame(
        [(name, "PASS" if ok else "FAIL", observed, expected)],
        "check string, status string, observed string, expected string",
    )


def check_stored_columns(spark, path: str, columns: Sequence[str], exact: bool = False) -> DataFrame:
    """The columns of a written table, and that all its files can be read with them."""
    back = spark.read.parquet(path)
    named = check_required_columns(back, columns, exact)
    one = back.agg(n_rows("n"))
    return union_checks([named, _row(one, "readable_rows", F.col("n") > 0, F.col("n"), F.lit("some"))])


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    nulls = df.agg(*[count_where(F.col(c).isNull()).alias(c) for c in columns])
    long = nulls.unpivot([], list(columns), "column", "n")
    return _checks_per_row(long, F.concat(F.lit("not_null:"), F.col("column")), F.col("n") == 0,
                           F.col("n"), F.lit(0))


def _checks_per_row(df: DataFrame, name: Column, ok: Column, observed: Column, expected: Column) -> DataFrame:
    return df.select(
        name.alias("check"),
        F.when(ok, "PASS").otherwise("FAIL").alias("status"),
        observed.cast("string").alias("observed"),
        expected.cast("string").alias("expected"),
    )


def check_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows beyond the first per key; nulls compare equal."""
    groups = df.groupBy(*key).agg(n_rows())
    extra = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))
    return _row(extra, "unique:" + ",".join(key), F.col("extra") == 0, F.col("extra"), F.lit(0))


def check_disjoint(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """No key occurs on both sides."""
    sides = left.select(key, F.lit(1).alias("side")).unionByName(right.select(key, F.lit(2).alias("side")))
    both = sides.groupBy(key).agg(F.min("side").alias("a"), F.max("side").alias("b"))
    out = both.agg(count_where(F.col("a") != F.col("b")).alias("n"))
    return _row(out, f"disjoint:{key}", F.col("n") == 0, F.col("n"), F.lit(0))


def check_cover(parts: Sequence[DataFrame], whole: DataFrame, key: str) -> DataFrame:
    """The parts together hold exactly the whole's keys, each as often."""
    signed = [p.select(key, F.lit(1).alias("w")) for p in parts]
    signed.append(whole.select(key, F.lit(-1).alias("w")))
    diff = reduce(DataFrame.unionByName, signed).groupBy(key).agg(F.sum("w").alias("w"))
    out = diff.agg(count_where(F.col("w") != 0).alias("n"))
    return _row(out, f"cover:{key}", F.col("n") == 0, F.col("n"), F.lit(0))


def check_strict_time_order(df: DataFrame, part: str, ts: str, order: Sequence[str]) -> DataFrame:
    """max(earlier part) < min(next part) for each neighbouring pair in `order`."""
    spans = {
        p: (F.max(F.when(F.col(part) == p, F.col(ts))).alias(f"max_{i}"),
            F.min(F.when(F.col(part) == p, F.col(ts))).alias(f"min_{i}"))
        for i, p in enumerate(order)
    }
    one = df.agg(*[c for pair in spans.values() for c in pair])
    checks = []
    for i in range(len(order) - 1):
        earlier, later = F.col(f"max_{i}"), F.col(f"min_{i + 1}")
        checks.append(_row(one, f"time_order:{order[i]}<{order[i + 1]}",
                           F.coalesce(earlier < later, F.lit(False)),
                           F.coalesce(earlier < later, F.lit(False)), F.lit(True)))
    return union_checks(checks)


def check_domain(
    df: DataFrame,
    column: str,
    values: Sequence | None = None,
    low: float | None = None,
    high: float | None = None,
) -> DataFrame:
    """Values lie in a set and/or a closed interval; null, NaN and infinity are outside."""
    c = F.col(column)
    inside = c.isNotNull()
    if values is not None:
        inside = inside & c.isin(list(values))
    if low is not None:
        inside = inside & (c >= low)
    if high is not None:
        inside = inside & (c <= high)
    if dict(df.dtypes)[column] in ("double", "float"):
        inside = inside & ~F.isnan(c) & (F.abs(c) != float("inf"))
    out = df.agg(count_where(~F.coalesce(inside, F.lit(False))).alias("n"))
    return _row(out, f"domain:{column}", F.col("n") == 0, F.col("n"), F.lit(0))


def check_leakage(prefix: DataFrame, outcomes: Sequence[str], k: int, forbidden: Sequence[str] = ()) -> DataFrame:
    """No outcome activity and no position beyond k in the prefix; forbidden columns absent."""
    one = prefix.agg(
        count_where(F.col("activity").isin(list(outcomes))).alias("outcomes"),
        count_where(F.col("event_pos") > k).alias("future"),
    )
    present = sorted(set(forbidden) & set(prefix.columns))
    return union_checks([
        _row(one, "no_outcome_in_prefix", F.col("outcomes") == 0, F.col("outcomes"), F.lit(0)),
        _row(one, "no_future_event", F.col("future") == 0, F.col("future"), F.lit(0)),
        _row(one, "forbidden_columns_absent", F.lit(not present), F.lit(len(present)), F.lit(0)),
    ])


def check_counts(df: DataFrame, expected: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """Named aggregates equal expected integers: {name: (aggregate, expected)}."""
    one = df.agg(*[agg.alias(f"c{i}") for i, (agg, _) in enumerate(expected.values())])
    return union_checks([
        _row(one, f"count:{name}", F.col(f"c{i}") == F.lit(want), F.col(f"c{i}"), F.lit(want))
        for i, (name, (_, want)) in enumerate(expected.items())
    ])


def check_close(
    measured: DataFrame, stored: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float
) -> DataFrame:
    """Every stored value is reproduced within the tolerance; a missing row counts as a miss."""
    cond = reduce(lambda a, b: a & b, [F.col(f"m.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    joined = measured.alias("m").join(stored.alias("s"), cond, "full_outer")
    misses = joined.agg(*[
        count_where(
            ~F.coalesce(F.abs(F.col(f"m.{c}") - F.col(f"s.{c}")) <= tolerance, F.lit(False))
            & ~(F.col(f"m.{c}").isNull() & F.col(f"s.{c}").isNull()
                & F.col(f"m.{keys[0]}").isNotNull() & F.col(f"s.{keys[0]}").isNotNull())
        ).alias(c)
        for c in columns
    ])
    long = misses.unpivot([], list(columns), "column", "n")
    return _checks_per_row(long, F.concat(F.lit("close:"), F.col("column")), F.col("n") == 0,
                           F.col("n"), F.lit(0))


def check_equal_total(df: DataFrame, name: str, total: Column, expected: DataFrame, expected_total: Column) -> DataFrame:
    """An aggregate of one table equals an aggregate of another."""
    one = df.agg(total.alias("t")).withColumn("e", scalar(expected, expected_total))
    return _row(one, name, F.col("t") == F.col("e"), F.col("t"), F.col("e"))


def row_digest(columns: Sequence[str]) -> Column:
    """md5 of a row: each field as its length and text, null as `n`, so different rows have different texts."""
    cols = [F.col(f"`{c}`").cast("string") for c in columns]
    fields = [F.when(c.isNull(), "n").otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c)) for c in cols]
    return F.md5(F.concat_ws("|", *fields))


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-insensitive content hash: row count and two sums over the digest of each row.

    The sums are decimals, so they cannot overflow at any realistic row count.
    """
    return df.select(row_digest(columns or df.columns).alias("d")).agg(
        n_rows("row_count"),
        F.coalesce(F.sum(F.conv(F.substring("d", 1, 8), 16, 10).cast("decimal(20,0)")), F.lit(0))
        .cast("string").alias("hash_a"),
        F.coalesce(F.sum(F.conv(F.substring("d", 9, 8), 16, 10).cast("decimal(20,0)")), F.lit(0))
        .cast("string").alias("hash_b"),
    )
