"""Small column expressions. Everything here stays on the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def n_rows(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def count_where(condition: Column) -> Column:
    """Rows where the condition holds; 0 (not null) on an empty input."""
    return F.count(F.when(condition, F.lit(1)))


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0 when the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def percent(num: Column, den: Column) -> Column:
    return F.when(den != 0, num.cast("double") * 100.0 / den.cast("double"))


def is_zoneless(ts: Column) -> Column:
    """Whether a timestamp column has no time zone; a constant once the plan is analysed."""
    return F.typeof(ts) == "timestamp_ntz"


def micros(ts: Column) -> Column:
    """Epoch microseconds; a timestamp without time zone counts as UTC in any session zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    zoneless = F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz"))
    return F.when(is_zoneless(ts), zoneless).otherwise(F.unix_micros(ts.cast("timestamp")))


def mapped(key: Column, table: Mapping[str, object]) -> Column:
    """Look a value up in a small declared table; null when absent."""
    pairs: list[Column] = []
    for k, v in table.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)[key]


def skew_unbiased(col: Column) -> Column:
    """Sample skewness G1 = g1 * sqrt(n(n-1)) / (n-2); Spark's own is the population g1."""
    n = F.count(col).cast("double")
    return F.when(n > 2, F.skewness(col) * F.sqrt(n * (n - 1)) / (n - 2))


def distinct_with_null(col: Column) -> Column:
    """Distinct values with null counted as one more value."""
    return F.count_distinct(col) + F.max(col.isNull().cast("int"))


def scalar(df: DataFrame, expr: Column | str) -> Column:
    """A one-row result used as a value inside another query (scalar subquery)."""
    return df.select(F.expr(expr) if isinstance(expr, str) else expr).scalar()


def rounded(df: DataFrame, digits: int = 6, columns: Iterable[str] | None = None) -> DataFrame:
    """Round the double columns; adding 0.0 turns -0.0 into 0.0."""
    wanted = set(columns) if columns is not None else None
    out = []
    for name, dtype in df.dtypes:
        if dtype in ("double", "float") and (wanted is None or name in wanted):
            out.append((F.round(F.col(f"`{name}`").cast("double"), digits) + F.lit(0.0)).alias(name))
        else:
            out.append(F.col(f"`{name}`"))
    return df.select(*out)
