"""From source tables to a normalized event log, and checked sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.columns import count_where, mapped, micros, n_rows
from tracewell.operators.contracts import check_not_null, check_required_columns, check_unique, enforce, union_checks
from tracewell.spec import ACTIVITY, CASE, ORDER_KEY, TS, LogSpec


def normalize_log(source: DataFrame, spec: LogSpec, strict: bool = False) -> DataFrame:
    """Rename the declared columns to canonical names and parse the timestamp as UTC.

    Strict mode runs the core contract: columns present, core values non-null, the order key
    unique within (case, ts).
    """
    if strict:
        enforce(check_required_columns(source, [spec.case, spec.activity, spec.ts, spec.order_key]))
    ts: Column = F.col(spec.ts)
    if dict(source.dtypes)[spec.ts] == "string":
        ts = parsed_time(ts)
    log = source.select(
        F.col(spec.case).alias(CASE),
        F.col(spec.activity).alias(ACTIVITY),
        ts.alias(TS),
        F.col(spec.order_key).alias(ORDER_KEY),
        *spec.static_cols,
        *spec.event_cols,
    )
    if strict:
        enforce(core_contract(log))
    return log


def parsed_time(text: Column) -> Column:
    """A text time as a timestamp; without a zone it is UTC, in any session zone."""
    zoned = text.rlike(r"([Zz]|[+-][0-9]{2}:?[0-9]{2}|UTC|GMT)\s*$")
    utc = F.timestamp_micros(micros(F.to_timestamp_ntz(text)))
    return F.when(zoned, F.to_timestamp(text)).otherwise(F.when(~zoned, utc))


def core_contract(log: DataFrame) -> DataFrame:
    """Core columns complete and the order within a case unambiguous."""
    return union_checks([
        check_not_null(log, [CASE, ACTIVITY, TS, ORDER_KEY]),
        check_unique(log, [CASE, TS, ORDER_KEY]),
    ])


def with_source_names(df: DataFrame, spec: LogSpec, column: str = "feature") -> DataFrame:
    """Show the source's own names for the canonical core columns in a report column."""
    names = {CASE: spec.case, ACTIVITY: spec.activity, TS: spec.ts, ORDER_KEY: spec.order_key}
    return df.withColumn(column, F.coalesce(mapped(F.col(column), names), F.col(column)))


def normalization_summary(log: DataFrame) -> DataFrame:
    """Rows and null counts of the core columns in one pass."""
    return log.agg(
        n_rows("events"),
        *[count_where(F.col(c).isNull()).alias(f"null_{c}") for c in (CASE, ACTIVITY, TS)],
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with an explicit schema: ids stay strings, nothing is inferred, and a header that names
    other columns fails the read."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("escape", '"').csv(path)


def write_checked(df: DataFrame, path: str, key: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Write, read back with the same schema, and give the round-trip checks.

    Both sides are compared by key count in one aggregation, so neither is collected.
    """
    spark = df.sparkSession
    writer = df.write.mode("errorifexists")
    if fmt == "parquet":
        writer.parquet(path)
        back = written = spark.read.parquet(path)
    elif fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
        back = read_csv(spark, path, df.schema)
        written = spark.read.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown format: {fmt}")
    sides = df.select(*key, F.lit(1).alias("w")).unionByName(back.select(*key, F.lit(-1).alias("w")))
    diff = sides.groupBy(*key).agg(F.sum("w").alias("w")).agg(count_where(F.col("w") != 0).alias("n"))
    same_keys = diff.select(
        F.lit("same_keys").alias("check"),
        F.when(F.col("n") == 0, "PASS").otherwise("FAIL").alias("status"),
        F.col("n").cast("string").alias("observed"),
        F.lit("0").alias("expected"),
    )
    return union_checks([
        check_required_columns(written, df.columns, exact=True),
        same_keys,
        check_unique(back, key),
    ])
