"""Log profiling: shape, nulls, duplicates, distributions, trace lengths, outcomes.

Counts are aggregated before they are reshaped, so no profile multiplies the log's rows unless
it needs value counts. Totals enter as scalar subqueries.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import (
    count_where, distinct_with_null, mapped, n_rows, percent, scalar, skew_unbiased,
)
from tracewell.operators.order import exact_quantiles
from tracewell.spec import ACTIVITY, CASE, ORDER_KEY, TS


def _text(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).cast("string").alias(c) for c in columns]


def _unpivot_row(one_row: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    return one_row.unpivot([], list(columns), name, value)


# --- shape -----------------------------------------------------------------------------

def schema_overview(log: DataFrame) -> DataFrame:
    """Row count beside each column's position, name and type."""
    rows = [(i, c, t) for i, (c, t) in enumerate(log.dtypes)]
    schema = log.sparkSession.createDataFrame(rows, "position int, column string, data_type string")
    return schema.withColumn("row_count", scalar(log, F.count(F.lit(1))))


def first_rows(log: DataFrame, n: int = 5) -> DataFrame:
    return log.orderBy(ORDER_KEY).limit(n)


def log_overview(log: DataFrame) -> DataFrame:
    return log.agg(
        n_rows("events"),
        F.count_distinct(CASE).alias("cases"),
        F.count_distinct(ACTIVITY).alias("activities"),
        F.min(TS).alias("start_time"),
        F.max(TS).alias("end_time"),
    )


def distinct_activities(log: DataFrame) -> DataFrame:
    return log.filter(F.col(ACTIVITY).isNotNull()).select(ACTIVITY).distinct().orderBy(ACTIVITY)


def column_cardinality(log: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column.

    Exact mode counts (column, value) pairs after map-side merging rather than expanding one
    multi-distinct aggregate per column; approximate mode is one sketch pass.
    """
    if approximate:
        one = log.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        return _unpivot_row(one, columns, "column", "distinct_values")
    pairs = log.select(*_text(columns)).unpivot([], list(columns), "column", "value")
    seen = pairs.groupBy("column", "value").agg(n_rows("rows"))
    return seen.groupBy("column").agg(F.count("value").alias("distinct_values"))


# --- nulls and value counts -------------------------------------------------------------

def missing_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count and percent per column in one aggregation, worst first."""
    one = df.agg(n_rows("__rows"), *[count_where(F.col(c).isNull()).alias(c) for c in columns])
    long = one.unpivot(["__rows"], list(columns), "column", "missing_count")
    return long.select(
        "column", "missing_count", percent(F.col("missing_count"), F.col("__rows")).alias("missing_percent")
    ).orderBy(F.desc("missing_percent"), "column")


def categorical_profile(log: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value counts per column; null is a value."""
    pairs = log.select(*_text(columns)).unpivot([], list(columns), "column", "value")
    return pairs.groupBy("column", "value").agg(n_rows("row_count"))


def attribute_location(
    log: DataFrame, attributes: Sequence[str], by: Sequence[str] = (ACTIVITY,)
) -> DataFrame:
    """Where each sparse attribute is filled: non-null rows per attribute and context value."""
    counts = log.groupBy(*by).agg(*[F.count(a).alias(a) for a in attributes])
    long = counts.unpivot(list(by), list(attributes), "attribute", "row_count")
    return long.filter("row_count > 0")


# --- duplicates -------------------------------------------------------------------------

def duplicate_count(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key, and all rows of repeated keys; nulls compare equal."""
    groups = df.groupBy(*key).agg(n_rows())
    n = F.col("n")
    return groups.agg(
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("extra_rows"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("rows_involved"),
    )


def duplicate_members(df: DataFrame, key: Sequence[str], order: Sequence[str], limit: int = 20) -> DataFrame:
    """The first rows of repeated keys by `order`, which must start with the key.

    The first `limit` repeated keys cover them, so only those keys are sent to the log.
    """
    repeated = df.groupBy(*key).agg(n_rows()).filter("n > 1").drop("n")
    lead = [c for c in order if c in key]
    first_keys = repeated.orderBy(*lead).limit(limit)
    return df.join(F.broadcast(first_keys), list(key), "left_semi").orderBy(*order).limit(limit)


# --- case attributes --------------------------------------------------------------------

def case_attr_consistency(log: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Cases where an attribute takes more than one value, null counted as a value.

    min, max and the null flag decide this without a distinct aggregation.
    """
    varies = [
        (F.coalesce(F.min(a) != F.max(a), F.lit(False))
         | ((F.count(a) > 0) & (F.count(a) < F.count(F.lit(1))))).alias(a)
        for a in attributes
    ]
    per_case = log.groupBy(CASE).agg(*varies)
    one = per_case.agg(*[count_where(F.col(a)).alias(a) for a in attributes])
    return _unpivot_row(one, attributes, "attribute", "inconsistent_cases")


def inconsistent_case_rows(log: DataFrame, attribute: str, cases: int = 5) -> DataFrame:
    """The rows of the first few inconsistent cases of one attribute."""
    bad = log.groupBy(CASE).agg(distinct_with_null(F.col(attribute)).alias("n")).filter("n > 1")
    few = bad.select(CASE).orderBy(CASE).limit(cases)
    return log.join(F.broadcast(few), CASE, "left_semi").select(CASE, TS, ORDER_KEY, attribute)


def case_table(log: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """One row per case with the attributes of its first source row, nulls included."""
    first = F.min_by(F.struct(*attributes), F.col(ORDER_KEY)).alias("__first")
    return log.groupBy(CASE).agg(first).select(CASE, "__first.*")


def value_distribution(df: DataFrame, column: str, count_name: str = "case_count") -> DataFrame:
    """Count per non-null value and its percent of all rows, nulls included in the base."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(n_rows(count_name))
    total = scalar(df, F.count(F.lit(1)))
    return counts.withColumn("percent", percent(F.col(count_name), total)).orderBy(F.desc(count_name), column)


# --- numeric profile --------------------------------------------------------------------

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std (ddof 1), min, quartiles, max, unbiased skewness."""
    c = F.col(column).cast("double")
    moments = df.agg(
        F.count(c).alias("count"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        skew_unbiased(c).alias("skewness"),
    )
    q = scalar(exact_quantiles(df, column, QUARTILES), F.struct(*QUARTILES))
    return moments.withColumns({name: q.getField(name) for name in QUARTILES})


def numeric_percentiles(df: DataFrame, column: str, probs: Sequence[float]) -> DataFrame:
    names = {f"p{i}": p for i, p in enumerate(probs)}
    one = exact_quantiles(df, column, names)
    long = one.unpivot([], list(names), "__p", "value")
    return long.select(mapped(F.col("__p"), names).alias("probability"), "value").orderBy("probability")


def _fences(df: DataFrame, column: str) -> DataFrame:
    q = exact_quantiles(df, column, QUARTILES)
    iqr = F.col("q75") - F.col("q25")
    return q.select(
        "q25", "median", "q75", iqr.alias("iqr"),
        (F.col("q25") - 1.5 * iqr).alias("lower_bound"),
        (F.col("q75") + 1.5 * iqr).alias("upper_bound"),
    )


def iqr_outliers(df: DataFrame, column: str) -> DataFrame:
    """Tukey fences with the count and percent of rows outside."""
    names = ["q25", "q75", "iqr", "lower_bound", "upper_bound"]
    f = scalar(_fences(df, column), F.struct(*names))
    c = F.col(column)
    tagged = df.select(c.alias("__v"), f.alias("__f"))
    v = F.col("__v")
    out = tagged.agg(
        F.first("__f").alias("__f"),
        n_rows("__rows"),
        count_where((v < F.col("__f.lower_bound")) | (v > F.col("__f.upper_bound"))).alias("outlier_count"),
    )
    return out.select(
        "__f.*", "outlier_count", percent(F.col("outlier_count"), F.col("__rows")).alias("outlier_percent")
    )


def boxplot_stats(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, whiskers (extreme values inside the fences) and the number of fliers."""
    names = ["q25", "median", "q75", "lower_bound", "upper_bound"]
    f = scalar(_fences(df, column), F.struct(*names))
    tagged = df.select(F.col(column).alias("__v"), f.alias("__f"))
    v = F.col("__v")
    inside = (v >= F.col("__f.lower_bound")) & (v <= F.col("__f.upper_bound"))
    out = tagged.agg(
        F.first("__f").alias("__f"),
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        count_where(~inside).alias("fliers"),
    )
    return out.select("__f.median", "__f.q25", "__f.q75", "whisker_low", "whisker_high", "fliers")


def top_n_cases(cases: DataFrame, column: str, n: int = 10) -> DataFrame:
    return cases.orderBy(F.desc(column), CASE).limit(n)


def zero_value_check(cases: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Zero-valued cases in total and by each category column."""
    total = scalar(cases, F.count(F.lit(1)))
    zero = cases.filter(F.col(column) == 0)
    overall = zero.agg(n_rows("zero_cases")).select(
        F.lit("(all)").alias("dimension"), F.lit("(all)").alias("value"), "zero_cases"
    )
    split = categorical_profile(zero, by).filter(F.col("value").isNotNull()).select(
        F.col("column").alias("dimension"), "value", F.col("row_count").alias("zero_cases")
    )
    return overall.unionByName(split).withColumn("percent_of_cases", percent(F.col("zero_cases"), total))


def negative_value_check(cases: DataFrame, column: str) -> DataFrame:
    return cases.agg(count_where(F.col(column) < 0).alias("negative_cases"))


def amount_by_category(cases: DataFrame, category: str, column: str) -> DataFrame:
    c = F.col(column)
    base = cases.filter(F.col(category).isNotNull())
    stats = base.groupBy(category).agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max")
    )
    medians = exact_quantiles(base, column, {"median": 0.5}, [category])
    return stats.join(medians, category, "left")


def histogram(df: DataFrame, column: str, bins: int, upper: Column | None = None) -> DataFrame:
    """Equal-width bins over [min, max], the last bin closed; empty bins are kept.

    `upper` drops larger values first, for a histogram up to a percentile.
    """
    base = df.filter(F.col(column).isNotNull())
    if upper is not None:
        base = base.filter(F.col(column) <= upper)
    span = scalar(base, F.struct(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")))
    lo, hi = span.getField("lo"), span.getField("hi")
    width = (hi - lo) / F.lit(float(bins))
    index = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(column).cast("double") - lo) / width), F.lit(bins - 1))
    )
    counts = base.groupBy(index.cast("long").alias("bin")).agg(n_rows("case_count"))
    all_bins = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return all_bins.join(counts, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * width).alias("left_edge"),
        (lo + (F.col("bin") + 1) * width).alias("right_edge"),
        F.coalesce("case_count", F.lit(0)).alias("case_count"),
    )


def histogram_up_to(df: DataFrame, column: str, bins: int, prob: float) -> DataFrame:
    limit = scalar(exact_quantiles(df, column, {"p": prob}), "p")
    return histogram(df, column, bins, limit)


# --- activities and traces --------------------------------------------------------------

def activity_frequency(log: DataFrame) -> DataFrame:
    return value_distribution(log, ACTIVITY, "event_count")


def activity_group(log: DataFrame, column: str, pattern: str, names: Mapping[str, str]) -> DataFrame:
    """Events per group of a regex capture; an unmatched or unmapped value is ungrouped.

    The capture is mapped after counting distinct values, and an empty match is null.
    """
    total = scalar(log, F.count(F.lit(1)))
    values = log.groupBy(column).agg(n_rows())
    key = F.nullif(F.regexp_extract(F.col(column), pattern, 1), F.lit(""))
    grouped = values.groupBy(mapped(key, names).alias("activity_group")).agg(F.sum("n").alias("event_count"))
    return grouped.select(
        F.coalesce("activity_group", F.lit("(ungrouped)")).alias("activity_group"),
        "event_count",
        percent(F.col("event_count"), total).alias("percent"),
    )


def trace_lengths(log: DataFrame) -> DataFrame:
    return log.groupBy(CASE).agg(n_rows("event_count"))


def longest_cases(log: DataFrame, n: int = 10) -> DataFrame:
    return top_n_cases(trace_lengths(log), "event_count", n)


# --- outcomes ---------------------------------------------------------------------------

def target_presence(log: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """Cases with no, one, or several distinct outcomes."""
    flags = [F.max((F.col(ACTIVITY) == o).cast("int")) for o in outcomes]
    per_case = log.groupBy(CASE).agg(sum(flags[1:], flags[0]).alias("n"))
    n = F.col("n")
    return per_case.agg(
        count_where(n == 0).alias("cases_with_no_target"),
        count_where(n == 1).alias("cases_with_one_target"),
        count_where(n > 1).alias("cases_with_multiple_targets"),
    )


def target_distribution(log: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """Distinct cases (not events) per outcome and percent of the outcome total."""
    pairs = log.filter(F.col(ACTIVITY).isin(list(outcomes))).select(ACTIVITY, CASE).distinct()
    counts = pairs.groupBy(F.col(ACTIVITY).alias("target")).agg(n_rows("case_count"))
    total = scalar(counts, F.sum("case_count"))
    return counts.withColumn("percent", percent(F.col("case_count"), total)).orderBy(F.desc("case_count"), "target")


def unresolved_last_state(log: DataFrame, outcomes: Sequence[str], prefix: str) -> DataFrame:
    """Last activity with the prefix in each case without an outcome, counted.

    One aggregation per case carries both the outcome flag and the latest matching activity.
    """
    matching = F.when(F.col(ACTIVITY).startswith(prefix), F.struct(TS, ORDER_KEY, ACTIVITY))
    per_case = log.groupBy(CASE).agg(
        F.max(F.col(ACTIVITY).isin(list(outcomes)).cast("int")).alias("resolved"),
        F.max(matching).getField(ACTIVITY).alias("last_activity"),
    )
    open_cases = per_case.filter((F.col("resolved") == 0) & F.col("last_activity").isNotNull())
    return open_cases.groupBy("last_activity").agg(n_rows("case_count"))
