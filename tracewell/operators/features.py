"""One feature row per case, from its prefix only.

A prefix has at most k rows per case, so per-case arrays are small; every feature comes out of
one aggregation by case.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.columns import count_where, micros, n_rows
from tracewell.operators.contracts import union_checks
from tracewell.session import cut_lineage
from tracewell.spec import CASE, ORDER_KEY, POS, TS


@dataclass(frozen=True)
class FeatureSpec:
    """statics: source -> output name; count_maps: source -> namespace; uniques: output -> source;
    map_names: namespace -> map column, where it is not `<namespace>_counts`."""

    statics: Mapping[str, str]
    count_maps: Mapping[str, str]
    uniques: Mapping[str, str]
    map_names: Mapping[str, str] = field(default_factory=dict)

    def map_column(self, namespace: str) -> str:
        return self.map_names.get(namespace, f"{namespace}_counts")

    @property
    def map_columns(self) -> dict[str, str]:
        """Map column -> namespace."""
        return {self.map_column(ns): ns for ns in self.count_maps.values()}

    @property
    def numeric_summary(self) -> list[str]:
        return [*self.uniques, "prefix_duration_seconds", "mean_event_gap_seconds"]


def count_map(values: Column) -> Column:
    """value -> occurrences, keys sorted."""
    keys = F.array_sort(F.array_distinct(values))
    counts = F.transform(keys, lambda v: F.size(F.filter(values, lambda x: x == v)).cast("long"))
    return F.map_from_arrays(keys, counts)


def _static_struct(statics: Mapping[str, str]) -> Column:
    return F.min_by(F.struct(*[F.col(s).alias(o) for s, o in statics.items()]), F.col(POS))


def _static_varies(statics: Mapping[str, str]) -> Column:
    out = F.lit(False)
    for s in statics:
        mixed = (F.count(s) > 0) & (F.count(s) < F.count(F.lit(1)))
        out = out | mixed | F.coalesce(F.min(s) != F.max(s), F.lit(False))
    return out


def _seconds(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def static_features(prefix: DataFrame, statics: Mapping[str, str], strict: bool = False) -> DataFrame:
    """First value of each static attribute; strict mode fails on a case where one varies."""
    per_case = prefix.groupBy(CASE).agg(_static_struct(statics).alias("s"), _static_varies(statics).alias("bad"))
    if strict:
        guard = F.when(F.col("bad"), F.raise_error("static attribute varies within a prefix").cast("boolean"))
        per_case = per_case.filter(F.coalesce(guard, F.lit(True)))
    return per_case.select(CASE, "s.*")


def count_maps(prefix: DataFrame, sources: Mapping[str, str], strict: bool = True) -> DataFrame:
    """A value -> count map per source column; strict mode fails on a missing value."""
    lists = [F.collect_list(F.col(s).cast("string")).alias(f"__{ns}") for s, ns in sources.items()]
    per_case = prefix.groupBy(CASE).agg(n_rows("__n"), *lists)
    return per_case.select(CASE, *[
        count_map(_complete(F.col(f"__{ns}"), s) if strict else F.col(f"__{ns}")).alias(f"{ns}_counts")
        for s, ns in sources.items()
    ])


def _complete(values: Column, source: str) -> Column:
    """The list, or an error when collect_list dropped a null."""
    message = F.lit(f"count-map source {source} has missing values")
    return F.when(F.size(values) == F.col("__n"), values).otherwise(F.raise_error(message).cast("array<string>"))


def unique_counts(prefix: DataFrame, uniques: Mapping[str, str]) -> DataFrame:
    return prefix.groupBy(CASE).agg(*[
        F.size(F.collect_set(s)).cast("long").alias(o) for o, s in uniques.items()
    ])


def timing_features(prefix: DataFrame) -> DataFrame:
    """Start, prefix duration, and mean gap. The gaps of ordered events add up to the duration,
    so their mean needs no second pass over the events."""
    per_case = prefix.groupBy(CASE).agg(
        F.min(TS).alias("case_start_time"), F.max(TS).alias("__end"), n_rows("__n")
    )
    return _with_timing(per_case).select(
        CASE, "case_start_time", "prefix_duration_seconds", "mean_event_gap_seconds"
    )


def _with_timing(per_case: DataFrame) -> DataFrame:
    duration = _seconds(F.col("case_start_time"), F.col("__end"))
    gap = mean_gap(duration, F.col("__n"))
    return per_case.withColumns({"prefix_duration_seconds": duration, "mean_event_gap_seconds": gap})


def mean_gap(duration: Column, events: Column) -> Column:
    """Mean time between ordered events, 0 where there are no two."""
    return F.when(events > 1, duration / (events - 1)).otherwise(F.lit(0.0))


def timing_by_gaps(prefix: DataFrame) -> DataFrame:
    """The same timing from each event's gap to the one before: the independent check."""
    w = W.partitionBy(CASE).orderBy(TS, ORDER_KEY)
    gaps = prefix.select(CASE, TS, _seconds(F.lag(TS).over(w), F.col(TS)).alias("gap"))
    return gaps.groupBy(CASE).agg(
        F.coalesce(F.sum("gap"), F.lit(0.0)).alias("gap_duration"),
        F.coalesce(F.avg("gap"), F.lit(0.0)).alias("gap_mean"),
        count_where(F.col("gap") < 0).alias("negative_gaps"),
    )


def case_features(prefix: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Everything in one row per case. `prefix` carries `target`; missing count-map values and
    varying statics fail the query."""
    lists = {s: F.collect_list(F.col(s).cast("string")) for s in spec.count_maps}
    per_case = prefix.groupBy(CASE).agg(
        F.max("target").alias("target"),
        F.min(TS).alias("case_start_time"),
        F.max(TS).alias("__end"),
        n_rows("__n"),
        _static_struct(spec.statics).alias("__static"),
        _static_varies(spec.statics).alias("__varies"),
        *[e.alias(f"__{spec.count_maps[s]}") for s, e in lists.items()],
        *[F.size(F.collect_set(s)).cast("long").alias(o) for o, s in spec.uniques.items()],
    )
    guard = F.when(F.col("__varies"), F.raise_error("static attribute varies within a prefix").cast("int"))
    timed = _with_timing(per_case.withColumn("target", F.coalesce(guard, F.col("target"))))
    return timed.select(
        CASE, "case_start_time", "target", "__static.*",
        *[count_map(_complete(F.col(f"__{ns}"), s)).alias(spec.map_column(ns)) for s, ns in spec.count_maps.items()],
        *spec.numeric_summary,
    )


def count_rows(features: DataFrame, maps: Mapping[str, str]) -> DataFrame:
    """Map columns as rows (case_id, namespace, key, count)."""
    def entries_of(column: str, namespace: str) -> Column:
        return F.transform(F.map_entries(column), lambda e: F.struct(
            F.lit(namespace).alias("namespace"), e["key"].alias("key"), e["value"].alias("count")))

    entries = [entries_of(c, ns) for c, ns in maps.items()]
    return features.select(CASE, F.explode(F.concat(*entries)).alias("e")).select(CASE, "e.*")


def feature_table_checks(
    features: DataFrame, prefix: DataFrame, spec: FeatureSpec, outcomes: Sequence[str], k: int
) -> DataFrame:
    """Violation counts of the feature table's rules, one row per rule. The features are read
    several times, so they are checkpointed once."""
    features = cut_lineage(features)
    maps = spec.map_columns
    bad = {}
    for m in maps:
        total = F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda acc, v: acc + v)
        bad[f"map_total:{m}"] = total != k
        bad[f"outcome_key:{m}"] = F.arrays_overlap(F.map_keys(m), F.array(*[F.lit(o) for o in outcomes]))
    one = features.agg(*[count_where(c).alias(n) for n, c in bad.items()])
    rules = _rule_rows(one, list(bad))
    check = features.join(timing_by_gaps(prefix), CASE, "full_outer")
    tol = 1e-6
    same = (
        (F.abs(F.col("gap_duration") - F.col("prefix_duration_seconds")) <= tol)
        & (F.abs(F.col("gap_mean") - F.col("mean_event_gap_seconds")) <= tol)
    )
    timing = check.agg(
        count_where(~F.coalesce(same, F.lit(False))).alias("timing_mismatch"),
        F.sum(F.coalesce("negative_gaps", F.lit(0))).alias("negative_gap"),
    )
    ids = features.groupBy(CASE).agg(n_rows()).agg(F.sum(F.col("n") - 1).alias("duplicate_case_id"))
    predictors = [*spec.statics.values(), *maps, *spec.numeric_summary]
    text = features.select(*[
        (F.to_json(c) if c in maps else F.col(c).cast("string")).alias(c) for c in predictors
    ])
    same_rows = text.groupBy(*predictors).agg(n_rows()).agg(F.sum(F.col("n") - 1).alias("duplicate_predictor_rows"))
    constant = text.agg(*[
        F.when((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)) | (F.count(c) == 0), 1)
        .otherwise(0).cast("long").alias(f"constant:{c}") for c in predictors
    ])
    return union_checks([
        rules,
        _rule_rows(timing, ["timing_mismatch", "negative_gap"]),
        _rule_rows(ids, ["duplicate_case_id"]),
        _rule_rows(same_rows, ["duplicate_predictor_rows"]),
        _rule_rows(constant, [f"constant:{c}" for c in predictors]),
    ])


def _rule_rows(one_row: DataFrame, names: Sequence[str]) -> DataFrame:
    quoted = [F.col(f"`{n}`").cast("long").alias(n) for n in names]
    return one_row.select(*quoted).unpivot([], [f"`{n}`" for n in names], "rule", "rows_affected")
