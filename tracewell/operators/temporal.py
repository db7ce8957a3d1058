"""Chronological splits and windows that never divide a timestamp."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import count_where, mapped, n_rows, ratio
from tracewell.operators.contracts import ContractError
from tracewell.operators.order import ordered_cumsum, ranged_row_number


@dataclass(frozen=True)
class Boundary:
    """A cut after `position` cases: the last value before it and the first after it."""

    nominal: int
    position: int
    before: object
    after: object


def start_counts(cases: DataFrame, start: str) -> DataFrame:
    return ordered_cumsum(cases.select(F.col(start).alias("start")), ["start"], {"n": F.lit(1)})


def find_boundaries(cases: DataFrame, start: str, fractions: Sequence[float]) -> tuple[int, list[Boundary]]:
    """Total cases and, per fraction, the cut between distinct start values nearest to
    floor(total * fraction), the earlier one on a tie.

    Only one row per boundary reaches the driver; the cumulative counts stay distributed.
    """
    cum = start_counts(cases, start)
    wanted = [F.floor(F.col("total_n") * F.lit(float(f)) + 1e-9) for f in fractions]
    valid = F.col("cum_n") < F.col("total_n")
    picks = cum.agg(
        F.max("total_n").alias("total"),
        *[F.max(n).alias(f"n{i}") for i, n in enumerate(wanted)],
        *[
            F.min(F.when(valid, F.struct(F.abs(F.col("cum_n") - n).alias("d"), F.col("cum_n").alias("p"), "start")))
            .alias(f"b{i}") for i, n in enumerate(wanted)
        ],
    ).first()
    total = picks["total"] or 0
    nominals = [picks[f"n{i}"] or 0 for i in range(len(wanted))]
    if any(not 0 < n < total for n in nominals):
        raise ContractError(f"a boundary would leave an empty part: {nominals} of {total}")
    if picks["b0"] is None:
        raise ContractError("all cases share one start time; no strict cut exists")
    positions = [picks[f"b{i}"]["p"] for i in range(len(nominals))]
    if any(a >= b for a, b in zip(positions, positions[1:])):
        raise ContractError(f"boundaries are not increasing: {positions}")
    after = cum.agg(*[
        F.min(F.when(F.col("cum_n") > p, F.col("start"))).alias(f"a{i}") for i, p in enumerate(positions)
    ]).first()
    cuts = [
        Boundary(n, positions[i], picks[f"b{i}"]["start"], after[f"a{i}"]) for i, n in enumerate(nominals)
    ]
    return total, cuts


def _literal(df: DataFrame, column: str, value: object) -> Column:
    kind = dict(df.dtypes)[column]
    if kind == "timestamp_ntz" and isinstance(value, datetime.datetime):
        return F.lit(value.isoformat(sep=" ")).cast(kind)
    return F.lit(value).cast(kind)


def assign_parts(
    cases: DataFrame, start: str, cuts: Sequence[Boundary], names: Sequence[str], column: str
) -> DataFrame:
    """Label each case by comparing its start with the frozen cut values: a plain projection."""
    label: Column = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names))):
        label = F.when(F.col(start) <= _literal(cases, start, cut.before), F.lit(name)).otherwise(label)
    return cases.withColumn(column, label)


def temporal_split(cases: DataFrame, start: str, train_ratio: float = 0.8) -> tuple[DataFrame, Boundary]:
    """Add `split` (train/test); a tied group at the cut goes whole to the nearer side."""
    _, cuts = find_boundaries(cases, start, [train_ratio])
    return assign_parts(cases, start, cuts, ["train", "test"], "split"), cuts[0]


def temporal_windows(cases: DataFrame, start: str, names: Sequence[str]) -> tuple[DataFrame, list[Boundary]]:
    """Add `window`: near-equal chronological windows in order."""
    n = len(names)
    _, cuts = find_boundaries(cases, start, [i / n for i in range(1, n)])
    return assign_parts(cases, start, cuts, names, "window"), cuts


def temporal_order(cases: DataFrame, start: str, key: str) -> DataFrame:
    """0-based position of every case in (start, key) order."""
    numbered = ranged_row_number(cases, [start, key], [], "__n")
    return numbered.withColumn("temporal_order", F.col("__n") - 1).drop("__n")


def split_summary(split: DataFrame, start: str, cut: Boundary, ratio_: float, target: str = "target") -> DataFrame:
    """Sizes, time ranges, class counts and rates of both sides in one row."""
    aggs = []
    for s in ("train", "test"):
        here = F.col("split") == s
        aggs += [
            count_where(here).alias(f"{s}_cases"),
            F.min(F.when(here, F.col(start))).alias(f"{s}_start"),
            F.max(F.when(here, F.col(start))).alias(f"{s}_end"),
            count_where(here & (F.col(target) == 1)).alias(f"{s}_success"),
            count_where(here & (F.col(target) == 0)).alias(f"{s}_unsuccessful"),
        ]
    one = split.agg(n_rows("total_cases"), *aggs)
    train_rate = ratio(F.col("train_success"), F.col("train_cases"))
    test_rate = ratio(F.col("test_success"), F.col("test_cases"))
    return one.withColumns({
        "nominal_train_ratio": F.lit(float(ratio_)),
        "nominal_split_index": F.lit(cut.nominal).cast("long"),
        "actual_split_index": F.lit(cut.position).cast("long"),
        "boundary_adjustment_cases": F.lit(cut.position - cut.nominal).cast("long"),
        "timestamp_boundary_adjusted": F.lit(cut.position != cut.nominal),
        "actual_train_percentage": ratio(F.col("train_cases"), F.col("total_cases")),
        "train_success_rate": train_rate,
        "test_success_rate": test_rate,
        "test_minus_train_success_rate": test_rate - train_rate,
        "boundary_timestamp": _literal(split, start, cut.before),
    })


def window_summary(
    windows: DataFrame, start: str, cuts: Sequence[Boundary], names: Sequence[str], target: str = "target"
) -> DataFrame:
    """Size, order range, time range and class counts per window."""
    stats = windows.groupBy("window").agg(
        n_rows("case_count"),
        F.min(start).alias("start_time"),
        F.max(start).alias("end_time"),
        count_where(F.col(target) == 1).alias("success_count"),
        count_where(F.col(target) == 0).alias("unsuccessful_count"),
    )
    offsets = dict(zip(names, [0, *[c.position for c in cuts]]))
    first = mapped(F.col("window"), offsets).cast("long")
    return stats.withColumns({
        "first_temporal_order": first, "last_temporal_order": first + F.col("case_count") - 1,
    })


def boundary_table(cases: DataFrame, start: str, cuts: Sequence[Boundary], names: Sequence[str]) -> DataFrame:
    """One row per cut: nominal and actual position and the times on each side."""
    kind = dict(cases.dtypes)[start]
    rows = [
        (f"{names[i]}_{names[i + 1]}", c.nominal, c.position, c.position - c.nominal, c.before, c.after,
         c.position != c.nominal)
        for i, c in enumerate(cuts)
    ]
    return cases.sparkSession.createDataFrame(
        rows,
        "boundary string, nominal_position long, actual_position long, adjustment long, "
        f"time_before {kind}, time_after {kind}, adjusted boolean",
    )


def window_inherit(sample: DataFrame, windows: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """The sample with the window of each key; `matched` is false where the population lacks it.

    A key has one window: rows that repeat it count once, and a key with two windows is refused
    by strict mode and left unmatched otherwise. Strict mode also refuses a missing key.
    """
    per_key = windows.groupBy(key).agg(F.min("window").alias("window"), F.max("window").alias("__last"))
    one = F.col("window").eqNullSafe(F.col("__last"))
    right = per_key.filter(one).select(key, "window", F.lit(True).alias("matched"))
    if strict:
        problems = {
            "two windows": per_key.filter(~one),
            "no window": sample.join(per_key, key, "left_anti"),
        }
        for what, rows in problems.items():
            bad = [r[0] for r in rows.select(key).limit(20).collect()]
            if bad:
                raise ContractError(f"{what}: {bad}")
    return sample.join(right, key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


# --- sampling ---------------------------------------------------------------------------

def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all) without replacement, with `sample_order`.

    The order is a keyed hash of the id alone: blind to every other column, independent of row
    order and partitioning, and the same on any engine. Spark keeps n rows per task.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    picked = df.withColumn("__draw", draw).orderBy("__draw", key).limit(n)
    numbered = ranged_row_number(picked, ["__draw", key], [], "__n")
    return numbered.withColumn("sample_order", F.col("__n") - 1).drop("__n", "__draw")


def sample_distribution(samples: DataFrame, by: Sequence[str] = ("sample",), target: str = "target") -> DataFrame:
    counts = samples.groupBy(*by).agg(
        n_rows("case_count"),
        count_where(F.col(target) == 1).alias("success_count"),
        count_where(F.col(target) == 0).alias("unsuccessful_count"),
    )
    return counts.withColumn("success_rate", ratio(F.col("success_count"), F.col("case_count")))


def overlap_counts(groups: dict[str, DataFrame], key: str) -> DataFrame:
    """Shared keys of every pair of groups, from one aggregation over all ids."""
    names = list(groups)
    tagged = reduce(DataFrame.unionByName, [g.select(key, F.lit(n).alias("g")) for n, g in groups.items()])
    flags = tagged.groupBy(key).agg(*[F.max((F.col("g") == n).cast("int")).alias(f"in_{n}") for n in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    one = flags.agg(*[
        count_where((F.col(f"in_{a}") == 1) & (F.col(f"in_{b}") == 1)).alias(f"{a}&{b}") for a, b in pairs
    ])
    cols = [f"`{a}&{b}`" for a, b in pairs]
    return one.unpivot([], cols, "pair", "overlap")
