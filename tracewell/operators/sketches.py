"""Approximate profiles from stored sketches, one for each period, merged for any span of periods.

A period keeps a quantile sketch (KLL) of each numeric column and a distinct sketch (HyperLogLog) of each column. They
are written once; a profile of any span merges the sketches of its periods and reads no rows. Results depend on the
order of merging only within the stated error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut_lineage

# Size parameter of the quantile sketch; its rank error for one quantile is about 2.296 / k ** 0.9021 with probability 0.99.
KLL_K = 200
# log2 of the registers of the distinct sketch; its relative standard error is about 1.04 / sqrt(2 ** lgk).
HLL_LGK = 14


def rank_error(k: int = KLL_K) -> float:
    """Normalized rank error of one quantile of a sketch, exceeded once in a hundred times."""
    return 2.296 / k**0.9021


def distinct_error(lgk: int = HLL_LGK) -> float:
    """Relative standard error of a distinct count."""
    return 1.04 / (1 << lgk) ** 0.5


def build_sketches(df: DataFrame, period: Column, numeric: Sequence[str], distinct: Sequence[str], k: int = KLL_K, lgk: int = HLL_LGK) -> DataFrame:
    """(period, column, rows, non_null, quantiles, distincts, smallest, largest), one row a period and column."""
    columns = list(dict.fromkeys([*numeric, *distinct]))

    def entry(c: str) -> Column:
        value = F.col(f"`{c}`")
        number = value.cast("double")
        numbers = F.kll_sketch_agg_double(number, F.lit(k)) if c in numeric else F.lit(None).cast("binary")
        shown = F.hll_sketch_agg(value.cast("string"), F.lit(lgk)) if c in distinct else F.lit(None).cast("binary")
        least, most = (f(number) if c in numeric else F.lit(None).cast("double") for f in (F.min, F.max))
        return F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count(value).alias("non_null"), numbers.alias("quantiles"),
                        shown.alias("distincts"), least.alias("smallest"), most.alias("largest"))

    per = df.groupBy(period.alias("period")).agg(F.array(*[entry(c) for c in columns]).alias("e"))
    return per.select("period", F.explode("e").alias("e")).select("period", "e.*")


def merge_sketches(sketches: DataFrame, span: Column | None = None, lgk: int = HLL_LGK) -> DataFrame:
    """One sketch row for each span of periods and column; without `span` one for each column."""
    keys = [span.alias("span"), "column"] if span is not None else ["column"]
    return sketches.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distincts").alias("distincts"),
        F.min("smallest").alias("smallest"), F.max("largest").alias("largest"))


def sketch_profile(merged: DataFrame, probabilities: Mapping[str, float]) -> DataFrame:
    """(…, rows, non_null, distinct, smallest, largest, and one column a probability): what the sketches say; null where a column
    has no such sketch or no value."""
    filled = F.col("quantiles").isNotNull() & (F.col("smallest").isNotNull())
    keys = [c for c in ("span", "column") if c in merged.columns]
    return merged.select(
        *keys, "rows", "non_null", F.hll_sketch_estimate("distincts").alias("distinct"), "smallest", "largest",
        *[F.when(filled, F.kll_sketch_get_quantile_double("quantiles", F.lit(p))).alias(n) for n, p in probabilities.items()])


def rank_violations(profile: DataFrame, exact: DataFrame, column: str, probabilities: Mapping[str, float], bound: float) -> DataFrame:
    """(span, quantile, rank_low, rank_high, within): where each approximate quantile of a column stands among the exact values.

    `exact` has (span, value). A value that occurs often covers the ranks from rank_low to rank_high; the quantile is
    within the bound where its probability is not further than that from this stretch.
    """
    wanted = F.array(*[F.struct(F.lit(n).alias("quantile"), F.lit(p).alias("p"), F.col(n).alias("q")) for n, p in probabilities.items()])
    asked = cut_lineage(profile.filter(F.col("column") == column).select("span", F.explode(wanted).alias("a")).select("span", "a.*"))
    # the asked values are a few rows for each span
    met = exact.filter("value is not null").join(F.broadcast(asked), "span")
    ranks = met.groupBy("span", "quantile", "p", "q").agg(
        (F.count(F.when(F.col("value") < F.col("q"), 1)) / F.count(F.lit(1))).alias("rank_low"),
        (F.count(F.when(F.col("value") <= F.col("q"), 1)) / F.count(F.lit(1))).alias("rank_high"))
    within = (F.col("p") >= F.col("rank_low") - bound) & (F.col("p") <= F.col("rank_high") + bound)
    return ranks.select("span", "quantile", "rank_low", "rank_high", within.alias("within"))
