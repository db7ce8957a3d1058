"""Cubes with exact distinct cases: bitmaps of dense case numbers instead of the cases themselves.

A case's combinations are gathered once. Sorted cases get dense numbers inside their partition, and each combination of
dimension values keeps one bitmap for every 32,768 numbers. Bitmaps merge, so every grouping set comes from those of
the finest combinations: no case is shuffled again, whatever the number of sets.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut_lineage
from tracewell.spec import CASE

_BITS = 1 << 15  # of one bitmap, as Spark's bitmap functions have it


def case_bitmaps(df: DataFrame, dims: Sequence[str], case: str = CASE) -> DataFrame:
    """(dims, bucket, bitmap): which cases have rows with each combination of values. Rows without a case are left out.

    A case's distinct combinations are in memory together; each task merges its own before they travel.
    """
    dims = list(dims)
    known = df.filter(F.col(f"`{case}`").isNotNull())
    cases = known.groupBy(F.col(f"`{case}`").alias("__case")).agg(F.collect_set(F.struct(*[F.col(f"`{d}`") for d in dims])).alias("cells"))
    # sorted, so that a lost task gives its cases the same numbers when it runs again
    numbered = cases.sortWithinPartitions("__case").withColumn("__id", F.monotonically_increasing_id())
    cells = numbered.select(F.floor(F.col("__id") / _BITS).alias("bucket"), F.pmod("__id", F.lit(_BITS)).alias("bit"), F.explode("cells").alias("c"))
    return cells.groupBy(*[F.col(f"c.`{d}`").alias(d) for d in dims], "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def cube_distinct(df: DataFrame, dims: Sequence[str], case: str = CASE, sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """(dims, grouping_id, rows, cases) for all grouping sets of `dims`, or for `sets`; a dimension that a set leaves out is
    null, and its bit in grouping_id, first dimension highest, is one."""
    dims = list(dims)
    sets = [list(c) for n in range(len(dims), -1, -1) for c in combinations(dims, n)] if sets is None else [list(s) for s in sets]
    quoted = [F.col(f"`{d}`") for d in dims]
    mask = sum((F.grouping(d).cast("long") * (1 << (len(dims) - 1 - i)) for i, d in enumerate(dims)), F.lit(0).cast("long")).alias("grouping_id")

    def grouped(table: DataFrame, *more: str):
        extra = [F.col(m) for m in more]
        return table.groupingSets([[*[F.col(f"`{d}`") for d in s], *extra] for s in sets], *quoted, *extra)

    finest = cut_lineage(case_bitmaps(df, dims, case))
    merged = grouped(finest, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"), mask)
    zero = F.lit(0).cast("long")
    cases = merged.select(*quoted, "grouping_id", zero.alias("rows"), F.bitmap_count("bitmap").alias("cases"))
    rows = grouped(df.select(*quoted)).agg(F.count(F.lit(1)).alias("rows"), mask).select(*quoted, "grouping_id", "rows", zero.alias("cases"))
    return rows.unionByName(cases).groupBy(*quoted, "grouping_id").agg(F.sum("rows").alias("rows"), F.sum("cases").alias("cases"))
