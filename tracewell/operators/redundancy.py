"""Features that are linear copies of others, found without comparing all pairs.

Every feature is standardized and projected on random directions over the cases, one sign a case and direction; the signs
of its projections are its fingerprint. Two features whose correlation is r differ in a bit with probability
arccos(|r|) / pi, up to turning all bits. Fingerprints are cut into bands of about log2(features) bits; features that share
a band and are close in all bits are candidates, and their correlation is computed exactly from the cells.

Work is linear in the cells for the fingerprints, and in the candidates' cells for the check. Features with the same
fingerprint are compared with one of them only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.tables import measured_broadcast
from tracewell.session import cut_lineage
from tracewell.spec import CASE

BANDS = 16
SIMILAR = 0.99


def _sign(case: Column, direction: int, seed: int) -> Column:
    """A random sign for a case and direction: bits of hashes of the case, 64 directions a hash."""
    word = F.xxhash64(F.lit(seed), F.lit(direction // 64), case)
    return F.getbit(word, F.lit(direction % 64)).cast("double") * 2 - 1


def fingerprints(cells: DataFrame, cases: DataFrame, bits: int, seed: int = 42) -> DataFrame:
    """(feature_index, n, sum, squares, bits): the moments of each feature over all cases and its fingerprint, as an array of 0 and 1
    whose first entry is 0; constant features are left out. Cells that are not there are zeros."""
    signs = [_sign(F.col(CASE), d, seed) for d in range(bits)]
    whole = cases.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(s) for s in signs]).alias("r"))
    whole = measured_broadcast(whole.withColumn("__one", F.lit(1)))
    value = F.col("value").cast("double")
    per = cells.groupBy("feature_index").agg(
        F.sum(value).alias("sum"), F.sum(value * value).alias("squares"), F.array(*[F.sum(value * s) for s in signs]).alias("dot"))
    met = per.withColumn("__one", F.lit(1)).join(whole, "__one").drop("__one")
    mean = F.col("sum") / F.col("n")
    varies = F.col("squares") - F.col("n") * mean * mean > 1e-12 * F.col("squares")
    raw = F.zip_with("dot", "r", lambda d, r: (d - mean * r > 0).cast("int"))
    flipped = F.transform(raw, lambda b: b.bitwiseXOR(F.get(raw, F.lit(0))))
    return met.filter(varies).select("feature_index", "n", "sum", "squares", flipped.alias("bits"))


def _distance(a: Column, b: Column) -> Column:
    """Differing bits, up to turning all of them."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return F.least(d, F.size(a) - d)


def _candidates(prints: DataFrame, similarity: float, width: int) -> DataFrame:
    """(a, b) with a < b: members of equal fingerprints with their first one, and close different fingerprints of a band."""
    equal = W.partitionBy("bits")
    named = cut_lineage(prints.select("feature_index", "bits").withColumn("head", F.min("feature_index").over(equal)))
    same = named.filter("feature_index <> head").select(F.col("head").alias("a"), F.col("feature_index").alias("b"))
    heads = named.filter("feature_index = head").select(F.col("head").alias("f"), "bits")
    total = BANDS * width
    share = math.acos(similarity) / math.pi
    radius = math.ceil(total * share + 5 * math.sqrt(total * share * (1 - share)))

    def band(i: int) -> Column:  # compared up to turning its bits
        first = F.get("bits", F.lit(i * width))
        return F.struct(F.lit(i).alias("band"), F.transform(F.slice("bits", i * width + 1, width), lambda b: b.bitwiseXOR(first)).alias("key"))

    bands = F.array(*[band(i) for i in range(BANDS)])
    filed = heads.select("f", "bits", F.explode(bands).alias("e")).select("f", "bits", "e.*")
    left, right = filed.alias("l"), filed.alias("r")
    near = left.join(right, (F.col("l.band") == F.col("r.band")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.f") < F.col("r.f")))
    close = near.filter(_distance(F.col("l.bits"), F.col("r.bits")) <= radius).select(F.col("l.f").alias("a"), F.col("r.f").alias("b"))
    return same.unionByName(close).distinct()


def correlated_pairs(cells: DataFrame, cases: DataFrame, similarity: float = SIMILAR, seed: int = 42) -> DataFrame:
    """(a, b, correlation): pairs of features with |correlation| of at least `similarity`, exactly computed. Features with equal
    fingerprints appear beside the first of them; other pairs of theirs follow from that one."""
    n_features = cells.select("feature_index").distinct().count()
    width = max(4, math.ceil(math.log2(max(n_features, 2))))
    prints = cut_lineage(fingerprints(cells, cases, BANDS * width, seed))
    pairs = measured_broadcast(_candidates(prints, similarity, width))
    one = cells.select(CASE, F.col("feature_index").alias("a"), F.col("value").cast("double").alias("x"))
    other = cells.select(CASE, F.col("feature_index").alias("b"), F.col("value").cast("double").alias("y"))
    dots = one.join(pairs, "a").join(other, [CASE, "b"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    left = prints.select(F.col("feature_index").alias("a"), "n", F.col("sum").alias("sx"), F.col("squares").alias("xx"))
    right = prints.select(F.col("feature_index").alias("b"), F.col("sum").alias("sy"), F.col("squares").alias("yy"))
    met = pairs.join(dots, ["a", "b"], "left").join(left, "a").join(right, "b")
    cov = F.coalesce("xy", F.lit(0.0)) * F.col("n") - F.col("sx") * F.col("sy")
    scale = F.sqrt((F.col("xx") * F.col("n") - F.col("sx") * F.col("sx")) * (F.col("yy") * F.col("n") - F.col("sy") * F.col("sy")))
    return met.select("a", "b", (cov / scale).alias("correlation")).filter(F.abs("correlation") >= similarity)


def redundant_features(cells: DataFrame, cases: DataFrame, dictionary: DataFrame, similarity: float = SIMILAR, seed: int = 42) -> DataFrame:
    """(feature_name, earlier_feature, correlation, kept_feature): each feature that repeats an earlier one, the earliest it is
    correlated with, and the feature to keep: the one that a chain of such features ends in."""
    pairs = cut_lineage(correlated_pairs(cells, cases, similarity, seed))
    first = pairs.groupBy("b").agg(F.min(F.struct("a", "correlation")).alias("m")).select("b", "m.a", "m.correlation")
    heads = cut_lineage(first.withColumn("head", F.col("a")))
    while True:  # the way to the end of a chain halves every time
        up = heads.select(F.col("b").alias("__b"), F.col("head").alias("__head"))
        moved = cut_lineage(heads.join(up, F.col("head") == F.col("__b"), "left").select(
            "b", "a", "correlation", F.coalesce("__head", "head").alias("head"), F.col("__head").isNotNull().alias("__moved")))
        heads = moved.drop("__moved")
        if moved.filter("__moved").isEmpty():
            break
    names = measured_broadcast(dictionary.select("feature_index", "feature_name"))
    out = heads
    for index, name in (("b", "feature_name"), ("a", "earlier_feature"), ("head", "kept_feature")):
        out = out.join(names.select(F.col("feature_index").alias(index), F.col("feature_name").alias(name)), index)
    return out.select("feature_name", "earlier_feature", "correlation", "kept_feature")
