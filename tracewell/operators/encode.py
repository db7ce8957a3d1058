"""Train-only encoding: numeric scaling, one-hot categories, count vocabulary.

The encoded matrix is a long table (case, feature_index, value) of its non-zero cells; a
vector per case exists only where Spark ML needs one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import count_where, n_rows, ratio, scalar
from tracewell.functions.tables import measured_broadcast
from tracewell.operators.contracts import ContractError
from tracewell.operators.features import count_rows
from tracewell.operators.order import ordered_cumsum
from tracewell.session import cut_lineage
from tracewell.spec import CASE

# A model vector of this many features is the most the driver is asked to name.
MAX_MODEL_FEATURES = 1_000_000


@dataclass(frozen=True)
class EncodeSpec:
    """Predictor columns by kind; `maps` goes from map column to namespace."""

    numeric: Sequence[str]
    categorical: Sequence[str]
    maps: Mapping[str, str]


def map_validate(features: DataFrame, maps: Mapping[str, str], outcomes: Sequence[str], total: int) -> DataFrame:
    """Rows breaking each rule of a count map, a row per map."""
    aggs = []
    for m in maps:
        values = F.transform(F.map_values(m), lambda v: v.cast("double"))
        valid = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")))
        keys = F.forall(F.map_keys(m), lambda x: x.isNotNull() & (F.length(x) > 0))
        amount = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
        outcome = F.arrays_overlap(F.map_keys(m), F.array(*[F.lit(o) for o in outcomes]))
        aggs.append(F.struct(
            F.lit(m).alias("column"),
            count_where(~keys).alias("bad_keys"),
            count_where(~valid).alias("bad_counts"),
            count_where(amount != total).alias("bad_totals"),
            count_where(outcome).alias("outcome_keys"),
        ).alias(m))
    return features.agg(*aggs).select(F.explode(F.array(*list(maps))).alias("r")).select("r.*")


def namespaced_counts(features: DataFrame, maps: Mapping[str, str]) -> DataFrame:
    """(case_id, feature_name, value) with `namespace::key` names from all maps in one pass."""
    return count_rows(features, maps).select(
        CASE, F.concat_ws("::", "namespace", "key").alias("feature_name"), F.col("count").cast("double").alias("value")
    )


def _cells(spec: EncodeSpec, numeric: Mapping[str, Column]) -> Column:
    """All cells of a case as an array of (source_group, name, block, value)."""
    def cell(group: Column, name: Column, block: int, value: Column) -> Column:
        return F.struct(group.alias("source_group"), name.alias("feature_name"),
                        F.lit(block).alias("block"), value.cast("double").alias("value"))

    single = [cell(F.lit("numeric"), F.lit(c), i, numeric[c]) for i, c in enumerate(spec.numeric)]
    base = len(spec.numeric)
    single += [
        cell(F.lit(f"categorical::{c}"), F.concat(F.lit(f"{c}_"), F.col(c)), base + i, F.lit(1.0))
        for i, c in enumerate(spec.categorical)
    ]
    last = base + len(spec.categorical)

    def map_cells(column: str, namespace: str) -> Column:
        return F.transform(F.map_entries(column), lambda e: cell(
            F.lit(f"structured_map::{namespace}"), F.concat(F.lit(f"{namespace}::"), e["key"]), last, e["value"]))

    parts = [F.array(*single)] if single else []
    return F.concat(*parts, *[map_cells(m, ns) for m, ns in spec.maps.items()])


def long_cells(features: DataFrame, spec: EncodeSpec) -> DataFrame:
    """Raw cells (case_id, source_group, feature_name, block, value); a null category has none."""
    cells = _cells(spec, {c: F.col(c) for c in spec.numeric})
    rows = features.select(CASE, F.explode(cells).alias("c")).select(CASE, "c.*")
    return rows.filter(F.col("feature_name").isNotNull())


def vocabulary_fit(train: DataFrame, spec: EncodeSpec) -> DataFrame:
    """Feature dictionary from training rows: numeric in declared order, categories sorted within
    their column, then map keys sorted; contiguous index from 0.

    The index is a distributed running count, so a large vocabulary does not pass one task.
    """
    names = long_cells(train, spec).select("block", "feature_name", "source_group").distinct()
    numbered = ordered_cumsum(names, ["block", "feature_name", "source_group"], {"n": F.lit(1)})
    return numbered.select(
        (F.col("cum_n") - 1).cast("long").alias("feature_index"), "feature_name", "source_group"
    )


def _tokens(features: DataFrame, spec: EncodeSpec) -> DataFrame:
    """Category and map cells only."""
    return long_cells(features, EncodeSpec([], spec.categorical, spec.maps))


def _unseen(train: DataFrame, test: DataFrame, spec: EncodeSpec) -> DataFrame:
    """Distinct test-only values. Both sides are merged to distinct values before they meet, so
    a value of most rows is one row here."""
    key = ["source_group", "feature_name"]
    return _tokens(test, spec).select(*key).distinct().join(
        _tokens(train, spec).select(*key).distinct(), key, "left_anti"
    )


def unknown_values(train: DataFrame, test: DataFrame, spec: EncodeSpec) -> DataFrame:
    """Test-only categories and map keys with the number of test cases that have them."""
    unseen = measured_broadcast(_unseen(train, test, spec))
    rows = _tokens(test, spec).join(unseen, ["source_group", "feature_name"], "left_semi")
    # A case holds a value once: categories are single and map keys unique.
    return rows.groupBy("source_group", "feature_name").agg(n_rows("test_rows"))


def unknown_audit(train: DataFrame, test: DataFrame, spec: EncodeSpec) -> DataFrame:
    """Per source: training vocabulary size, test-only values, test cases affected. Both sides'
    cells are spread out once."""
    key = ["source_group", "feature_name"]
    seen = cut_lineage(_tokens(train, spec).select(*key).distinct())
    tokens = cut_lineage(_tokens(test, spec).select(CASE, *key))
    sizes = seen.groupBy("source_group").agg(n_rows("train_vocabulary_size"))
    unseen = measured_broadcast(cut_lineage(tokens.select(*key).distinct().join(seen, key, "left_anti")))
    values = unseen.groupBy("source_group").agg(n_rows("test_only_count"))
    rows = tokens.join(unseen, key, "left_semi")
    cases = rows.select("source_group", CASE).distinct().groupBy("source_group").agg(n_rows("test_rows_affected"))
    # A source may occur in the test rows only.
    sources = sizes.select("source_group").unionByName(values.select("source_group")).distinct()
    for part in (sizes, values, cases):
        sources = sources.join(part, "source_group", "left")
    return sources.na.fill(0)


def numeric_stats(train: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Training mean and population standard deviation per numeric column, and the divisor
    used for scaling (1 for a constant column)."""
    one = train.agg(*[
        F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c)
        for c in numeric
    ])
    rows = one.select(F.explode(F.array(*list(numeric))).alias("r")).select("r.*")
    return rows.withColumn("scale", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def _scaled(train: DataFrame, numeric: Sequence[str]) -> dict[str, Column]:
    """z-scores with the training statistics as scalar subqueries."""
    one = train.agg(*[
        F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in numeric
    ])
    stats = scalar(one, F.struct(*list(numeric)))
    out = {}
    for c in numeric:
        s = stats.getField(c)
        std = s.getField("s")
        out[c] = (F.col(c) - s.getField("m")) / F.when(std == 0, F.lit(1.0)).otherwise(std)
    return out


def scale_numeric(train: DataFrame, df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    scaled = _scaled(train, numeric)
    return df.withColumns({c: scaled[c] for c in numeric})


def _numeric_cells(features: DataFrame, spec: EncodeSpec) -> DataFrame:
    """Numeric columns come first in the dictionary, so their index needs no join: their cells
    would all meet on a handful of keys. A missing value is an error, as it is for vectors: it
    would read as 0."""
    def present(c: str) -> Column:
        value = F.col(c).cast("double")
        return F.when(value.isNull(), F.raise_error(F.lit(f"numeric feature {c} is null"))).otherwise(value)

    cells = F.array(*[
        F.struct(F.lit(i).cast("long").alias("feature_index"), present(c).alias("value"))
        for i, c in enumerate(spec.numeric)
    ])
    return features.select(CASE, F.explode(cells).alias("c")).select(CASE, "c.*")


def _token_cells(features: DataFrame, dictionary: DataFrame, spec: EncodeSpec) -> DataFrame:
    known = _tokens(features, spec).join(measured_broadcast(dictionary), ["source_group", "feature_name"])
    return known.select(CASE, "feature_index", "value")


def one_hot(features: DataFrame, dictionary: DataFrame, spec: EncodeSpec) -> DataFrame:
    """Category cells only; an unknown category has no cell."""
    return _token_cells(features, dictionary, EncodeSpec([], spec.categorical, {}))


def encode_tree(features: DataFrame, dictionary: DataFrame, spec: EncodeSpec) -> DataFrame:
    """Non-zero cells with raw numeric values."""
    parts = [_numeric_cells(features, spec)] if spec.numeric else []
    if spec.categorical or spec.maps:
        parts.append(_token_cells(features, dictionary, spec))
    return reduce(DataFrame.unionByName, parts).filter("value <> 0")


def encode_linear(train: DataFrame, features: DataFrame, dictionary: DataFrame, spec: EncodeSpec) -> DataFrame:
    """Non-zero cells with numeric values scaled by the training statistics."""
    return encode_tree(scale_numeric(train, features, spec.numeric), dictionary, spec)


def matrix_stats(cells: DataFrame, cases: DataFrame, dictionary: DataFrame) -> DataFrame:
    one = cells.agg(n_rows("nonzero_entries"))
    out = one.withColumns({
        "rows": scalar(cases, F.count(F.lit(1))),
        "columns": scalar(dictionary, F.count(F.lit(1))),
    })
    density = ratio(F.col("nonzero_entries"), F.col("rows").cast("double") * F.col("columns"))
    return out.select("rows", "columns", "nonzero_entries", density.alias("density"), (1 - density).alias("sparsity"))


def constant_features(train_cells: DataFrame, train: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Features with one value on all training rows: reported, never removed."""
    n = scalar(train, F.count(F.lit(1)))
    stats = train_cells.groupBy("feature_index").agg(
        n_rows("nnz"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    joined = dictionary.join(stats, "feature_index", "left").withColumn("rows", n)
    same = F.col("nnz").isNull() | ((F.col("nnz") == F.col("rows")) & (F.col("lo") == F.col("hi")))
    return joined.filter(same).select("feature_index", "feature_name", "source_group")


def finite_check(cells: DataFrame) -> DataFrame:
    v = F.col("value")
    return cells.agg(
        n_rows("cells"),
        count_where(F.isnan(v)).alias("nan_cells"),
        count_where(F.abs(v) == float("inf")).alias("infinite_cells"),
    )


# --- vectors for Spark ML ---------------------------------------------------------------

def frozen_dictionary(dictionary: DataFrame) -> DataFrame:
    """The dictionary as a small fixed table, after a size check: a model has a coefficient per
    feature, so its vocabulary must fit the driver anyway."""
    rows = dictionary.limit(MAX_MODEL_FEATURES + 1).collect()
    if len(rows) > MAX_MODEL_FEATURES:
        raise ContractError(f"more than {MAX_MODEL_FEATURES} features; prune the vocabulary first")
    return dictionary.sparkSession.createDataFrame(sorted(rows), dictionary.schema)


def assemble(features: DataFrame, dictionary: DataFrame, spec: EncodeSpec, keep: Sequence[str]) -> DataFrame:
    """`features` vector per case in dictionary order, built by Spark ML on the JVM.

    Categories and repeated map keys become tokens that a count vectorizer with the fixed
    vocabulary turns into sparse counts; unknown tokens are ignored. `dictionary` is frozen.
    """
    names = [r["feature_name"] for r in sorted(dictionary.collect())]
    tokens_vocab = names[len(spec.numeric):]
    if len(set(tokens_vocab)) != len(tokens_vocab):
        raise ContractError("feature names are not unique")
    single = [F.concat(F.lit(f"{c}_"), F.col(c)) for c in spec.categorical]

    def repeated(column: str, namespace: str) -> Column:
        return F.flatten(F.transform(F.map_entries(column), lambda e: F.array_repeat(
            F.concat(F.lit(f"{namespace}::"), e["key"]), e["value"].cast("int"))))

    tokens = F.concat(
        F.array_compact(F.array(*single)), *[repeated(m, ns) for m, ns in spec.maps.items()]
    )
    base = features.select(*keep, *[F.col(c).cast("double").alias(c) for c in spec.numeric], tokens.alias("__tokens"))
    counts = CountVectorizerModel.from_vocabulary(tokens_vocab, inputCol="__tokens", outputCol="__counts").transform(base)
    vec = VectorAssembler(inputCols=[*spec.numeric, "__counts"], outputCol="features").transform(counts)
    return vec.select(*keep, "features")
