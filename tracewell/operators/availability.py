"""Which attributes are known at event k, and which could leak the future.

All attributes are audited in one aggregation per level: per case first (one row per case,
merged map-side), then over the cases. Nothing is grouped once per attribute, and the log is
not multiplied by the number of attributes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.columns import count_where, mapped, n_rows, percent, scalar
from tracewell.operators.contracts import ContractError
from tracewell.operators.order import exact_quantiles
from tracewell.operators.profile import attribute_location
from tracewell.session import cut_lineage
from tracewell.spec import ACTIVITY, CASE, POS, TS


def eligible_log(ordered: DataFrame, eligible_flags: DataFrame) -> DataFrame:
    return ordered.join(eligible_flags.filter("eligible").select(CASE), CASE, "left_semi")


def first_seen(log: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Per case and attribute: first position with a value, several values, zero at event 1."""
    aggs = []
    for a in attributes:
        c = F.col(a)
        aggs += [
            F.min(F.when(c.isNotNull(), F.col(POS))).alias(f"{a}__first"),
            F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(f"{a}__multi"),
            F.max((F.col(POS) == 1) & c.isNotNull() & (c.cast("string").try_cast("double") == 0)).alias(f"{a}__zero1"),
        ]
    return log.groupBy(CASE).agg(*aggs)


def _per_attribute(per_case: DataFrame, attributes: Sequence[str], measures: Mapping[str, object]) -> DataFrame:
    """One aggregation with every measure of every attribute, reshaped to a row per attribute.

    `measures` maps an output name to a function from attribute name to aggregate column.
    """
    one = per_case.agg(*[
        F.struct(F.lit(a).alias("feature"), *[m(a).alias(n) for n, m in measures.items()]).alias(a)
        for a in attributes
    ])
    rows = one.select(F.explode(F.array(*[F.col(a) for a in attributes])).alias("r"))
    return rows.select("r.*")


def first_seen_distribution(log: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Cases per attribute and first-seen position."""
    per_case = first_seen(log, attributes)
    names = [f"{a}__first" for a in attributes]
    long = per_case.unpivot([], names, "n", "first_seen_event").filter("first_seen_event is not null")
    feature = F.regexp_replace("n", "__first$", "").alias("feature")
    return long.groupBy(feature, "first_seen_event").agg(n_rows("case_count"))


def _median_first_seen(per_case: DataFrame, attributes: Sequence[str]) -> DataFrame:
    names = [f"{a}__first" for a in attributes]
    long = per_case.unpivot([], names, "n", "p").select(
        F.regexp_replace("n", "__first$", "").alias("feature"), "p"
    )
    return exact_quantiles(long, "p", {"first_seen_median": 0.5}, ["feature"])


def _availability(log: DataFrame, attributes: Sequence[str], k: int) -> DataFrame:
    def first(a: str) -> Column:
        return F.col(f"{a}__first")

    measures = {
        "total_cases": lambda a: F.count(F.lit(1)),
        "ever_available": lambda a: F.count(first(a)),
        "available_by_k": lambda a: count_where(first(a) <= k),
        "future_only": lambda a: count_where(first(a) > k),
        "never_observed": lambda a: count_where(first(a).isNull()),
        "first_seen_min": lambda a: F.min(first(a)),
        "first_seen_max": lambda a: F.max(first(a)),
        "multi_value_cases": lambda a: count_where(F.col(f"{a}__multi")),
        "missing_at_event_1": lambda a: count_where(F.coalesce(first(a) != 1, F.lit(True))),
        "zero_at_event_1": lambda a: count_where(F.col(f"{a}__zero1")),
    }
    # The per-case table feeds two aggregations; the log behind it is ordered only once.
    per_case = cut_lineage(first_seen(log, attributes))
    rows = _per_attribute(per_case, attributes, measures)
    return rows.join(_median_first_seen(per_case, attributes), "feature", "left")


def case_attr_availability(elog: DataFrame, attributes: Sequence[str], k: int) -> DataFrame:
    return _availability(elog, attributes, k).select(
        "feature", "total_cases", "ever_available", "available_by_k",
        percent(F.col("available_by_k"), F.col("total_cases")).alias("availability_percentage"),
        "first_seen_median", "first_seen_max", "future_only", "never_observed", "multi_value_cases",
        "missing_at_event_1", "zero_at_event_1",
    )


def sparse_availability(elog: DataFrame, attributes: Sequence[str], k: int) -> DataFrame:
    total = F.col("total_cases")
    return _availability(elog, attributes, k).select(
        "feature", "total_cases", "ever_available", "available_by_k",
        percent(F.col("available_by_k"), total).alias("available_by_k_pct"),
        "future_only", percent(F.col("future_only"), total).alias("future_only_pct"),
        "never_observed", percent(F.col("never_observed"), total).alias("never_observed_pct"),
        "first_seen_min", "first_seen_median", "first_seen_max", "multi_value_cases",
    )


def event_completeness(prefix: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Row completeness and case coverage of each attribute in the prefix."""
    per_case = prefix.groupBy(CASE).agg(n_rows("__rows"), *[F.count(a).alias(f"{a}__n") for a in attributes])
    rows = _per_attribute(per_case, attributes, {
        "total_prefix_rows": lambda a: F.sum("__rows"),
        "non_null_prefix_rows": lambda a: F.sum(f"{a}__n"),
        "cases": lambda a: F.count(F.lit(1)),
        "cases_with_value": lambda a: count_where(F.col(f"{a}__n") > 0),
    })
    total, filled = F.col("total_prefix_rows"), F.col("non_null_prefix_rows")
    return rows.select(
        "feature", "total_prefix_rows", "non_null_prefix_rows",
        (total - filled).alias("missing_prefix_rows"),
        percent(filled, total).alias("row_completeness_percentage"),
        percent(total - filled, total).alias("missing_rate"),
        "cases_with_value",
        (F.col("cases") - F.col("cases_with_value")).alias("cases_with_no_value"),
        percent(F.col("cases_with_value"), F.col("cases")).alias("case_coverage_percentage"),
    )


def missing_by_position(prefix: DataFrame, attributes: Sequence[str], k: int) -> DataFrame:
    """Filled and missing rows per position; every position 1..k is present."""
    counts = prefix.groupBy(POS).agg(n_rows("total"), *[F.count(a).alias(a) for a in attributes])
    positions = prefix.sparkSession.range(1, k + 1).withColumnRenamed("id", POS)
    full = positions.join(counts, POS, "left").na.fill(0)
    long = full.unpivot([POS, "total"], list(attributes), "feature", "non_missing")
    missing = F.col("total") - F.col("non_missing")
    return long.select(
        "feature", POS, "total", "non_missing", missing.alias("missing"),
        percent(missing, F.col("total")).alias("missing_pct"),
    )


def attr_context(elog: DataFrame, attributes: Sequence[str], context: Sequence[str]) -> DataFrame:
    """Rows with a value per attribute and context column value (activity, origin, ...)."""
    parts = [
        attribute_location(elog, attributes, (c,)).select(
            "attribute", F.lit(c).alias("context"), F.col(c).cast("string").alias("context_value"), "row_count"
        )
        for c in context
    ]
    return reduce(DataFrame.unionByName, parts)


# --- items created inside a case and their later life -----------------------------------

def semantic_value_dist(elog: DataFrame, create: str, features: Sequence[str]) -> DataFrame:
    """Value counts on the creating activity; percent of its rows, null values included."""
    rows = elog.filter(F.col(ACTIVITY) == create)
    total = scalar(rows, F.count(F.lit(1)))
    pairs = rows.select(*[F.col(f).cast("string").alias(f) for f in features]).unpivot(
        [], list(features), "feature", "value"
    )
    counts = pairs.groupBy("feature", "value").agg(n_rows("row_count"))
    return counts.withColumn("percentage", percent(F.col("row_count"), total))


def _with_outcome(df: DataFrame, cases: DataFrame) -> DataFrame:
    labels = cases.select(CASE, "outcome_activity")
    return df.join(labels, CASE, "left")


def _crosstab(df: DataFrame, key: Sequence[str], outcomes: Sequence[str], total: str) -> DataFrame:
    """Counts per declared outcome (0 when absent) and their sum."""
    cells = [count_where(F.col("outcome_activity") == o).alias(o) for o in outcomes]
    counts = df.groupBy(*key).agg(*cells)
    return counts.withColumn(total, reduce(lambda a, b: a + b, [F.col(o) for o in outcomes]))


def outcome_value_presence(
    elog: DataFrame, cases: DataFrame, create: str, features: Sequence[str], outcomes: Sequence[str]
) -> DataFrame:
    """Value x outcome over distinct (case, value)."""
    rows = elog.filter(F.col(ACTIVITY) == create)
    pairs = rows.select(CASE, *[F.col(f).cast("string").alias(f) for f in features]).unpivot(
        [CASE], list(features), "feature", "value"
    )
    members = _with_outcome(pairs.distinct(), cases)
    return _crosstab(members, ["feature", "value"], outcomes, "case_value_memberships")


def outcome_value_pattern(
    elog: DataFrame, cases: DataFrame, create: str, features: Sequence[str], outcomes: Sequence[str]
) -> DataFrame:
    """Each case's sorted set of values joined by ' | ', crossed with its outcome."""
    rows = elog.filter(F.col(ACTIVITY) == create)
    sets = rows.groupBy(CASE).agg(*[
        F.array_join(F.array_sort(F.collect_set(F.col(f).cast("string"))), " | ").alias(f) for f in features
    ])
    long = _with_outcome(sets, cases).unpivot([CASE, "outcome_activity"], list(features), "feature", "value_pattern")
    return _crosstab(long, ["feature", "value_pattern"], outcomes, "unique_cases")


def item_multiplicity(elog: DataFrame, create: str, features: Sequence[str]) -> DataFrame:
    """Cases with several created items or several values, and distinct (case, value) pairs."""
    per_case = elog.filter(F.col(ACTIVITY) == create).groupBy(CASE).agg(
        n_rows("__items"), *[F.count_distinct(f).alias(f) for f in features]
    )
    return _per_attribute(per_case, features, {
        "cases_with_create": lambda f: F.count(F.lit(1)),
        "cases_with_multiple_creates": lambda f: count_where(F.col("__items") > 1),
        "cases_with_multiple_values": lambda f: count_where(F.col(f) > 1),
        "case_value_memberships": lambda f: F.sum(f),
    })


def link_next_event(
    ordered: DataFrame, create: str, expected: str, item: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Creating rows with the id carried by the immediately next event, if that event is the
    expected activity and has an id.

    Positions are dense, so an event is matched to its predecessor by (case, position) in one
    aggregation instead of a window over the whole case; no group has more than two rows.
    """
    own = F.struct(*keep, F.lit(True).alias("__is_create"))
    own_type = T.StructType(
        [T.StructField(c, ordered.schema[c].dataType) for c in keep] + [T.StructField("__is_create", T.BooleanType())]
    )
    is_create = F.col(ACTIVITY) == create
    is_next = (F.col(ACTIVITY) == expected) & F.col(item).isNotNull()
    slots = F.array_compact(F.array(
        F.when(is_create, F.struct(F.col(POS).alias("at"), own.alias("own"),
                                   F.lit(None).cast(ordered.schema[item].dataType).alias("next_item"))),
        F.when(is_next, F.struct((F.col(POS) - 1).alias("at"), F.lit(None).cast(own_type).alias("own"),
                                 F.col(item).alias("next_item"))),
    ))
    parts = ordered.filter(is_create | is_next).select(CASE, F.explode(slots).alias("s")).select(CASE, "s.*")
    pairs = parts.groupBy(CASE, F.col("at").alias(POS)).agg(
        F.first("own", ignorenulls=True).alias("own"), F.max("next_item").alias("linked_item")
    )
    return pairs.filter(F.col("own.__is_create")).select(
        CASE, POS, *[F.col(f"own.{c}").alias(c) for c in keep], "linked_item",
        F.col("linked_item").isNotNull().alias("linked"),
    )


def state_of(activity: Column, prefixes: Mapping[str, str]) -> Column:
    """State of an activity by prefix, so that variants of one state merge; null otherwise."""
    out: Column = F.lit(None).cast("string")
    for prefix, state in reversed(list(prefixes.items())):
        out = F.when(activity.startswith(prefix), F.lit(state)).otherwise(out)
    return out


def lifecycle_first_state(ordered: DataFrame, item: str, prefixes: Mapping[str, str]) -> DataFrame:
    """First position of each state per (case, item), a column per state."""
    states = list(dict.fromkeys(prefixes.values()))
    tagged = ordered.withColumn("__state", state_of(F.col(ACTIVITY), prefixes))
    rows = tagged.filter(F.col("__state").isNotNull() & F.col(item).isNotNull())
    return rows.groupBy(CASE, item).agg(*[
        F.min(F.when(F.col("__state") == s, F.col(POS))).alias(f"first_{s}") for s in states
    ])


def later_state(linked: DataFrame, first_states: DataFrame, item: str, states: Sequence[str]) -> DataFrame:
    """Did the linked item reach each state at a later position; unlinked items did not."""
    right = first_states.withColumnRenamed(item, "linked_item")
    joined = linked.join(right, [CASE, "linked_item"], "left")
    flags = {
        f"later_{s}": F.col("linked") & F.coalesce(F.col(f"first_{s}") > F.col(POS), F.lit(False)) for s in states
    }
    return joined.withColumns(flags).drop(*[f"first_{s}" for s in states])


def lifecycle_relationship(later: DataFrame, feature: str, states: Sequence[str]) -> DataFrame:
    """Per value of the created item: how often each later state followed."""
    counts = later.groupBy(F.col(feature).cast("string").alias("value")).agg(
        n_rows("create_rows"),
        count_where(F.col("linked")).alias("linked_rows"),
        *[count_where(F.col(f"later_{s}")).alias(f"later_{s}") for s in states],
    )
    pct = {f"later_{s}_pct": percent(F.col(f"later_{s}"), F.col("create_rows")) for s in states}
    return counts.withColumns(pct).withColumn("feature", F.lit(feature))


def representative_traces(
    elog: DataFrame, create: str, is_item_event: Column, varied: Sequence[str]
) -> DataFrame:
    """Rows of up to len(varied) + 1 example cases: the shortest item trace among cases with
    several creations, then among cases with several values of each attribute, without repeats.

    Each group's few best candidates are enough to avoid repeats, so a handful of rows decide.
    """
    on_create = F.col(ACTIVITY) == create
    per_case = elog.groupBy(CASE).agg(
        count_where(is_item_event).alias("size"),
        (count_where(on_create) > 1).alias("g0"),
        *[
            F.coalesce(F.min(F.when(on_create, F.col(a))) != F.max(F.when(on_create, F.col(a))), F.lit(False))
            .alias(f"g{i}")
            for i, a in enumerate(varied, 1)
        ],
    )
    groups = [f"g{i}" for i in range(len(varied) + 1)]
    best = [
        per_case.filter(F.col(g)).orderBy("size", CASE).limit(len(groups)).select(F.lit(g).alias("g"), "size", CASE)
        for g in groups
    ]
    candidates = reduce(DataFrame.unionByName, best).collect()
    picked: list = []
    for g in groups:
        free = sorted((r["size"], r[CASE]) for r in candidates if r["g"] == g and r[CASE] not in picked)
        if free:
            picked.append(free[0][1])
    return elog.filter(F.col(CASE).isin(picked) & is_item_event) if picked else elog.filter(F.lit(False))


def context_only_confirm(
    elog: DataFrame, prefix: DataFrame, attributes: Sequence[str], activity: str, k: int
) -> DataFrame:
    """Attribute occurs only on one activity, and the prefix holds exactly the source values
    of events 1..k (nothing carried back from the suffix)."""
    counts = elog.agg(*[
        F.struct(
            F.count(a).alias("non_null_rows"),
            count_where(F.col(a).isNotNull() & (F.col(ACTIVITY) != activity)).alias("rows_elsewhere"),
            count_where(F.col(a).isNotNull() & F.col(TS).isNull()).alias("rows_without_time"),
        ).alias(a)
        for a in attributes
    ])
    rows = counts.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("feature"), F.col(a).alias("c")) for a in attributes
    ])).alias("r")).select("r.feature", "r.c.*")

    def signed(df: DataFrame, weight: int) -> DataFrame:
        long = df.select(CASE, POS, *[F.col(a).cast("string").alias(a) for a in attributes]).unpivot(
            [CASE, POS], list(attributes), "feature", "value"
        )
        return long.withColumn("w", F.lit(weight))

    both = signed(prefix, 1).unionByName(signed(elog.filter(F.col(POS) <= k), -1))
    net = both.groupBy("feature", CASE, POS, "value").agg(F.sum("w").alias("w"))
    diff = net.groupBy("feature").agg(count_where(F.col("w") != 0).alias("differing_rows"))
    return rows.join(diff, "feature").select(
        "feature", "non_null_rows", F.lit(activity).alias("activity"),
        (F.col("rows_elsewhere") == 0).alias("only_on_activity"),
        (F.col("rows_without_time") == 0).alias("timestamps_present"),
        (F.col("differing_rows") == 0).alias("prefix_matches_source"),
    )


def identifier_audit(prefix: DataFrame, identifiers: Sequence[str]) -> DataFrame:
    """Completeness, coverage and uniqueness of identifier columns in the prefix."""
    complete = event_completeness(prefix, identifiers)
    pairs = prefix.select(*[F.col(c).cast("string").alias(c) for c in identifiers]).unpivot(
        [], list(identifiers), "feature", "value"
    ).filter("value is not null")
    distinct = pairs.distinct().groupBy("feature").agg(n_rows("distinct_values"))
    return complete.join(distinct, "feature", "left").select(
        "feature", "total_prefix_rows", "non_null_prefix_rows", "missing_prefix_rows",
        "row_completeness_percentage", "cases_with_value", "case_coverage_percentage",
        F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
        (F.col("non_null_prefix_rows") - F.coalesce("distinct_values", F.lit(0))).alias("duplicated_rows"),
    )


def case_frequency(prefix: DataFrame, eligible_flags: DataFrame, k: int) -> DataFrame:
    """Every eligible case occurs exactly k times in the prefix."""
    per_case = prefix.groupBy(CASE).agg(n_rows())
    one = per_case.agg(
        n_rows("distinct_case_ids"), F.min("n").alias("minimum_rows_per_case"), F.max("n").alias("maximum_rows_per_case")
    ).withColumn("eligible_cases", scalar(eligible_flags.filter("eligible"), F.count(F.lit(1))))
    return one.withColumn(
        "every_case_occurs_k_times",
        (F.col("distinct_case_ids") == F.col("eligible_cases"))
        & (F.col("minimum_rows_per_case") == k) & (F.col("maximum_rows_per_case") == k),
    )


# --- decisions --------------------------------------------------------------------------

# Decision names.
DECISIONS = ("Available", "Conditionally Available", "Leakage Risk")
DECISION_COLUMNS = [
    "feature", "practically_available", "future_dependency", "availability_decision", "model_handling",
    "reason", "notes",
]


def decision_table(spark, rows: Sequence[Mapping[str, str]]) -> DataFrame:
    return spark.createDataFrame(
        [tuple(r[c] for c in DECISION_COLUMNS) for r in rows], ", ".join(f"{c} string" for c in DECISION_COLUMNS)
    )


def availability_matrix(measured: Mapping[str, DataFrame], decisions: DataFrame, strict: bool = False) -> DataFrame:
    """Measured availability (group -> feature, count, percent) joined 1:1 to the decisions.

    Strict mode refuses a feature without exactly one decision. The tables hold one row per
    attribute.
    """
    parts = [
        df.toDF("feature", "availability_at_k", "pct").select(
            "feature", F.lit(group).alias("feature_group"), "availability_at_k",
            (F.col("pct") / 100).alias("availability_pct"),
        )
        for group, df in measured.items()
    ]
    empirical = reduce(DataFrame.unionByName, parts)
    if strict:
        both = empirical.select("feature", F.lit(1).alias("e"), F.lit(0).alias("d")).unionByName(
            decisions.select("feature", F.lit(0).alias("e"), F.lit(1).alias("d")))
        bad = both.groupBy("feature").agg(F.sum("e").alias("e"), F.sum("d").alias("d")).filter("e <> 1 or d <> 1")
        names = [r[0] for r in bad.limit(50).collect()]
        if names:
            raise ContractError(f"features without exactly one measurement and one decision: {names}")
    return empirical.join(decisions, "feature")


def decision_counts(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("availability_decision").agg(n_rows("features"))


def feature_policy(matrix: DataFrame, rules: Mapping[tuple[str, str], str], strict: bool = False) -> DataFrame:
    """Handling class of every attribute; `rules` maps (group, handling) of available ones to a
    class, and strict mode refuses a pair that it lacks."""
    decision = F.col("availability_decision")
    policy = mapped(
        F.concat_ws("|", "feature_group", "model_handling"),
        {"|".join(pair): name for pair, name in rules.items()} or {"": ""},
    )
    handling = (
        F.when(decision == "Available", policy)
        .when(decision == "Conditionally Available", "conditional_omitted")
        .when(decision == "Leakage Risk", "leakage_risk_omitted")
    )
    out = matrix.select("feature", "feature_group", "availability_decision", "model_handling",
                        handling.alias("handling"), "reason")
    if strict:
        bad = [r[0] for r in out.filter("handling is null").select("feature").limit(50).collect()]
        if bad:
            raise ContractError(f"no handling rule for: {bad}")
    return out


def feature_manifest(policy: DataFrame) -> DataFrame:
    """Included, excluded, conditional and leaking attributes with the reason."""
    h = F.col("handling")
    status = (
        F.when(h.isin("raw_static", "count_map", "timing"), "included")
        .when(h == "identifier_only", "excluded_identifier")
        .when(h == "conditional_omitted", "conditional_omitted")
        .when(h == "leakage_risk_omitted", "leakage_risk_omitted")
        .otherwise("unknown")
    )
    return policy.select("feature", F.col("feature_group").alias("source"), status.alias("status"),
                         F.coalesce(h, F.lit("unknown")).alias("handling"), "reason")
