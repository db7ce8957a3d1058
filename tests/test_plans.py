"""What the physical plans must and must not contain."""

import re

import pytest

from tests.oracle import TESTDATA
from tracewell.operators import encode as N
from tracewell.operators import metrics as M
from tracewell.operators import population as P
from tracewell.operators import profile as E
from tracewell.plans import feature_queries as Q
from tracewell.plans import tables as TB

SF = f"{TESTDATA}/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def logical(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_prefix_is_cut_before_the_shuffle(spark):
    text = plan(TB.l1_prefix(spark, SF))
    below = text[text.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in below and "row_number(), 3, Partial" in below


def test_labels_read_only_narrow_columns(spark):
    text = plan(TB.l1_cases(spark, SF))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "props" not in schema
    assert text.count("Exchange hashpartitioning") == 1  # the aggregation reuses the window's partitioning


def test_filters_reach_the_scan(spark):
    text = plan(E.target_distribution(TB.l2(spark, SF), ["F"]))
    assert "PushedFilters" in text and "EqualTo(o_orderstatus,F)" in text


@pytest.mark.parametrize("build", [
    lambda s: TB.l1_ordered(s, SF),
    lambda s: Q.case_features(s, SF),
    lambda s: P.future_suffix(TB.l1_ordered(s, SF), TB.l1_cases(s, SF), 3),
    lambda s: M.score_table(TB.scores(s, SF)),
    lambda s: M.roc_curve(TB.scores(s, SF), ["lang"]),
    lambda s: N.vocabulary_fit(Q.case_features(s, SF), Q.ENCODE),
    lambda s: Q._window_rows(s, SF),
])
def test_no_single_partition_and_no_cross_join(spark, build):
    text = plan(build(spark))
    assert "SinglePartition" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_no_cross_joins_in_any_sql_free_profile(spark):
    for name in ("value_distribution", "iqr_outliers", "histogram_bins", "zero_value_check"):
        from tracewell.plans import registry

        text = plan(registry.queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_cells_are_encoded_without_a_shuffle(spark):
    train, test = Q.split_features(spark, SF)
    dictionary = N.vocabulary_fit(train, Q.ENCODE)
    text = plan(N.encode_tree(test, dictionary, Q.ENCODE))
    assert "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text


def test_metrics_stay_on_the_jvm(spark):
    for df in (M.ranking_metrics(TB.scores(spark, SF), ["lang"]), Q.case_features(spark, SF)):
        assert "Python" not in plan(df) and "Arrow" not in plan(df)


def test_running_sums_shuffle_once_after_the_merge(spark):
    from pyspark.sql import functions as F

    from tracewell.operators.order import _with_range_number, ordered_cumsum

    rows = spark.range(5000).select((F.col("id") % 10 != 0).cast("int").alias("k"), F.col("id").alias("v"))
    ranged = _with_range_number(rows, ["k", "v"])  # one key has nine rows in ten
    sizes = [r["count"] for r in ranged.groupBy("__range").count().collect()]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(sizes) == ranges and max(sizes) < 1.5 * 5000 / ranges
    text = plan(ordered_cumsum(rows, ["v"], {"n": F.lit(1)}, ["k"]))
    wide = [line for line in text.splitlines() if "Exchange" in line and "v#" in line]
    assert sum("Exchange" in line for line in text.splitlines()) <= 4 and text.count("shufflepartitionidpassthrough") <= 2, wide


def test_windows_join_cases_before_they_are_spread(spark):
    from tracewell.plans import model_queries as MQ

    text = logical(MQ._a1_windowed(spark, SF))
    assert text.index("Generate") < text.index("Join")


def test_a_document_is_read_by_several_tasks(spark):
    import os
    import tempfile

    from tracewell.sources.xes import read_xes

    folder = tempfile.mkdtemp(prefix="tracewell-xes-")
    event = '<event><string key="concept:name" value="a"/><date key="time:timestamp" value="2024-01-01T00:00:00.123456Z"/></event>'
    with open(os.path.join(folder, "log.xes"), "w") as f:
        f.write('<?xml version="1.0"?>\n<log>\n')
        for i in range(4000):
            f.write(f'<trace><string key="concept:name" value="c{i}"/>{event * 3}</trace>\n')
        f.write("</log>\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        log = read_xes(spark, folder, {}, {})
        assert log.rdd.getNumPartitions() > 3
        assert log.count() == 12_000 and log.select("case_id").distinct().count() == 4000
        assert log.first().ts.microsecond == 123456
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _scans(df, table: str) -> int:
    return len(re.findall(rf"Location: InMemoryFileIndex[^\n]*/{table}\\.parquet", plan(df)))


def test_tables_are_scanned_at_most_twice(spark):
    from tracewell.plans import registry

    q = registry.queries()
    for name, table in (("feature_table_checks", "events"), ("distribution_reconcile", "orders"), ("window_metrics", "documents"),
                        ("prefix_summary", "events"), ("future_suffix", "events"), ("check_close", "documents")):
        assert _scans(q[name](spark, SF), table) <= 2, name


def test_the_models_share_one_split(spark, monkeypatch):
    """The case features are built once for a fit and for what is checked against it."""
    from tracewell.plans import registry

    made = []
    monkeypatch.setattr(Q, "case_features", lambda s, d, f=Q.case_features: made.append(d) or f(s, d))
    rows = {r.against: r for r in registry.queries()["linear_additivity"](spark, SF + "/.").collect()}
    assert len(made) == 1 and rows["model"].above_1e_09 == 0 and rows["moved"].above_1e_09 > 0
