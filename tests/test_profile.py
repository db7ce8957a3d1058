import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracewell.functions.columns import micros
from tracewell.operators import profile as E
from tracewell.operators.attribution import feature_groups, local_examples, waterfall_data
from tracewell.operators.contracts import ContractError


def test_cardinality_exact_and_approximate(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else None) for i in range(50)], "a int, b string")
    exact = {r.column: r.distinct_values for r in E.column_cardinality(df, ["a", "b"]).collect()}
    about = {r.column: r.distinct_values for r in E.column_cardinality(df, ["a", "b"], approximate=True).collect()}
    assert exact == {"a": 50, "b": 1} and about["b"] == 1 and abs(about["a"] - 50) <= 5


def test_rows_of_inconsistent_cases(spark):
    rows = [("a", 1, None), ("a", 2, "x"), ("b", 3, "y"), ("b", 4, "y")]
    log = spark.createDataFrame(rows, "case_id string, order_key long, goal string").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp"))
    assert {r.case_id for r in E.inconsistent_case_rows(log, "goal").collect()} == {"a"}
    first = {r.case_id: r.goal for r in E.case_table(log, ["goal"]).collect()}
    assert first == {"a": None, "b": "y"}  # the first row, even where its value is null


def test_duplicates_compare_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "k int, v string")
    r = E.duplicate_count(df, ["k", "v"]).first()
    assert (r.extra_rows, r.rows_involved) == (1, 2)


def test_epoch_does_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 7, 1, 12),)], "t timestamp").select(F.lit("2024-07-01 12:00:00").cast("timestamp_ntz").alias("t"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert df.select(micros(F.col("t"))).first()[0] == 1719835200 * 10**6
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_feature_groups_refuse_unmapped_and_misnamed(spark):
    dic = spark.createDataFrame([("a::x", "map::a"), ("b::y", "map::a")], "feature_name string, source_group string")
    assert feature_groups(dic, {"map::a": "A"}).count() == 2
    with pytest.raises(ContractError):
        feature_groups(dic, {"map::a": "A"}, {"map::a": "a::"}, strict=True)
    with pytest.raises(ContractError):
        feature_groups(dic, {"map::z": "A"}, strict=True)


def test_first_example_of_each_category(spark):
    rows = [(9, 1, 1), (3, 1, 1), (5, 0, 1), (4, 0, 0)]
    df = spark.createDataFrame([(f"c{o}", o, t, p, 0.5) for o, t, p in rows],
                               "case_id string, sample_order int, y_true int, y_pred int, y_prob double")
    got = {r.category: r.sample_order for r in local_examples(df).collect()}
    assert got == {"TP": 3, "FP": 5, "TN": 4}


def test_waterfall_ends_at_the_output(spark):
    rows = [("TP", f"f{i:02d}", (-1) ** i * i / 10) for i in range(20)]
    df = spark.createDataFrame(rows, "category string, feature string, shap_value double").withColumns(
        {"abs_shap_value": F.abs("shap_value"), "base_value": F.lit(0.5)})
    steps = waterfall_data(df, limit=15).orderBy("step").collect()
    assert len(steps) == 15 and steps[-1].feature == "(rest)"
    assert abs(steps[-1].running_total - (0.5 + sum(r[2] for r in rows))) < 1e-12
    short = waterfall_data(df.filter("feature < 'f15'"), limit=15).collect()
    assert len(short) == 15 and "(rest)" not in {r.feature for r in short}  # exactly the limit: nothing to merge
