import pytest
from pyspark.sql import functions as F

from tracewell.operators import contracts as C
from tracewell.operators.temporal import overlap_counts, window_inherit
from tracewell.sources.logs import core_contract, normalize_log, write_checked
from tracewell.session import scratch_path
from tracewell.spec import LogSpec


def statuses(checks):
    return {r.check: r.status for r in checks.collect()}


def frame(spark):
    return spark.createDataFrame([(1, "a", 0.5), (2, "b", None), (2, "c", float("nan"))], "id int, s string, v double")


def test_checks_pass_and_fail(spark):
    df = frame(spark)
    assert statuses(C.check_required_columns(df, ["id", "x"])) == {"required_columns": "FAIL"}
    assert statuses(C.check_required_columns(df, ["id", "s", "v"], exact=True)) == {"exact_columns": "PASS"}
    assert statuses(C.check_not_null(df, ["id", "v"])) == {"not_null:id": "PASS", "not_null:v": "FAIL"}
    assert statuses(C.check_unique(df, ["id"])) == {"unique:id": "FAIL"}
    assert statuses(C.check_unique(df, ["id", "s"])) == {"unique:id,s": "PASS"}
    assert C.check_domain(df, "v", low=0, high=1).first().observed == "2"  # null and NaN are outside
    assert statuses(C.check_domain(df, "id", values=[1, 2])) == {"domain:id": "PASS"}
    counts = C.check_counts(df, {"rows": (F.count(F.lit(1)), 3), "ids": (F.count_distinct("id"), 3)})
    assert statuses(counts) == {"count:rows": "PASS", "count:ids": "FAIL"}
    with pytest.raises(C.ContractError, match="ids"):
        C.enforce(counts)


def test_disjoint_and_cover(spark):
    a, b, whole = (spark.createDataFrame([(i,) for i in ids], "k int") for ids in ([1, 2], [3], [1, 2, 3, 4]))
    assert statuses(C.check_disjoint(a, b, "k")) == {"disjoint:k": "PASS"}
    assert statuses(C.check_disjoint(a, whole, "k")) == {"disjoint:k": "FAIL"}
    assert statuses(C.check_cover([a, b], whole, "k")) == {"cover:k": "FAIL"}
    assert statuses(C.check_cover([a, b], whole.filter("k < 4"), "k")) == {"cover:k": "PASS"}
    got = {r.pair: r.overlap for r in overlap_counts({"a": a, "b": b, "w": whole}, "k").collect()}
    assert got == {"a&b": 0, "a&w": 2, "b&w": 1}


def test_strict_time_order(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), ("z", 9)], "p string, t int")
    assert statuses(C.check_strict_time_order(df, "p", "t", ["x", "y", "z"])) == {
        "time_order:x<y": "FAIL", "time_order:y<z": "PASS"}


def test_check_close(spark):
    a = spark.createDataFrame([("m", 1.0, None), ("n", 2.0, 5.0)], "k string, v double, w double")
    b = spark.createDataFrame([("m", 1.0 + 1e-13, None), ("n", 2.1, 5.0)], "k string, v double, w double")
    assert statuses(C.check_close(a, b, ["k"], ["v", "w"], 1e-9)) == {"close:v": "FAIL", "close:w": "PASS"}
    assert statuses(C.check_close(a, b.limit(1), ["k"], ["w"], 1e-9)) == {"close:w": "FAIL"}  # a missing row


def test_fingerprint_ignores_row_order_only(spark):
    df = frame(spark)
    same = C.table_fingerprint(df.orderBy(F.desc("s")).repartition(3)).first()
    assert C.table_fingerprint(df).first() == same
    assert C.table_fingerprint(df.withColumn("s", F.upper("s"))).first() != same
    assert C.table_fingerprint(df.unionByName(df.limit(1))).first() != same


def test_write_checked_round_trip(spark):
    df = spark.createDataFrame([("001", 1.5, 'a "quoted", value')], "id string, v double, s string")
    for fmt in ("parquet", "csv"):
        path = scratch_path(spark, "w")
        assert set(statuses(write_checked(df, path, ["id", "s"], fmt)).values()) == {"PASS"}
    twice = df.unionByName(df)
    assert "FAIL" in statuses(write_checked(twice, scratch_path(spark, "w"), ["id"])).values()


def test_window_inherit_reports_misses(spark):
    sample = spark.createDataFrame([(1,), (9,)], "case_id int")
    windows = spark.createDataFrame([(1, "T1"), (2, "T2")], "case_id int, window string")
    got = {r.case_id: (r.window, r.matched) for r in window_inherit(sample, windows, "case_id").collect()}
    assert got == {1: ("T1", True), 9: (None, False)}


def test_ambiguous_order_is_refused(spark):
    src = spark.createDataFrame([("c", "a", "2024-01-01T00:00:00Z", 1), ("c", "b", "2024-01-01T00:00:00Z", 1)],
                                "c string, a string, t string, k int")
    spec = LogSpec("c", "a", "t", "k")
    assert "FAIL" in statuses(core_contract(normalize_log(src, spec))).values()
    with pytest.raises(C.ContractError):
        normalize_log(src, spec, strict=True)
    with pytest.raises(Exception):
        normalize_log(src.withColumn("t", F.lit("not a time")), spec).collect()


def test_fingerprint_tells_borders_and_nulls_apart(spark):
    one = lambda *rows: C.table_fingerprint(spark.createDataFrame(list(rows), "a string, b string")).first()
    assert one(("a|b", "c")) != one(("a", "b|c")) and one((None, "x")) != one(("~null~", "x")) and one((None, "x")) != one(("n", "x"))


def test_text_times_without_a_zone_are_utc_in_any_session_zone(spark):
    from tracewell.spec import LogSpec

    df = spark.createDataFrame([("c", "a", "2024-01-01 00:00:00.5", 1), ("c", "a", "2024-01-01T02:00:00+02:00", 2)],
                               "c string, a string, t string, k long")
    spec = LogSpec(case="c", activity="a", ts="t", order_key="k")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = [r.u for r in normalize_log(df, spec).selectExpr("unix_micros(ts) as u").collect()]
            assert got == [1704067200500000, 1704067200000000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_csv_header_with_other_names_is_refused(spark):
    from tracewell.sources.logs import read_csv

    path = scratch_path(spark, "csv")
    spark.createDataFrame([("1", "x")], "id string, name string").write.option("header", True).csv(path)
    assert read_csv(spark, path, "id string, name string").count() == 1
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, path, "id string, other string").collect()


def test_inherited_windows_are_one_to_one(spark):
    sample = spark.createDataFrame([(1,), (2,), (3,)], "case_id int")
    windows = spark.createDataFrame([(1, "T1"), (1, "T1"), (2, "T1"), (2, "T2")], "case_id int, window string")
    got = {r.case_id: (r.window, r.matched) for r in window_inherit(sample, windows, "case_id").collect()}
    assert got == {1: ("T1", True), 2: (None, False), 3: (None, False)}
    for kept, what in ((sample.filter("case_id <> 3"), "two windows"), (sample.filter("case_id <> 2"), "no window")):
        with pytest.raises(C.ContractError, match=what):
            window_inherit(kept, windows if what == "two windows" else windows.filter("case_id = 1"), "case_id", strict=True)


def test_stored_predictions_are_compared_row_by_row(spark):
    from tracewell.operators.metrics import stored_predictions_audit

    ours = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.1), (3, 0, 0.2)], "case_id int, y_pred int, y_prob double")
    stored = spark.createDataFrame([(1, 0, 0.9), (2, 0, 0.3), (4, 0, 0.1)], "case_id int, y_pred int, y_prob double")
    r = stored_predictions_audit(ours, stored).first()
    assert (r.cases, r.not_stored, r.not_recomputed, r.label_differences, r.probability_differences) == (4, 1, 1, 1, 1)
