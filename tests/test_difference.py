import json
import re

import pytest
from pyspark.sql import functions as F

from tracewell.operators import difference as DF


def _table(spark, n=5000):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("a"), F.when(F.col("id") % 11 > 0, F.col("id") * 0.5).alias("b")).repartition(6)


def _write(spark, df, tmp_path, name, like=None):
    return DF.write_version(df, str(tmp_path / name), ["k"], like, rows_per_range=50)


def test_planted_changes_are_found_and_only_their_ranges_read(spark, tmp_path):
    base = _table(spark)
    a = _write(spark, base, tmp_path, "a")
    other = base.filter("k <> 1234").withColumn("b", F.when(F.col("k") == 78, F.lit(None)).otherwise(F.col("b")))
    other = other.unionByName(spark.createDataFrame([(9999, "new", 1.0), (3000, "0", 1500.0)], "k long, a string, b double"))
    b = _write(spark, other, tmp_path, "b", like=a)
    ranges = DF.differing_ranges(spark, a, b).collect()
    assert len(ranges) == 4 and len(a.cuts) > 90
    found = sorted((r.k, r.side, r.change, r.copies, r.b) for r in DF.differences(spark, a, b).collect())
    twice = [r for r in found if r[0] == 3000]
    assert [r for r in found if r[0] != 3000] == [
        (78, "a", "changed", 1, 39.0), (78, "b", "changed", 1, None), (1234, "a", "removed", 1, 617.0), (9999, "b", "added", 1, 1.0)]
    assert twice and twice[0][1:3] == ("b", "added")
    plan = DF._only(a, spark, DF.differing_ranges(spark, a, b))._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[(.*?)\], Pushed", plan).group(1)
    assert all(str(r.node) in filters for r in ranges)
    read = DF._only(a, spark, DF.differing_ranges(spark, a, b)).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({re.search(r"__range=(\d+)", r.f).group(1) for r in read}) == 4


def test_equal_versions_differ_nowhere(spark, tmp_path):
    a = _write(spark, _table(spark), tmp_path, "a")
    b = _write(spark, _table(spark).repartition(3).orderBy("b"), tmp_path, "b", like=a)
    assert DF.differing_ranges(spark, a, b).collect() == [] and DF.differences(spark, a, b).collect() == []
    root = {r.digest for v in (a, b) for r in v.digests(spark).filter(F.col("level") == a.levels).collect()}
    assert len(root) == 1 and a.levels == 2  # a hundred ranges: two levels of sixteen


def test_repeated_rows_and_null_keys_count(spark, tmp_path):
    rows = [(None, "x"), (1, "x"), (1, "x"), (2, None)]
    a = DF.write_version(spark.createDataFrame(rows, "k long, a string"), str(tmp_path / "a"), ["k"], rows_per_range=2)
    b = DF.write_version(spark.createDataFrame([(1, "x"), (2, None), (2, None), (None, "y")], "k long, a string"), str(tmp_path / "b"), ["k"], like=a)
    found = sorted(((r.k, r.a, r.side, r.copies, r.change) for r in DF.differences(spark, a, b).collect()), key=repr)
    assert found == sorted([(None, "x", "a", 1, "changed"), (None, "y", "b", 1, "changed"), (1, "x", "a", 1, "removed"), (2, None, "b", 1, "added")], key=repr)


def test_versions_are_opened_again_and_must_match(spark, tmp_path):
    a = _write(spark, _table(spark, 300), tmp_path, "a")
    assert DF.open_version(spark, a.path) == a
    c = DF.write_version(_table(spark, 300), str(tmp_path / "c"), ["k"], rows_per_range=30)
    with pytest.raises(ValueError):
        DF.differing_ranges(spark, a, c)
    with pytest.raises(ValueError):
        _write(spark, _table(spark, 300).drop("b"), tmp_path, "d", like=a)


def test_empty_tables(spark, tmp_path):
    a = _write(spark, _table(spark, 10).filter("false"), tmp_path, "a")
    b = _write(spark, _table(spark, 3), tmp_path, "b", like=a)
    assert DF.differences(spark, a, a).count() == 0 and DF.differences(spark, a, b).filter("change = 'added'").count() == 3


def test_one_row_a_range_comes_to_the_driver(spark, tmp_path, monkeypatch):
    """The cuts are chosen where the sample is; ranges share tasks."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append(len(rows := collect(self))) or rows)
    base = _table(spark, 20_000)
    a = _write(spark, base, tmp_path, "a")
    ranges = 20_000 // 50
    assert len(json.loads(a.cuts)) == ranges - 1 and max(seen) < 20 * ranges
    sizes = [r["row_count"] for r in collect(a.digests(spark).filter("level = 0"))]
    assert sum(sizes) == 20_000 and len(sizes) == ranges and max(sizes) < 150
    stored = a.rows(spark).withColumn("f", F.regexp_extract(F.input_file_name(), "part-([0-9]+)", 1))
    assert stored.select("f").distinct().count() <= 10


def test_many_ranges_share_folders(spark, tmp_path, monkeypatch):
    """Folders do not grow with the ranges, nor the plan with the cuts; the ranges, their rows and what differs stay the same."""
    base = _table(spark).withColumn("k", F.when(F.col("k") > 0, F.col("k")))  # one null key
    other = base.filter("k is null or k <> 1234").withColumn("b", F.when(F.col("k") == 78, F.lit(None)).otherwise(F.col("b"))).unionByName(
        spark.createDataFrame([(9999, "new", 1.0), (-5, "new", 2.0)], "k long, a string, b double"))
    found, sizes = [], []
    for name, folders, cuts in (("own", 128, 512), ("shared", 10, 7)):
        monkeypatch.setattr(DF, "MAX_FOLDERS", folders, raising=False)
        monkeypatch.setattr(DF, "CUTS_PER_ROW", cuts, raising=False)
        a = _write(spark, base, tmp_path, f"{name}-a")
        b = _write(spark, other, tmp_path, f"{name}-b", like=a)
        assert len(list((tmp_path / f"{name}-a" / "rows").glob("__range=*"))) <= folders
        assert DF.open_version(spark, a.path) == a and DF.differing_ranges(spark, a, b).count() == 4
        sizes.append(sorted((r.level, r.node, r.row_count, r.digest) for v in (a, b) for r in v.digests(spark).collect()))
        found.append(sorted(map(str, DF.differences(spark, a, b).collect())))
        monkeypatch.setattr(DF, "MAX_LISTED", 2)
        assert sorted(map(str, DF.differences(spark, a, b).collect())) == found[-1] and len(found[-1]) == 5
        monkeypatch.undo()
    assert found[0] == found[1] and sizes[0] == sizes[1] and a.per_folder == 10
