"""Differences between two stored versions of a table, found by a tree of hashes over key ranges.

A version is written as sorted key ranges, one folder each or neighbours together, with the digest of each range and, level by level,
digests of FANOUT neighbouring digests up to one root. Two versions with the same ranges are compared from their
roots down; only children of differing nodes are looked at, and only the ranges whose own digests differ
are read. Equal tables are told by one row.

A range's digest adds up hashes of its rows, so the order of rows does not matter and repeated rows count. A later
version takes its ranges from an earlier one; without that the ranges have about ROWS_PER_RANGE rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.columns import n_rows
from tracewell.functions.tables import measured_broadcast
from tracewell.operators.contracts import row_digest
from tracewell.operators.order import SAMPLED, ordered_cumsum, range_of
from tracewell.session import cut_lineage

FANOUT = 16
ROWS_PER_RANGE = 100_000
# Ranges named in a filter that prunes folders; a longer list is joined instead.
MAX_LISTED = 10_000
# Folders of a version; with more ranges neighbours share a folder, of about ROWS_PER_RANGE rows where that makes more folders.
MAX_FOLDERS = 128
# Cuts compiled into a plan; more of them are a table with so many cuts a row.
CUTS_PER_ROW = 512
_RANGE = "__range"  # of the folder, which is the range itself where each has its own
_NODE = "__node"
_DIGEST = "level int, node int, row_count long, digest string"


@dataclass(frozen=True)
class Version:
    """A stored version: rows below `path`/rows by range, digests in `path`/digests, keys and cuts in `path`/ranges."""

    path: str
    keys: tuple[str, ...]
    columns: tuple[str, ...]
    cuts: str
    levels: int
    schema: str
    per_folder: int = 1

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType.fromJson(json.loads(self.schema))).parquet(f"{self.path}/rows")

    def digests(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_DIGEST).parquet(f"{self.path}/digests")


def _literals(df: DataFrame, keys: Sequence[str], cuts: Sequence[Sequence[str]]) -> list[Column]:
    kinds = [df.schema[k].dataType for k in keys]
    return [F.struct(*[F.lit(v).cast(kind) for v, kind in zip(row, kinds)]) for row in cuts]


def _with_node(df: DataFrame, keys: Sequence[str], cuts: Sequence[Sequence[str]]) -> DataFrame:
    """The rows with the number of cuts at or below their keys. Many cuts are a table: a plan holds one of CUTS_PER_ROW of them."""
    key = F.struct(*keys)
    if len(cuts) <= CUTS_PER_ROW:
        return df.withColumn(_NODE, range_of(key, _literals(df, keys, cuts)).cast("int"))
    names = [f"k{i}" for i in range(len(keys))]
    listed = df.sparkSession.createDataFrame(
        [(i // CUTS_PER_ROW, i, *row) for i, row in enumerate(cuts)], ", ".join(["__part int, i int", *[f"{n} string" for n in names]]))
    cut = F.struct(*[F.col(n).cast(df.schema[k].dataType).alias(k) for n, k in zip(names, keys)]).alias("cut")
    parts = listed.groupBy("__part").agg(F.array_sort(F.collect_list(F.struct("i", cut))).alias("c")).select(
        "__part", F.transform("c", lambda x: x["cut"]).alias("__cuts"))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(CUTS_PER_ROW.bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get("__cuts", at + step - 1) <= key, step).otherwise(0))
    first = df.withColumn("__part", range_of(key, _literals(df, keys, cuts[CUTS_PER_ROW::CUTS_PER_ROW])).cast("int"))
    return first.join(measured_broadcast(parts), "__part").select(*df.columns, (F.col("__part") * CUTS_PER_ROW + below).cast("int").alias(_NODE))


def _choose_cuts(df: DataFrame, keys: Sequence[str], rows_per_range: int) -> str:
    narrow = df.select(*keys)
    rows = narrow.count()
    ranges = -(-rows // rows_per_range)
    sample = narrow.sample(min(1.0, SAMPLED * ranges / max(rows, 1)), 7) if rows > SAMPLED * ranges else narrow
    cum = ordered_cumsum(sample, list(keys), {"n": F.lit(1)})
    step = F.col("total_n") / F.lit(max(ranges, 1))
    # how many of the places i * step, i = 1 to ranges - 1, come before a row's last and its first place
    before = lambda place: F.greatest(F.lit(0), F.least(F.lit(ranges - 1), F.ceil(place / step) - 1))
    chosen = cum.filter(before(F.col("cum_n")) > before(F.col("cum_n") - F.col("n")))
    # one row a range comes to the driver, not the sample
    cuts = chosen.orderBy("cum_n").select(*[F.col(k).cast("string").alias(k) for k in keys]).collect()
    return json.dumps([list(c) for c in cuts])


def write_version(df: DataFrame, path: str, keys: Sequence[str], like: Version | None = None, rows_per_range: int = ROWS_PER_RANGE) -> Version:
    """Store a version of the table; `like` is the version it will be compared with."""
    spark, columns = df.sparkSession, list(df.columns) if like is None else list(like.columns)
    if sorted(columns) != sorted(df.columns):
        raise ValueError(f"columns {sorted(df.columns)} are not those of the other version, {sorted(columns)}")
    cuts = _choose_cuts(df, keys, rows_per_range) if like is None else like.cuts
    listed = json.loads(cuts)
    count, rows = len(listed) + 1, df.count()
    per_folder = -(-count // max(MAX_FOLDERS, rows // ROWS_PER_RANGE)) if like is None else like.per_folder
    folders = -(-count // per_folder)
    placed = _with_node(df.select(*columns), keys, listed).withColumn(_RANGE, F.floor(F.col(_NODE) / per_folder).cast("int"))
    own = [_NODE] if per_folder > 1 else []  # a folder of one range tells it by its name
    placed = placed.select(*columns, *own, _RANGE)
    # neighbouring folders share a task, so tasks follow the rows and not the ranges
    tasks = min(folders, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_RANGE)))
    task = F.floor(F.col(_RANGE).cast("long") * tasks / folders).cast("int")
    placed.withColumn("__task", task).repartitionById(tasks, "__task").drop("__task").sortWithinPartitions(_RANGE, *own, *keys).write.partitionBy(_RANGE).parquet(f"{path}/rows")
    digest = row_digest(columns)
    part = lambda i: F.sum(F.conv(F.substring("d", 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).cast("string")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    leaves = stored.select(F.col([*own, _RANGE][0]).alias("node"), digest.alias("d")).groupBy("node").agg(
        n_rows("row_count"), F.md5(F.concat_ws(":", part(0), part(1)).cast("binary")).alias("digest"))
    every = spark.range(count).select(F.col("id").cast("int").alias("node"))
    level = cut_lineage(every.join(leaves, "node", "left").select(
        F.lit(0).alias("level"), "node", F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("digest", F.lit("")).alias("digest")))
    whole, height = level, 0
    while FANOUT**height < count:
        height += 1
        # a parent has at most FANOUT children, in the order of their keys
        level = level.groupBy(F.floor(F.col("node") / FANOUT).cast("int").alias("node")).agg(
            F.sum("row_count").alias("row_count"), F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("c")).select(
            F.lit(height).alias("level"), "node", "row_count", F.md5(F.array_join(F.transform("c", lambda x: x["digest"]), ",").cast("binary")).alias("digest"))
        level = cut_lineage(level)
        whole = whole.unionByName(level)
    whole.write.partitionBy("level").parquet(f"{path}/digests")
    version = Version(path, tuple(keys), tuple(columns), cuts, height, placed.schema.json(), per_folder)
    described = spark.createDataFrame([(json.dumps(list(keys)), json.dumps(columns), cuts, height, version.schema, per_folder)],
                                      "keys string, columns string, cuts string, levels int, schema string, per_folder int")
    described.write.parquet(f"{path}/ranges")
    return version


def open_version(spark: SparkSession, path: str) -> Version:
    r = spark.read.parquet(f"{path}/ranges").first()
    return Version(path, tuple(json.loads(r["keys"])), tuple(json.loads(r["columns"])), r["cuts"], r["levels"], r["schema"], r.asDict().get("per_folder", 1))


def differing_ranges(spark: SparkSession, a: Version, b: Version) -> DataFrame:
    """(node, rows_a, rows_b) of the ranges whose digests differ; a level reads only children of differing nodes."""
    if (a.cuts, a.keys, a.columns) != (b.cuts, b.keys, b.columns):
        raise ValueError("the versions have different ranges; write one like the other")
    differing = None
    for level in range(a.levels, -1, -1):
        left, right = (v.digests(spark).filter(F.col("level") == level) for v in (a, b))
        if differing is not None:
            parent = differing.select(F.col("node").alias("parent"))
            left, right = (x.join(parent, F.floor(F.col("node") / FANOUT) == F.col("parent"), "left_semi") for x in (left, right))
        met = left.select("node", F.col("row_count").alias("rows_a"), "digest").join(
            right.select("node", F.col("row_count").alias("rows_b"), F.col("digest").alias("other")), "node")
        differing = cut_lineage(met.filter("digest <> other").select("node", "rows_a", "rows_b"))
        if differing.isEmpty():
            break
    return differing


def _only(version: Version, spark: SparkSession, ranges: DataFrame) -> DataFrame:
    """The rows of some ranges, read from their folders alone; rows of a folder are sorted by range, so the file is read in part."""
    listed = [r["node"] for r in ranges.select("node").limit(MAX_LISTED + 1).collect()]
    rows, own = version.rows(spark), _RANGE if version.per_folder == 1 else _NODE
    if len(listed) <= MAX_LISTED:
        folders = sorted({n // version.per_folder for n in listed})
        return rows.filter(F.col(_RANGE).isin(folders) & F.col(own).isin(listed))
    return rows.join(ranges.select(F.col("node").alias(own)), own, "left_semi")


def differences(spark: SparkSession, a: Version, b: Version) -> DataFrame:
    """The rows of either version that the other one lacks: all columns, `side` ('a' or 'b'), `copies`, and `change`:
    'added', 'removed', or 'changed' where both versions have rows of the key."""
    ranges = differing_ranges(spark, a, b)
    columns = list(a.columns)
    sides = [_only(v, spark, ranges).select(*columns, F.lit(sign).alias("__sign")) for v, sign in ((a, 1), (b, -1))]
    net = sides[0].unionByName(sides[1]).groupBy(*columns).agg(F.sum("__sign").alias("__net")).filter("__net <> 0")
    net = cut_lineage(net.withColumn("side", F.when(F.col("__net") > 0, "a").otherwise("b")))
    keys = list(a.keys)
    both = net.groupBy(*keys).agg((F.min("side") != F.max("side")).alias("__both"))
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
    met = net.alias("n").join(both.alias("k"), same)
    change = F.when(F.col("k.__both"), "changed").when(F.col("n.side") == "a", "removed").otherwise("added")
    return met.select(*[F.col(f"n.{c}").alias(c) for c in columns], "n.side", F.abs("n.__net").cast("long").alias("copies"), change.alias("change"))
