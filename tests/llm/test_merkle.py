import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.oracle import TESTDATA, compare
from tracewell.llm import merkle, queries, sql

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]


def _rows(n: int, sources, seed=3):
    rng = random.Random(seed)
    return [(i * 7 - 50, rng.choice(sources), rng.choice(["en", None]), rng.randrange(99), rng.choice(["a\nb", "plain", None, "", "\n", "é 日本"])) for i in range(n)]


def _report(spark, rows):
    found = merkle.manifest_report(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert all(r.verified == (r.folded_root == r.root) for r in found)
    return sorted((tuple(r[c] for c in COLUMNS) for r in found), key=repr)


@pytest.mark.parametrize("n", [1, 3, 4, 28])
def test_small_trees_equal_brute_force(spark, n):
    rows = _rows(n, ["only"])
    assert _report(spark, rows) == sorted(brute.merkle(rows), key=repr)


@pytest.mark.parametrize("depth", [1, 3])
def test_rounds_of_blocks_equal_brute_force(spark, monkeypatch, depth):
    """Blocks of 3, 9 and 27 nodes: trees of up to five rounds, one of which holds most rows."""
    monkeypatch.setattr(merkle, "DEPTH", depth)
    rows = _rows(230, ["hot"] * 12 + ["", None, "B", "a", "é", "z"])
    assert _report(spark, rows) == sorted(brute.merkle(rows), key=repr)


def test_a_full_block_and_one_node_more(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 2)
    for n in (9, 10, 82):
        rows = _rows(n, ["s"])
        assert _report(spark, rows) == sorted(brute.merkle(rows), key=repr)


def test_many_trees(spark, monkeypatch):
    """More trees than a block holds nodes: the tree over the subroots has rounds of its own."""
    monkeypatch.setattr(merkle, "DEPTH", 2)
    rows = _rows(60, [f"source {i:03d}" for i in range(40)])
    assert _report(spark, rows) == sorted(brute.merkle(rows), key=repr)


def test_repeated_rows_null_ids_and_other_columns(spark, edge_docs, no_docs):
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    clash = edge_docs.withColumns({c: F.lit("x") for c in ("id", "tree", "node", "altered", "place", "size", "at", "levels", "segments", "root")})
    rows = [tuple(r[c] for c in names) for r in edge_docs.collect()]
    found = sorted((tuple(r[c] for c in COLUMNS) for r in merkle.manifest_report(clash).collect()), key=repr)
    assert found == sorted(brute.merkle(rows), key=repr) and len(found) == len(rows)
    assert merkle.manifest_report(no_docs).collect() == []


def test_only_changed_texts_fail(spark):
    rows = _rows(100, ["a", "b"])
    text = {r[0]: r[4] for r in rows}
    for r in merkle.manifest_report(spark.createDataFrame(rows, SCHEMA)).collect():
        changed = brute.zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (text[r.doc_id] or "")
        assert r.verified == (not changed)


def test_general_fields_and_proofs(spark):
    """Any columns, the first as the id and the second as the tree; the proof itself leads to the root."""
    rows = spark.range(50).selectExpr("id AS key", "CAST(id % 3 AS INT) AS shard", "id * id AS square")
    found = merkle.manifest(merkle.leaves(rows, ("key", "shard", "square")))
    good = found.withColumn("folded", merkle.fold(F.col("leaf"), F.col("segments")))
    assert good.where("folded = root").count() == 50 and good.select("root").distinct().count() == 1


def test_equal_to_sql(spark):
    assert compare(spark, "op12", queries.op12_merkle_manifest, sql.MERKLE, f"{TESTDATA}/sf0.001") == ""


def test_plan_has_no_unbounded_group(spark):
    """One range exchange and one exchange by block; nothing is grouped or joined by tree alone."""
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    rows = merkle.leaves(docs).select("tree", "node", "id")
    plan = merkle._blocks(merkle._placed(rows, ["id", "node"]), ["id"])._jdf.queryExecution().executedPlan().toString()
    dealt = [re.findall(r"(\w+)#", keys) for keys in re.findall(r"hashpartitioning\(([^)]*)\)", plan)]
    assert dealt == [["tree", "_groupingexpression"]]
    assert "SinglePartition" not in plan
