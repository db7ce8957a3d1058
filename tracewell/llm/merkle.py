"""Merkle manifest of a table: leaf digests, subtree and root digests, and inclusion proofs.

The nodes of a tree are ordered and cut into aligned blocks of ARITY ** DEPTH nodes. A block keeps each of its
levels as one string of hex digests, and the next level is hashed from fixed-width substrings of it, so
DEPTH levels cost no shuffle. What stands beside a node in its run are the flanking substrings; those of
all levels are the segments of its proof. The block's last node is a node of the next round, until a
tree has one block. The roots of all trees are the nodes of one more tree.

Order comes from one range exchange: sorted ranges are written with the place of each row in its range, and
the rows of earlier ranges are added, so a tree that holds most rows is spread like any other.

Nulls: a null value is hashed as `-`; a null tree key is a tree of its own and comes first, as do null ids
inside a tree. Repeated ids are ordered by their digests; equal rows are leaves beside each other. An
empty table has no rows and no root. Columns beyond the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.tables import measured_broadcast
from tracewell.llm.common import bucket_of_id, staged

ARITY = 3
DEPTH = 6  # levels inside a block: 729 nodes
WIDTH = 64  # characters of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def record_digest(fields: Sequence[Column]) -> Column:
    """Digest of the fields, each `-` if null, else its length in bytes, a colon and its text."""
    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return digest(F.concat(*[field(c) for c in fields]))


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, altered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """(id, tree, node, altered): the digest of each row, and of the row with `altered` columns where `when` holds.

    The first field is the id and the second one names the tree.
    """
    plain = {f: F.col(f"`{f}`") for f in fields}
    other = record_digest([(altered or {}).get(f, plain[f]) for f in fields])
    return docs.select(
        plain[fields[0]].alias("id"), F.coalesce(F.concat(F.lit("s"), plain[fields[1]].cast("string")), F.lit("-")).alias("tree"),
        record_digest(list(plain.values())).alias("node"), (F.when(when, other) if when is not None else F.lit(None).cast("string")).alias("altered"))


def _placed(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """The nodes with their place in their tree and the size of the tree."""
    ranges = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["tree", *order]
    # sorted ranges number their own rows; written, so that later reads see the same ranges
    ranged = staged(nodes.repartitionByRange(ranges, *key).sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("at", 33)
    totals = ranged.groupBy(part.alias("part"), "tree").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # at most one row for each tree and one for each range; a tree has a row for each of its ranges
    whole = Window.partitionBy("tree")
    starts = measured_broadcast(totals.select(
        "part", F.col("tree").alias("of"), "first", F.sum("n").over(whole).alias("size"),
        F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    placed = ranged.withColumn("in_part", part).join(starts, (F.col("in_part") == F.col("part")) & (F.col("tree") == F.col("of")))
    return placed.select(*nodes.columns, (F.col("at") - F.col("first") + F.col("before")).alias("place"), "size")


def _height(size: Column) -> Column:
    """Levels above the nodes of a tree: how often runs of ARITY must be hashed until one node is left."""
    powers = F.array(*[F.lit(ARITY**i) for i in range(40)])
    return F.size(F.filter(powers, lambda p: p < size))


def _upper(level: Column) -> Column:
    """The next level of a level, both as bytes of hex text."""
    runs = F.ceil(F.octet_length(level) / (ARITY * WIDTH)).cast("int")
    hashed = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.substring(level, i * (ARITY * WIDTH) + 1, F.lit(ARITY * WIDTH)), 256))
    return F.array_join(hashed, "").cast("binary")


def _blocks(placed: DataFrame, payload: Sequence[str]) -> DataFrame:
    """(tree, block, size, members, levels): a block's nodes in order, and its levels as strings of digests."""
    width = ARITY**DEPTH
    member = F.struct(F.pmod("place", F.lit(width)).cast("int").alias("i"), "node", *payload)
    grouped = placed.groupBy("tree", F.floor(F.col("place") / width).alias("block")).agg(
        F.first("size").alias("size"), F.array_sort(F.collect_list(member)).alias("members"))
    height = F.least(F.lit(DEPTH), _height(F.col("size")))
    first = F.array(F.array_join(F.transform("members", lambda m: m["node"]), "").cast("binary"))
    levels = F.when(F.col("height") == 0, first).otherwise(F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.col("height"), F.lit(1))), first,
        lambda levels, _: F.concat(levels, F.array(_upper(F.element_at(levels, -1))))))
    return grouped.withColumn("height", height).select("tree", "block", "size", "members", levels.alias("levels"))


def _segments(levels: Column, place: Column) -> Column:
    """What stands left and right of a node and of its ancestors in their runs, for all levels but the block's last."""
    def flanks(level: Column, up: Column) -> Column:
        own = F.floor(place / F.pow(F.lit(float(ARITY)), up)).cast("int")
        nth = F.pmod(own, F.lit(ARITY))
        begin = (own - nth) * WIDTH + 1
        return F.struct(F.substring(level, begin, nth * WIDTH).cast("string").alias("left"),
                        F.substring(level, (own + 1) * WIDTH + 1, (ARITY - 1 - nth) * WIDTH).cast("string").alias("right"))
    return F.transform(F.slice(levels, 1, F.size(levels) - 1), flanks)


@dataclass
class Forest:
    """`rows`: (tree, node, payload..., segments), `roots`: (tree, root)."""

    rows: DataFrame
    roots: DataFrame


def build(nodes: DataFrame, order: Sequence[str], payload: Sequence[str]) -> Forest:
    """Trees over the nodes (tree, node, ...) ordered by `order`; each row gets the segments up to its tree's root."""
    blocks = staged(_blocks(_placed(nodes, order), payload), "merkle-blocks")
    own = F.explode(F.transform("members", lambda m: F.struct(m.alias("m"), _segments(F.col("levels"), m["i"]).alias("s"))))
    top = F.element_at("levels", -1).cast("string")
    several = blocks.where(F.col("size") > ARITY**DEPTH).select("tree", top.alias("node"), "block")
    kept = ["tree", *[F.col(f"x.m.{c}").alias(c) for c in ("node", *payload)]]
    alone = blocks.where(F.col("size") <= ARITY**DEPTH)
    if several.isEmpty():
        return Forest(blocks.withColumn("x", own).select(*kept, F.col("x.s").alias("segments")), blocks.select("tree", top.alias("root")))
    above = build(several, ["block"], ["block"])
    upper = above.rows.select("tree", "block", F.col("segments").alias("up"))
    met = blocks.join(upper, ["tree", "block"], "left").withColumn("x", own)
    rows = met.select(*kept, F.concat("x.s", F.coalesce("up", F.array().cast(upper.schema["up"].dataType))).alias("segments"))
    return Forest(rows, alone.select("tree", top.alias("root")).unionByName(above.roots))


def manifest(leaf_rows: DataFrame) -> DataFrame:
    """(id, leaf, altered, subroot, root, segments) of the rows of `leaves`: the proof of each row up to the one root."""
    # written first: finding range bounds reads its input an extra time
    forest = build(staged(leaf_rows, "merkle-leaves"), ["id", "node"], ["id", "altered"])
    subroots = staged(forest.roots, "merkle-roots")
    # the trees are the nodes of one tree more, in the order of their keys
    over = build(subroots.select(F.lit("").alias("tree"), F.col("root").alias("node"), F.col("tree").alias("name")), ["name"], ["name"])
    tops = measured_broadcast(over.rows.select(F.col("name").alias("tree"), F.col("node").alias("subroot"), F.col("segments").alias("over")))
    found = over.roots.first()
    return forest.rows.join(tops, "tree").select(
        "id", F.col("node").alias("leaf"), "altered", "subroot", F.lit(found["root"] if found else None).cast("string").alias("root"),
        F.concat("segments", "over").alias("segments"))


def proof_text(segments: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.array_join(F.transform(segments, lambda s: F.concat(s["left"], s["right"])), "")


def fold(node: Column, segments: Column) -> Column:
    """The root that a node and its segments lead to."""
    return F.aggregate(segments, node, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def manifest_report(docs: DataFrame) -> DataFrame:
    """One row per document: its leaf, the roots above it, a digest of its proof, and the root that its proof gives
    for the document without line breaks, where crc32 of its id is even."""
    tampered = leaves(docs, altered={"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}, when=bucket_of_id(F.col("doc_id"), 2) == 0)
    rows = manifest(tampered).withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("segments")))
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", digest(proof_text(F.col("segments"))).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
