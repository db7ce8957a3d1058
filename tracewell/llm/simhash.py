"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank, where neighbours differ in few bits. Runs of sorted
fingerprints become nodes that hold the bits all their members share; runs of nodes become upper nodes.
Two nodes whose shared bits differ in more than `radius` places hold no link and are pruned with all
below them; the differences add up on the way down.

The top nodes are masked patterns as well: 64 bits in radius + 1 blocks, so that two linked fingerprints
agree on one block, and each fingerprint enters the node of each of its blocks. A node with more than
`max_node` members is split again by blocks of its open bits, as often as needed, so no task holds
an unbounded node and no link is lost. Inside a node linked members are joined to one representative
each, so what leaves a task is linear in its members. Links are merged to components by contraction.

Nulls: a null text has no words, hence fingerprint zero; null ids take part in links but never name a
component, unless all ids of a component are null. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import small_batches, staged, text_of

SHINGLE_WORDS = 3
RADIUS = 3
MAX_NODE = 20_000
FANOUT = 8
_PAIRS = 1 << 18  # node pairs looked at together


# ---- fingerprints ----

def fingerprint(data: bytes, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """Bits set in over half of the shingle hashes, as a signed 64-bit number."""
    from itertools import repeat

    import xxhash

    words = data.lower().split()  # of bytes: A-Z only, and white space is U+0020 and U+0009 to U+000D
    if not words:
        return 0
    k = words_per_shingle
    counts, n = np.zeros(64, np.int64), max(1, len(words) - k + 1)
    for at in range(0, n, 65536):
        part = words[at : at + 65536 + k - 1]
        grams = map(b" ".join, zip(*[part[i:] for i in range(k)])) if len(words) >= k else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, row, fp): the fingerprint of every row; `row` is a hash of its text."""
    small_batches(docs.sparkSession)
    body = text_of(F.col(f"`{text}`"))

    def run(batches):
        for batch in batches:
            found = [fingerprint(t.as_py(), words_per_shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["doc_id", "row", "fp"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("row"), body.cast("binary").alias("t")).mapInArrow(
        run, f"doc_id {id_type}, row bigint, fp bigint")


# ---- top nodes: masked patterns ----

def _blocks(n_bits: int, parts: int) -> list[tuple[int, int]]:
    edges = [round(i * n_bits / parts) for i in range(parts + 1)]
    return list(zip(edges, edges[1:]))


def split_mask(mask: int, parts: int) -> list[int]:
    """The mask with one block of its open bits added, for each of `parts` blocks; [] if none are open."""
    open_bits = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in open_bits[lo:hi]) for lo, hi in _blocks(len(open_bits), parts)] if open_bits else []


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(fp: Column) -> Column:
    """Place of the fingerprint in the reflected Gray order, ordered as a signed number."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(2**63)))


def _nodes(fps: DataFrame, masks: list[int]) -> DataFrame:
    """Each fingerprint in the node of each mask."""
    masks_col = F.explode(F.array(*[F.lit(_signed(m)) for m in masks]))
    return fps.select("fp", masks_col.alias("mask")).withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))


def top_nodes(fps: DataFrame, radius: int = RADIUS, max_node: int = MAX_NODE) -> DataFrame:
    """(fp, mask, pattern): nodes of at most `max_node` members that together hold every linked pair."""
    level, done = _nodes(fps, split_mask(0, radius + 1)), []
    while True:
        large = level.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where(F.col("n") > max_node)
        masks = [r["mask"] for r in large.select("mask").distinct().collect()]  # a few per depth
        finer = {m: split_mask(m % (1 << 64), radius + 1) for m in masks}
        finer = {m: parts for m, parts in finer.items() if parts}
        if not finer:
            return reduce(DataFrame.unionByName, [*done, level])
        large = large.where(F.col("mask").isin(list(finer))).select("mask", "pattern")
        done.append(level.join(large, ["mask", "pattern"], "left_anti"))
        inside = level.join(large, ["mask", "pattern"], "left_semi")
        parts = reduce(lambda acc, m: acc.when(F.col("mask") == m, F.array(*[F.lit(_signed(p)) for p in finer[m]])), finer, F)
        level = staged(
            inside.select("fp", F.explode(parts).alias("mask")).distinct()
            .withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask"))), "fingerprint-nodes")


# ---- the index below a top node ----

def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after joining a[i] with b[i]; the smaller place becomes the root."""
    while len(a):
        a, b = parent[a], parent[b]
        differ = a != b
        a, b = a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        parent = _roots(parent)
    return parent


class GrayIndex:
    """Nodes over fingerprints sorted by top node and Gray rank, level by level.

    `starts[l]` are the places where nodes of level l begin; a node holds FANOUT nodes of the level
    below and never crosses a top node. `fixed[l]` are the bits its members share, `value[l]` one member.
    """

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        self.fp = fp
        first = np.concatenate([[True], group[1:] != group[:-1]]) if len(fp) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        self.sizes = np.diff(np.concatenate([at, [len(fp)]]))
        place = np.arange(len(fp)) - np.repeat(at, self.sizes)
        self.group_starts = at
        self.starts, self.fixed, self.value, self.child = [np.arange(len(fp))], [np.full(len(fp), ~np.uint64(0))], [fp], []
        step = 1
        while len(self.starts[-1]) > len(at):
            step *= FANOUT
            starts = np.flatnonzero(place % step == 0)
            child = np.searchsorted(self.starts[-1], np.concatenate([starts, [len(fp)]]))
            ones = np.bitwise_and.reduceat(fp, starts)
            zeros = np.bitwise_or.reduceat(fp, starts)
            self.starts.append(starts)
            self.fixed.append(~(ones ^ zeros))
            self.value.append(fp[starts])
            self.child.append(child)

    def components(self, radius: int) -> np.ndarray:
        """For every member the place of its component's representative."""
        parent = np.arange(len(self.fp))
        if not len(parent):
            return parent
        ends = [np.concatenate([s[1:], [len(parent)]]) for s in self.starts]
        solid = [np.bitwise_count(~f) <= radius for f in self.fixed]
        for level in range(1, len(self.starts)):  # members of a node with few open bits are all linked
            rows = np.flatnonzero(solid[level])
            n = ends[level][rows] - self.starts[level][rows]
            members = np.repeat(self.starts[level][rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            parent = _union(parent, members, np.repeat(self.starts[level][rows], n))
        # each top node is compared with itself at the lowest level that has it as one node
        root_level = np.ceil(np.log(np.maximum(self.sizes, 1)) / np.log(FANOUT) - 1e-9).astype(int)
        stack = []
        for level in range(1, len(self.starts)):
            own = np.searchsorted(self.starts[level], self.group_starts[root_level == level])
            stack += [(level, own[i : i + _PAIRS // 64], own[i : i + _PAIRS // 64]) for i in range(0, len(own), _PAIRS // 64)]
        while stack:
            level, a, b = stack.pop()
            a, b, parent = self._visit(level, a, b, parent, solid, ends, radius)
            if len(a):
                step = _PAIRS // FANOUT**2
                a, b = self._children(level, a, b)
                stack += [(level - 1, a[i : i + step], b[i : i + step]) for i in range(0, len(a), step)]
        return _roots(parent)

    def _visit(self, level, a, b, parent, solid, ends, radius):
        """Prune or settle pairs of nodes; what is left has to be compared below."""
        value, fixed = self.value[level], self.fixed[level]
        unlike = np.bitwise_count((value[a] ^ value[b]) & fixed[a] & fixed[b])
        near = unlike <= radius
        a, b, unlike = a[near], b[near], unlike[near]
        open_bits = np.bitwise_count(~(fixed[a] & fixed[b]))
        starts = self.starts[level]
        linked = (unlike + open_bits <= radius) & solid[level][a] & solid[level][b]
        parent = _union(parent, starts[a[linked]], starts[b[linked]])
        rest = ~linked & ~((a == b) & solid[level][a])
        a, b = a[rest], b[rest]
        if level and len(a) > 64:  # pairs already in one component need no look
            low = np.minimum.reduceat(parent, starts)
            high = np.maximum.reduceat(parent, starts)
            rest = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            a, b = a[rest], b[rest]
        return (a, b, parent) if level else (a[:0], b[:0], parent)

    def _children(self, level, a, b):
        child = self.child[level - 1]
        i, j = np.meshgrid(np.arange(FANOUT), np.arange(FANOUT), indexing="ij")
        x, y = child[a][:, None] + i.ravel(), child[b][:, None] + j.ravel()
        good = (x < child[a + 1][:, None]) & (y < child[b + 1][:, None]) & ((a != b)[:, None] | (x <= y))
        return x[good], y[good]


def node_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a > b: for each top node a star over every component found inside it."""
    def run(batches):
        held: list[np.ndarray] = []

        def search(rows: np.ndarray):
            fp, mask, pattern = rows
            change = np.concatenate([[0], np.cumsum((np.diff(mask) != 0) | (np.diff(pattern) != 0))]) if len(fp) else fp
            root = fp[GrayIndex(fp.astype(np.int64).view(np.uint64), change).components(radius)]
            linked = fp != root
            a, b = fp[linked], root[linked]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        size = 0
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("fp", "mask", "pattern")]))
            size += batch.num_rows
            if size >= 50_000:  # search all nodes that are complete, keep the last one
                rows = np.concatenate(held, axis=1)
                last = np.flatnonzero((rows[1] != rows[1, -1]) | (rows[2] != rows[2, -1]))
                cut = last[-1] + 1 if len(last) else 0
                if cut:
                    yield search(rows[:, :cut])
                held, size = [rows[:, cut:]], rows.shape[1] - cut
        if held:
            yield search(np.concatenate(held, axis=1))

    ordered = nodes.withColumn("rank", gray_rank(F.col("fp"))).repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", "rank")
    return ordered.select("fp", "mask", "pattern").mapInArrow(run, "a bigint, b bigint")


# ---- components ----

def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the links, by contraction.

    Each round every vertex points to its smallest neighbour, pointers are followed twice, and links
    are renamed; vertices vanish at least as fast as local minima allow. Rounds are written out.
    """
    links = staged(links.distinct(), "links")
    names = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.least("a", F.min("b")).alias("p"))
        again = to.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        to = staged(to.join(again, "p").select(F.col("a").alias("v"), F.col("pp").alias("p")), "pointers")
        if names is None:
            names = to.select("v", F.col("p").alias("root"))
        else:
            up = to.select(F.col("v").alias("root"), "p")
            names = staged(names.join(up, "root", "left").select("v", F.coalesce("p", "root").alias("root")), "names")
        renamed = links.join(to.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(
            to.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        links = staged(
            renamed.where("pa <> pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct(), "links")
    return names if names is not None else links.select(F.col("a").alias("v"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS,
                    words_per_shingle: int = SHINGLE_WORDS, max_node: int = MAX_NODE) -> DataFrame:
    """(doc_id, row, fp, component_id) for every row; component_id is the smallest id that links reach."""
    marked = staged(fingerprints(docs, doc_id, text, words_per_shingle), "fingerprints")
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    named = components(node_links(top_nodes(distinct, radius, max_node), radius))
    per_fp = distinct.join(named.select(F.col("v").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    per_root = per_fp.groupBy("root").agg(F.min("least_id").alias("component_id"))
    per_fp = per_fp.join(per_root, "root").select("fp", "component_id")
    return marked.join(per_fp, "fp").select("doc_id", "row", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", find=near_duplicates, **how) -> DataFrame:
    """The rows whose id is the smallest of their component; rows equal in id and text count once. All columns stay."""
    groups = find(docs.select(doc_id, text), doc_id, text, **how)
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id"), F.col("row").alias("stay")).distinct()
    # the given row as one value: its names stay apart from those used here
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{doc_id}`").alias("given"), F.xxhash64(text_of(F.col(f"`{text}`"))).alias("row"))
    kept = marked.join(staged(stay, "representatives"), F.col("given").eqNullSafe(F.col("id")) & (F.col("row") == F.col("stay")), "left_semi")
    return kept.dropDuplicates(["given", "row"]).select("doc.*")


def simhash_report(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
