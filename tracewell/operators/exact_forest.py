"""Classification forests grown to purity with exact splits: no bins and no depth limit.

A tree grows level by level. A row carries a tag for each tree whose node it stands in is still wide, that is
has more rows than a task should hold. The splits of all wide nodes of a level come from running sums over
the distinct values of each candidate feature, so one node may hold every row. A child that is small
enough goes to one task, which grows it to purity there; both ways choose the same splits.

The rules are those of the usual exact grower: Gini impurity, thresholds half way between neighbouring
distinct values, `candidates` features looked at in an order of the node's own, and beyond them on to the
first one that is not constant; a node ends where it is pure or all its features are constant. Ties go to
the earlier feature and the lower threshold. Bootstrap counts follow a Poisson distribution of mean
one, from a hash of seed, tree and case, as is usual where rows are spread over machines. All choices are hashes, so
a tree does not depend on how its rows are spread.

A node is named by a 64-bit hash of its parent's name and its side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.columns import n_rows, scalar
from tracewell.operators.contracts import ContractError
from tracewell.operators.order import ordered_cumsum
from tracewell.session import cut_lineage
from tracewell.spec import CASE

# Cells (rows times features) of a node that one task grows on its own.
LOCAL_CELLS = 40_000_000
# Wide nodes of a level: their splits pass through the driver. There are at most rows * trees / local rows of them.
MAX_WIDE_NODES = 1_000_000
# Nodes and rows that one task holds when rows are scored; a larger tree has a task of its own.
MAX_SENT_NODES = 1_000_000
ROWS_PER_BLOCK = 100_000
MAX_TASKS = 20_000
# A node's values are counted if it has at most so many possible ones a row, else sorted.
DENSE = 8
NODES = ("tree int, node long, depth int, cases long, positives long, feature int, threshold double, left long, right long")
_NODES = pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[f.split()[1]]) for f in NODES.split(", ")])


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text, seed=42)
    return h - (1 << 64) if h >> 63 else h


def root_of(seed: int, tree: int) -> int:
    return _hash(f"{seed}:{tree}")


def child_of(node: int, side: int) -> int:
    return _hash(f"{node}/{side}")


def feature_orders(nodes: Sequence[int], features: int) -> np.ndarray:
    """The order in which each node looks at the features, a row a node."""
    digest, numbers = xxhash.xxh64_intdigest, [str(f) for f in range(features)]
    hashes = np.fromiter((digest(name + f, 42) for name in (f"{int(n)}:" for n in nodes) for f in numbers), np.uint64, len(nodes) * features)
    return np.argsort(hashes.view(np.int64).reshape(len(nodes), features), axis=1, kind="stable")


def bootstrap_count(case: Column, tree: Column, seed: int) -> Column:
    """How often a case counts in a tree: Poisson of mean one by a uniform number from the md5 of seed, tree and case."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), tree.cast("string"), case.cast("string")))
    uniform = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)
    totals = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]).tolist()
    # the number is bound to a name, else every comparison would take its md5 anew
    return F.get(F.transform(F.array(uniform), lambda u: sum(((u >= t).cast("int") for t in totals), F.lit(0))), 0)


# --- one node in one task ----------------------------------------------------------------------

def _gain(left: np.ndarray, left_pos: np.ndarray, n: float, pos: float) -> np.ndarray:
    """What a split leaves of purity; larger is purer. The same products in the same order as `_purity`."""
    right, right_pos = n - left, pos - left_pos
    a, b = left - left_pos, right - right_pos
    return (left_pos * left_pos + a * a) / left + (right_pos * right_pos + b * b) / right


def _midpoint(low: float, high: float) -> float:
    middle = low / 2 + high / 2
    return low if middle >= high or not math.isfinite(middle) else middle


@dataclass
class _Ranked:
    """A table of rows with each value as its place among the distinct values of its feature: those of feature f start at first[f]."""

    ranks: np.ndarray
    values: np.ndarray
    first: np.ndarray
    distinct: np.ndarray

    @classmethod
    def of(cls, parts: Sequence[np.ndarray]) -> _Ranked:
        """Of the rows of all parts, rows x features."""
        width = parts[0].shape[1]
        ranks, values = np.empty((sum(map(len, parts)), width), np.int32), []
        for f in range(width):
            found, ranks[:, f] = np.unique(np.concatenate([p[:, f] for p in parts]), return_inverse=True)
            values.append(found)
        distinct = np.array([len(v) for v in values])
        return cls(ranks, np.concatenate(values), np.cumsum(distinct) - distinct, distinct)

    def value(self, feature: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return self.values[self.first[feature] + rank]


def _sums(at: np.ndarray, own: np.ndarray, w: np.ndarray, wy: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, ...]:
    """(node, rank, weight, positive weight) of each value that occurs in a node, in order. A node has `distinct` possible values."""
    base = np.cumsum(distinct) - distinct
    key = base[at] + own
    if distinct.sum() <= DENSE * len(at):
        n = np.bincount(key, w, int(distinct.sum()))
        met = np.flatnonzero(n)
        n, p = n[met], np.bincount(key, wy, int(distinct.sum()))[met]
    else:
        by = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(key[by]) > 0])
        met, n, p = key[by[first]], np.add.reduceat(w[by], first).astype(float), np.add.reduceat(wy[by], first).astype(float)
    node = np.searchsorted(base, met, "right") - 1
    return node, met - base[node], n, p


def _level_splits(at: np.ndarray, rows: np.ndarray, table: _Ranked, y: np.ndarray, w: np.ndarray, orders: np.ndarray, n: np.ndarray, pos: np.ndarray, candidates: int):
    """The splits of many nodes at once: (feature or -1, low, high) by node, -1 where all features are constant. `at` is the node of a row, `orders` a row a node."""
    nodes, width = orders.shape
    gains, feature = np.full(nodes, -np.inf), np.full(nodes, -1)
    low, high = np.zeros(nodes), np.zeros(nodes)
    wy = w * y
    for rank in range(width):
        if rank >= candidates:
            open_ = feature < 0
            if not open_.any():
                break
            keep = open_[at]
            at, rows, w, wy = at[keep], rows[keep], w[keep], wy[keep]
        looked = orders[:, rank]
        distinct = table.distinct[looked]
        # nodes with few rows for their values are sorted, the others counted
        counted = distinct <= DENSE * np.bincount(at, minlength=nodes)
        for some in (counted, ~counted):
            inside = some[at]
            if not inside.any():
                continue
            which, part = np.flatnonzero(some), rows[inside]
            slot = (np.cumsum(some) - 1)[at[inside]]
            own = table.ranks[part, looked[which][slot]]
            a, r, left, left_pos = _sums(slot, own, w[inside], wy[inside], distinct[which])
            a = which[a]
            last = np.flatnonzero(a[1:] == a[:-1])  # each distinct value but a node's greatest
            if not len(last):
                continue
            begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            of = a[last]
            sums = []
            for total in (np.cumsum(left), np.cumsum(left_pos)):
                before = np.zeros(nodes)
                before[a[begin]] = np.r_[0, total[begin[1:] - 1]]
                sums.append(total[last] - before[of])
            gain = _gain(*sums, n[of], pos[of])
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            most = np.maximum.reduceat(gain, first)
            place = np.where(gain == np.repeat(most, np.diff(np.r_[first, len(of)])), np.arange(len(of)), len(of))
            i, who = last[np.minimum.reduceat(place, first)], of[first]
            better = most > gains[who]
            i, who = i[better], who[better]
            f = looked[who]
            gains[who], feature[who], low[who], high[who] = most[better], f, table.value(f, r[i]), table.value(f, r[i + 1])
    return feature, low, high


def grow(
    tree: int, node: int, depth: int, x: np.ndarray | _Ranked, y: np.ndarray, w: np.ndarray, candidates: int, max_depth: int | None = None,
) -> Iterator[dict]:
    """The nodes below and including one, a level at a time, as columns of NODES; a leaf has feature -1. Rows of weight zero are not in it."""
    table = x if isinstance(x, _Ranked) else _Ranked.of([x])
    names, rows = np.array([node], np.int64), np.flatnonzero(w)
    at, width = np.zeros(len(rows), np.int64), len(table.distinct)
    while len(names):
        yr, wr = y[rows], w[rows]
        n, pos = np.bincount(at, wr, len(names)), np.bincount(at, wr * yr, len(names))
        feature, threshold = np.full(len(names), -1), np.full(len(names), np.nan)
        mixed = (pos > 0) & (pos < n) & (max_depth is None or depth < max_depth)
        if mixed.any():
            keep, slot = mixed[at], np.cumsum(mixed) - 1
            orders = feature_orders(names[mixed].tolist(), width)
            found, low, high = _level_splits(slot[at[keep]], rows[keep], table, yr[keep], wr[keep], orders, n[mixed], pos[mixed], candidates)
            middle = low / 2 + high / 2
            feature[mixed], threshold[mixed] = found, np.where((middle >= high) | ~np.isfinite(middle), low, middle)
        split = feature >= 0
        sides = [np.array([child_of(int(name), side) if s else 0 for name, s in zip(names, split)], np.int64) for side in (0, 1)]
        yield {"tree": tree, "node": names, "depth": depth, "cases": n.astype(np.int64), "positives": pos.astype(np.int64), "feature": feature,
               "threshold": np.where(split, threshold, np.nan), "left": sides[0], "right": sides[1]}
        keep, slot = split[at], np.cumsum(split) - 1
        rows, at = rows[keep], at[keep]
        f = feature[at]
        at = 2 * slot[at] + (table.value(f, table.ranks[rows, f]) > threshold[at])
        names, depth = np.stack(sides, axis=1)[split].ravel(), depth + 1


def _grown(*given) -> pd.DataFrame:
    """The nodes of `grow` as a table; what a leaf lacks is null."""
    out = pd.concat([pd.DataFrame(level) for level in grow(*given)])
    leaf = (out["feature"] < 0).to_numpy()
    for c in ("feature", "left", "right"):
        out[c] = pd.array(out[c], "Int64")
        out.loc[leaf, c] = pd.NA
    out["threshold"] = pd.arrays.FloatingArray(out["threshold"].to_numpy(float), leaf)
    return out


def _grow_group(candidates: int, max_depth: int | None):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        x, y, w = np.stack(pdf["x"].to_list()), pdf["y"].to_numpy(np.int64), pdf["w"].to_numpy(np.int64)
        name = int(first["tree"]), int(first["node"]), int(first["depth"])
        del pdf
        return _grown(*name, x, y, w, candidates, max_depth)

    return run


def _grow_whole(rows: DataFrame, roots: Sequence[tuple[int, int]], candidates: int, max_depth: int | None, tasks: int) -> DataFrame:
    """The nodes of whole trees, (tree, root) in `roots`, several in a task: the rows (x, y, counts by tree) go once to a task and not to each tree."""
    size = -(-len(roots) // tasks)
    chunks = [roots[i : i + size] for i in range(0, len(roots), size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        chunk = chunks[held[0].column(0)[0].as_py()]
        flat = lambda c: [b.column(c).flatten().to_numpy().reshape(b.num_rows, -1) for b in held]
        y = np.concatenate([b.column(2).to_numpy() for b in held]).astype(np.int64)
        counts, table = np.concatenate(flat(3)), _Ranked.of(flat(1))
        del held
        for i, (tree, root) in enumerate(chunk):
            nodes = _grown(tree, root, 0, table, y, counts[:, i].astype(np.int64), candidates, max_depth)
            yield pa.RecordBatch.from_pandas(nodes, _NODES, preserve_index=False)

    numbers = [F.array(*[F.get(F.col("counts"), F.lit(tree)) for tree, _ in chunk]) for chunk in chunks]
    dealt = F.explode(F.array(*[F.struct(F.lit(i).alias("chunk"), c.alias("counts")) for i, c in enumerate(numbers)])).alias("d")
    return rows.select("x", "y", dealt).select("d.chunk", "x", "y", "d.counts").repartitionById(len(chunks), "chunk").mapInArrow(run, NODES)


# --- wide nodes ------------------------------------------------------------------------------------

@dataclass
class _Wide:
    """A node whose rows are spread; its place in the level's list is the slot in the rows' tags."""

    tree: int
    node: int
    depth: int
    cases: int
    positives: int


def _purity() -> Column:
    left, left_pos, n, pos = (F.col(c).cast("double") for c in ("cum_n", "cum_p", "total_n", "total_p"))
    right, right_pos = n - left, pos - left_pos
    a, b = left - left_pos, right - right_pos
    return (left_pos * left_pos + a * a) / left + (right_pos * right_pos + b * b) / right


def _listed(spark: SparkSession, rows: list, schema: str) -> Column:
    """A list of the driver as one array value, in order; its length is bounded by MAX_WIDE_NODES."""
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"slot int, {schema}")
    return scalar(table, F.array_sort(F.collect_list(F.struct("*"))))


def _wide_splits(rows: DataFrame, looked_at: list[list[int]], first_only: bool) -> dict[int, tuple]:
    """slot -> (feature, low, high, cases, positives of the left side) for the slots with a list of features.

    `first_only`: the earliest feature that is not constant wins, instead of the purest split.
    """
    spark = rows.sparkSession
    if not any(looked_at):
        return {}
    lists = _listed(spark, [(c,) for c in looked_at], "features array<int>")
    tagged = rows.select("x", "y", F.explode("tags").alias("t")).filter("t.slot >= 0").select("x", "y", "t.slot", "t.w").withColumn("lists", lists)
    wanted = F.get(F.col("lists"), F.col("slot"))["features"]
    cells = tagged.select("slot", "y", "w", F.explode(F.transform(wanted, lambda f, rank: F.struct(rank.alias("rank"), f.alias("f"), (F.get(F.col("x"), f) + F.lit(0.0)).alias("v")))).alias("c"))
    merged = cut_lineage(cells.groupBy("slot", "c.rank", "c.f", "c.v").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("p")))
    cum = ordered_cumsum(merged, ["v"], {"n": F.col("n"), "p": F.col("p")}, ["slot", "rank", "f"])
    place = F.struct((-F.col("rank")).alias("r"), _purity().alias("g"), (-F.col("v")).alias("v")) if first_only else F.struct(
        _purity().alias("g"), (-F.col("rank")).alias("r"), (-F.col("v")).alias("v"))
    best = cum.filter("cum_n < total_n").groupBy("slot").agg(F.max_by(F.struct("rank", "f", "v", "cum_n", "cum_p"), place).alias("b")).select("slot", "b.*")
    best = F.broadcast(best.select("slot", "rank", "f", F.col("v").alias("low"), "cum_n", "cum_p"))  # one row a wide node
    found = merged.join(best, ["slot", "rank", "f"]).filter("v > low").groupBy("slot", "f", "low", "cum_n", "cum_p").agg(F.min("v").alias("high"))
    return {r["slot"]: (r["f"], r["low"], r["high"], r["cum_n"], r["cum_p"]) for r in found.collect()}


@dataclass
class ExactForest:
    """`nodes`: one row a node as in NODES; leaves have no feature. The nodes stay in a table and never pass through the driver."""

    nodes: DataFrame
    trees: int
    features: int

    def leaves(self) -> DataFrame:
        return self.nodes.filter("feature is null")

    @cached_property
    def packed(self) -> DataFrame:
        """A row a tree with its nodes as arrays; written once."""
        return cut_lineage(packed_trees(self))

    @cached_property
    def sizes(self) -> list[tuple[int, int]]:
        """(tree, nodes), a row a tree."""
        return [(r["tree"], r["size"]) for r in self.packed.select("tree", "size").orderBy("tree").collect()]

    def save(self, path: str) -> None:
        self.nodes.write.parquet(f"{path}/nodes")
        self.nodes.sparkSession.createDataFrame([(self.trees, self.features)], "trees int, features int").write.parquet(f"{path}/forest")

    @classmethod
    def load(cls, path: str) -> ExactForest:
        spark = SparkSession.active()
        r = spark.read.parquet(f"{path}/forest").first()
        return cls(spark.read.schema(NODES).parquet(f"{path}/nodes"), r["trees"], r["features"])


def fit_exact_forest(
    train: DataFrame, trees: int = 300, candidates: int | None = None, seed: int = 42, bootstrap: bool = True,
    local_rows: int | None = None, target: str = "target", max_depth: int | None = None, bins: int | None = None,
) -> ExactForest:
    """A forest over `train` (case_id, a binary target, a `features` vector). `candidates` is the number of features
    looked at for a split, the square root of all by default; `local_rows` the rows of a node that one task may grow.
    `bins` allows only thresholds between so many ranges of each feature, `max_depth` ends trees there."""
    spark = train.sparkSession
    features = train.schema["features"].metadata.get("ml_attr", {}).get("num_attrs") or len(train.first()["features"])
    cuts = _bin_cuts(train, features, bins) if bins else None
    candidates = candidates or max(1, math.isqrt(features))
    local_rows = local_rows or max(1, LOCAL_CELLS // features)
    drawn = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: bootstrap_count(F.col(CASE), t, seed) if bootstrap else F.lit(1))
    vector = vector_to_array("features") if cuts is None else _binned(vector_to_array("features"), F.col("cuts"))
    given = train if cuts is None else train.withColumn("cuts", _listed(spark, [(c,) for c in cuts], "values array<double>"))
    rows = cut_lineage(given.select(vector.alias("x"), F.col(target).cast("int").alias("y"), drawn.alias("counts")))
    sums = {r["tree"]: r for r in rows.select("y", F.posexplode("counts").alias("tree", "w")).filter("w > 0").groupBy("tree").agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("p")).collect()}
    level = [_Wide(t, root_of(seed, t), 0, sums[t]["n"] if t in sums else 0, sums[t]["p"] if t in sums else 0) for t in range(trees)]
    # the first step sorts the roots into wide ones, small ones and leaves
    done: list[tuple] = []
    plan, level = _dispatch(level, local_rows, done, max_depth)
    # a number of its own: small rows are much work, so tasks are not merged by their bytes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    whole = [(tree, node) for tree, (slot, node, _) in enumerate(plan) if slot == -1] if not level else []
    if level:
        tags = F.filter(F.transform("counts", lambda w, t: F.struct(
            t.alias("slot"), t.alias("tree"), F.lit(None).cast("long").alias("node"), F.lit(0).alias("depth"), w.alias("w"))), lambda t: t["w"] > 0)
        rows = _moved(rows.select("x", "y", tags.alias("tags")), [(None, None, p, p) for p in plan])
    wide = bool(level)
    while level:
        if len(level) > MAX_WIDE_NODES:
            raise ContractError(f"{len(level)} wide nodes in a level, more than {MAX_WIDE_NODES}; raise local_rows")
        orders = feature_orders([w.node for w in level], features).tolist()
        splits = _wide_splits(rows, [o[:candidates] for o in orders], False)
        rest = [[] if i in splits else o[candidates:] for i, o in enumerate(orders)]
        splits |= _wide_splits(rows, rest, True)
        children, moves = [], []
        for i, w in enumerate(level):
            if i not in splits:
                done.append((w.tree, w.node, w.depth, w.cases, w.positives, None, None, None, None))
                moves.append((None, None, -2, -2))
                continue
            f, low, high, n, p = splits[i]
            threshold = _midpoint(low, high)
            left, right = child_of(w.node, 0), child_of(w.node, 1)
            done.append((w.tree, w.node, w.depth, w.cases, w.positives, f, threshold, left, right))
            moves.append((f, threshold, len(children), len(children) + 1))
            children += [_Wide(w.tree, left, w.depth + 1, n, p), _Wide(w.tree, right, w.depth + 1, w.cases - n, w.positives - p)]
        plan, level = _dispatch(children, local_rows, done, max_depth)
        ended = (-2, None, 0)
        rows = _moved(rows, [(f, t, plan[a] if a >= 0 else ended, plan[b] if b >= 0 else ended) for f, t, a, b in moves])
    nodes = spark.createDataFrame(done, NODES)
    if wide:
        small = rows.select("x", "y", F.explode("tags").alias("t")).select("x", "y", "t.tree", "t.node", "t.depth", "t.w")
        nodes = nodes.unionByName(small.repartition(tasks, "tree", "node").groupBy("tree", "node").applyInPandas(_grow_group(candidates, max_depth), NODES))
    elif whole:
        nodes = nodes.unionByName(_grow_whole(rows, whole, candidates, max_depth, tasks))
    if cuts is not None:  # a threshold between two bins is the cut above the lower one
        table = _listed(spark, [(c,) for c in cuts], "values array<double>")
        cut = F.get(F.get(F.col("cuts"), F.col("feature"))["values"], F.floor("threshold").cast("int"))
        nodes = nodes.withColumn("cuts", table).withColumn("threshold", cut).drop("cuts")
    return ExactForest(cut_lineage(nodes), trees, features)


def _bin_cuts(train: DataFrame, features: int, bins: int) -> list[list[float]]:
    """The thresholds of each feature: half way between its values where it has at most `bins`, else quantiles."""
    cells = train.select(F.posexplode(vector_to_array("features")).alias("f", "v")).groupBy("f", "v").agg(n_rows())
    cells = cut_lineage(cells)
    counts = cells.groupBy("f").agg(n_rows("values"))
    small = cells.join(counts.filter(F.col("values") <= bins), "f").groupBy("f").agg(F.array_sort(F.collect_list("v")).alias("v"))
    steps = [k / bins for k in range(1, bins)]
    large = cells.join(counts.filter(F.col("values") > bins), "f").groupBy("f").agg(
        F.percentile_approx("v", steps, 100 * bins).alias("v"), F.max("v").alias("top"))
    cuts: list[list[float]] = [[] for _ in range(features)]
    for r in small.collect():
        cuts[r["f"]] = [_midpoint(a, b) for a, b in zip(r["v"], r["v"][1:])]
    for r in large.collect():
        cuts[r["f"]] = sorted({v for v in r["v"] if v < r["top"]})
    return cuts


def _binned(x: Column, cuts: Column) -> Column:
    """Of each value the number of cuts below it."""
    return F.transform(x, lambda v, f: F.size(F.filter(F.get(cuts, f)["values"], lambda c: c < v)).cast("double"))


def _dispatch(nodes: list[_Wide], local_rows: int, done: list[tuple], max_depth: int | None) -> tuple[list[tuple], list[_Wide]]:
    """For each node the (slot, name, depth) that its rows' tags get, and the wide nodes in the order of their slots:
    slot -1 is a node for one task, -2 a leaf, which needs no rows any more."""
    plan, wide = [], []
    for w in nodes:
        if w.positives in (0, w.cases) or w.depth == max_depth:
            done.append((w.tree, w.node, w.depth, w.cases, w.positives, None, None, None, None))
            plan.append((-2, None, 0))
        elif w.cases <= local_rows:
            plan.append((-1, w.node, w.depth))
        else:
            plan.append((len(wide), w.node, w.depth))
            wide.append(w)
    return plan, wide


def _moved(rows: DataFrame, moves: list[tuple]) -> DataFrame:
    """The rows with their tags moved to the side of each split; moves are (feature, threshold, left, right) by slot."""
    side = "struct<slot:int,node:bigint,depth:int>"
    # the scalar value has one entry a wide node
    table = _listed(rows.sparkSession, moves, f"feature int, threshold double, left {side}, right {side}")

    def step(t: Column) -> Column:
        m = F.get(F.col("moves"), t["slot"])
        to = F.when(m["feature"].isNull() | (F.get(F.col("x"), m["feature"]) <= m["threshold"]), m["left"]).otherwise(m["right"])
        return F.when(t["slot"] < 0, t).otherwise(F.struct(
            to["slot"].alias("slot"), t["tree"].alias("tree"), to["node"].alias("node"), to["depth"].alias("depth"), t["w"].alias("w")))

    moved = rows.withColumn("moves", table).withColumn("tags", F.filter(F.transform("tags", step), lambda t: t["slot"] > -2))
    return cut_lineage(moved.filter(F.size("tags") > 0).select("x", "y", "tags"))


# --- scoring ------------------------------------------------------------------------------------------

@dataclass
class _Arrays:
    """Some trees in flat arrays; a leaf points to itself."""

    roots: np.ndarray
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def votes(self, x: np.ndarray) -> np.ndarray:
        """The sum over trees of the positive share of the leaf that each row reaches."""
        out, every = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            active = every
            while len(active):
                here = at[active]
                inner = self.feature[here] >= 0
                active, here = active[inner], here[inner]
                goes_left = x[active, self.feature[here]] <= self.threshold[here]
                at[active] = np.where(goes_left, self.left[here], self.right[here])
            out += self.value[at]
        return out


def _pack(features: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One tree's nodes as packed arrays, its root first, and what its splits take off impurity by feature."""
        pdf = pdf.sort_values(["depth", "node"])
        names, inner = pdf["node"].to_numpy(np.int64), pdf["feature"].to_numpy(np.int64) >= 0
        by = np.argsort(names)
        left, right = (np.where(inner, by[np.minimum(np.searchsorted(names, pdf[c].to_numpy(np.int64), sorter=by), len(by) - 1)], -1) for c in ("left", "right"))
        n, p = pdf["cases"].to_numpy(float), pdf["positives"].to_numpy(float)
        share = p / np.maximum(n, 1)
        impurity = 2 * p * (n - p) / np.maximum(n, 1)  # cases times Gini impurity
        drop = impurity[inner] - impurity[left[inner]] - impurity[right[inner]]
        drops = np.bincount(pdf["feature"].to_numpy(np.int64)[inner], drop, features)
        packed = [left.astype("<i4"), right.astype("<i4"), pdf["feature"].to_numpy("<i4"), pdf["threshold"].to_numpy("<f8"), np.stack([1 - share, share], axis=1).astype("<f8")]
        return pd.DataFrame({"tree": [int(pdf["tree"].iloc[0])], "size": [len(names)], **{c: [v.tobytes()] for c, v in zip("abcde", packed)}, "drops": [drops]})

    return run


def packed_trees(forest: ExactForest) -> DataFrame:
    """(tree, size, left, right, feature, threshold, probabilities as bytes a to e, drops): a row a tree, packed by executors."""
    nodes = forest.nodes.select(
        "tree", "node", "depth", "cases", "positives", F.coalesce("feature", F.lit(-1)).alias("feature"), F.coalesce("threshold", F.lit(0.0)).alias("threshold"),
        F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.lit(0)).alias("right"))  # a null would turn names into floats
    return nodes.groupBy("tree").applyInPandas(_pack(forest.features), "tree int, size long, a binary, b binary, c binary, d binary, e binary, drops array<double>")


def _arrays(packed: pd.DataFrame) -> _Arrays:
    """The trees of some rows of `packed_trees`, in the order of their numbers."""
    packed = packed.sort_values("tree")
    left, right, feature, threshold, value = (
        np.frombuffer(b"".join(packed[c]), kind) for c, kind in zip("abcde", ("<i4", "<i4", "<i4", "<f8", "<f8")))
    size = packed["size"].to_numpy(np.int64)
    roots = np.cumsum(size) - size
    start, every = np.repeat(roots, size), np.arange(len(left))
    left, right = (np.where(feature >= 0, start + side, every) for side in (left, right))
    return _Arrays(roots, left, right, feature.astype(np.int64), threshold, value.reshape(-1, 2)[:, 1])


def tree_chunks(forest: ExactForest, least: int = 1) -> list[list[int]]:
    """Trees that one task holds together: at most MAX_SENT_NODES nodes, or one tree; about `least` of them or more."""
    limit = min(MAX_SENT_NODES, -(-sum(n for _, n in forest.sizes) // least))
    chunks, size = [[]], 0
    for tree, n in forest.sizes:
        if chunks[-1] and size + n > limit:
            chunks.append([])
            size = 0
        chunks[-1].append(tree)
        size += n
    return chunks


def by_chunks(forest: ExactForest, rows: DataFrame, chunks: list[list[int]], rows_per_block: int, run, schema: str) -> DataFrame:
    """`run(chunk, rows, packed trees)` for every block of rows with every chunk of trees, each in a task: neither the forest
    nor the rows are in one place. `rows` has CASE."""
    blocks = max(1, -(-rows.count() // rows_per_block))
    numbers = [c for c, trees in enumerate(chunks) for _ in trees]
    chunk = F.get(F.array(*[F.lit(c) for c in numbers]), F.col("__place"))
    place = F.array_position(F.array(*[F.lit(t) for trees in chunks for t in trees]), F.col("tree")) - 1
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    slots = blocks * len(chunks)
    slot = (F.col("__block") * len(chunks) + F.col("__chunk")).cast("int").alias("__slot")
    packed = forest.packed.drop("drops").withColumn("__place", place.cast("int")).withColumn("__chunk", chunk).withColumn("__block", F.explode(every))
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64(CASE), F.lit(blocks))).withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(len(chunks) - 1))))
    tasks = min(2 * slots, MAX_TASKS)
    left = dealt.select(*rows.columns, slot).repartition(tasks, "__slot").groupBy("__slot")
    right = packed.select("tree", "size", *"abcde", slot).repartition(tasks, "__slot").groupBy("__slot")
    count = len(chunks)

    def task(key: tuple, some: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        return run(int(key[0]) % count, some.drop(columns="__slot"), trees)

    return left.cogroup(right).applyInPandas(task, schema)


def predict_exact(forest: ExactForest, data: DataFrame, target: str = "target") -> DataFrame:
    """case_id, y_true, y_pred, y_prob: the mean over trees of the leaf's positive share; exactly 0.5 is class 0."""
    rows = data.select(CASE, F.col(target).cast("int").alias("y_true"), vector_to_array("features").alias("x"))
    schema = f"{CASE} {dict(data.dtypes)[CASE]}, y_true int, chunk int, votes double"

    def score(chunk: int, some: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        votes = _arrays(trees).votes(np.stack(some["x"].to_list())) if len(some) else np.zeros(0)
        return some[[CASE]].assign(y_true=some["y_true"].astype("Int32"), chunk=np.int32(chunk), votes=votes)

    scored = by_chunks(forest, rows, tree_chunks(forest), ROWS_PER_BLOCK, score, schema)
    # in the order of the chunks, so that the sum is the same in every run
    parts = F.array_sort(F.collect_list(F.struct("chunk", "votes")))
    summed = scored.groupBy(CASE, "y_true").agg(F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p["votes"]).alias("votes"))
    probability = F.col("votes") / forest.trees
    return summed.select(CASE, "y_true", probability.alias("y_prob")).withColumn("y_pred", (F.col("y_prob") > 0.5).cast("int"))


# --- what can be read off a forest -----------------------------------------------------------------------

def exact_structure(forest: ExactForest) -> DataFrame:
    """Depth and leaf count over the trees."""
    trees = forest.nodes.groupBy("tree").agg(F.max("depth").alias("depth"), F.count(F.when(F.col("feature").isNull(), 1)).alias("leaves"))
    return trees.agg(n_rows("trees"), *[f(c).alias(f"{c}_{n}") for c in ("depth", "leaves") for n, f in
                                        (("min", F.min), ("mean", F.avg), ("max", F.max))])


def exact_importance(forest: ExactForest, dictionary: DataFrame) -> DataFrame:
    """Impurity decrease per feature: shares of each tree, their mean over the trees, scaled to add up to one."""
    drops = forest.packed.select("tree", F.aggregate("drops", F.lit(0.0), lambda acc, d: acc + d).alias("t"), F.posexplode("drops").alias("feature_index", "d"))
    # in the order of the trees, so that the sum is the same in every run
    shares = F.array_sort(F.collect_list(F.struct("tree", (F.col("d") / F.col("t")).alias("share"))))
    means = cut_lineage(drops.filter("t > 0").groupBy(F.col("feature_index").cast("long").alias("feature_index")).agg(
        F.aggregate(shares, F.lit(0.0), lambda acc, s: acc + s["share"]).alias("m")))
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("feature_index", "m"))), F.lit(0.0), lambda acc, s: acc + s["m"])
    out = dictionary.join(means, "feature_index", "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    return out.withColumn("importance", F.coalesce(F.try_divide(F.col("m"), scalar(means, whole)), F.lit(0.0))).drop("m")


def exact_checks(forest: ExactForest) -> DataFrame:
    """(property, violations): what must hold in any grown forest."""
    nodes = forest.nodes
    leaves = forest.leaves().groupBy("tree").agg(F.sum("cases").alias("n"), F.sum("positives").alias("p"))
    roots = nodes.filter("depth = 0").select("tree", "cases", "positives")
    kept = roots.join(leaves, "tree", "left").filter(~F.coalesce((F.col("n") == F.col("cases")) & (F.col("p") == F.col("positives")), F.lit(False)))
    inner = nodes.filter("feature is not null")
    empty = nodes.filter((F.col("cases") <= 0) & (F.col("depth") > 0))
    repeated = nodes.groupBy("tree", "node").agg(n_rows()).filter("n > 1")
    pure_inner = inner.filter((F.col("positives") == 0) | (F.col("positives") == F.col("cases")))
    parts: Sequence[tuple[str, DataFrame]] = [
        ("leaves_hold_the_root", kept), ("no_empty_node", empty), ("no_pure_node_is_split", pure_inner), ("names_are_unique", repeated)]
    out = None
    for name, bad in parts:
        row = bad.agg(F.lit(name).alias("property"), F.count(F.lit(1)).alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out
