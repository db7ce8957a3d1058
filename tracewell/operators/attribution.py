"""Per-case feature attributions: exact Shapley values of a forest, and tables made from them.

Attributions are a long table (case_id, feature, shap_value); `explained` tables have a row per
explained case.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.columns import count_where, mapped, n_rows, scalar
from tracewell.functions.tables import measured_broadcast
from tracewell.operators.contracts import ContractError
from tracewell.operators.exact_forest import ExactForest, by_chunks, predict_exact, tree_chunks
from tracewell.operators.order import exact_quantiles
from tracewell.session import cut_lineage, scratch_path

# --- exact interventional Shapley values of a forest ---------------------------------------

# The forest and the background rows are sent to every executor, so their bytes are bounded.
MAX_EXPLAINER_BYTES = 2 << 30
# Rows explained together; bounds the row x background pairs held at once.
ROWS_PER_BLOCK = 4096
# Rows that meet a chunk of stored trees in one task, block by block.
STORED_BLOCK = 2 * ROWS_PER_BLOCK
# Tasks of one run; more blocks than this share tasks.
MAX_TASKS = 20_000
# Largest gap between base value plus contributions and the forest's own probability in a batch that counts as done.
BATCH_TOLERANCE = 1e-9


@dataclass
class Trees:
    """The trees of a forest in flat arrays: tree i has the nodes offsets[i] to offsets[i + 1], its root first. A row goes left when
    its value is at most the threshold; children are places inside the tree, -1 at a leaf, which has a probability per label."""

    left: np.ndarray
    right: np.ndarray
    features: np.ndarray
    thresholds: np.ndarray
    values: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return int((self.left < 0).sum())

    def tree(self, i: int) -> Trees:
        part = slice(self.offsets[i], self.offsets[i + 1])
        return Trees(self.left[part], self.right[part], self.features[part], self.thresholds[part], self.values[part], np.array([0, part.stop - part.start]))

    def count(self) -> int:
        return len(self.offsets) - 1

    def arrays(self) -> list[np.ndarray]:
        return [self.left, self.right, self.features, self.thresholds, self.values, self.offsets]


def forest_nodes(model) -> DataFrame:
    """Node table of a fitted Spark forest, as Spark ML writes it when the model is saved."""
    spark = SparkSession.active()
    path = scratch_path(spark, "forest")
    model.save(path)
    n = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"), F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        n["impurityStats"].alias("stats"),
    )


def _packed_tree(nodes: pd.DataFrame) -> pd.DataFrame:
    """One tree's nodes as packed arrays, in the order of a walk from the root."""
    nodes = nodes.set_index("id")
    left, right, feature, threshold = (nodes[c].to_dict() for c in ("left", "right", "feature", "threshold"))
    stats = nodes["stats"].to_dict()
    order, stack = [], [0]
    while stack:
        node = stack.pop()
        order.append(node)
        if left[node] >= 0:
            stack += [right[node], left[node]]
    place = {n: i for i, n in enumerate(order)} | {-1: -1}
    inner = [left[n] >= 0 for n in order]
    packed = [
        np.array([place[left[n]] if i else -1 for n, i in zip(order, inner)], "<i4"), np.array([place[right[n]] if i else -1 for n, i in zip(order, inner)], "<i4"),
        np.array([feature[n] if i else -1 for n, i in zip(order, inner)], "<i4"), np.array([threshold[n] if i else 0.0 for n, i in zip(order, inner)], "<f8"),
        np.array([np.asarray(stats[n]) / sum(stats[n]) for n in order], "<f8")]
    return pd.DataFrame({"tree": [int(nodes["tree"].iloc[0])], **{c: [x.tobytes()] for c, x in zip("abcde", packed)}})


def forest_trees(model) -> Trees:
    """All trees of a fitted Spark forest with the probabilities of all labels.

    Executors pack the nodes tree by tree; the size is checked before they come to the driver, where the model is anyway.
    """
    trees = cut_lineage(forest_nodes(model).groupBy("tree").applyInPandas(
        _packed_tree, "tree int, a binary, b binary, c binary, d binary, e binary"))
    size = trees.agg(F.sum(sum(F.octet_length(c) for c in "abcde"))).first()[0]
    if size > MAX_EXPLAINER_BYTES:
        raise ContractError(f"forest of {size} bytes, more than {MAX_EXPLAINER_BYTES}")
    rows = trees.orderBy("tree").collect()
    flat = [np.frombuffer(b"".join(r[c] for r in rows), kind) for c, kind in zip("abcde", ("<i4", "<i4", "<i4", "<f8", "<f8"))]
    offsets = np.concatenate([[0], np.cumsum([len(r["a"]) // 4 for r in rows], dtype=np.int64)])
    return Trees(*flat[:4], flat[4].reshape(len(flat[0]), -1), offsets)


def _shapley_weights(depth: int) -> tuple[np.ndarray, np.ndarray]:
    """w_in[u, v] = (u-1)! v! / (u+v)!  and  w_out[u, v] = u! (v-1)! / (u+v)!."""
    fact = np.cumprod(np.concatenate([[1.0], np.arange(1, 2 * depth + 2, dtype=float)]))
    w_in, w_out = np.zeros((depth + 1, depth + 1)), np.zeros((depth + 1, depth + 1))
    for u in range(depth + 1):
        for v in range(depth + 1):
            if u:
                w_in[u, v] = fact[u - 1] * fact[v] / fact[u + v]
            if v:
                w_out[u, v] = fact[u] * fact[v - 1] / fact[u + v]
    return w_in, w_out


@dataclass
class _Side:
    """Rows at a node by the conditions of the path that they meet: the different sets of these, as bits, and for each row the
    place of its own; rows that nothing makes up for any more have the place behind the last."""

    codes: np.ndarray
    of: np.ndarray

    def split(self, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row its place and the way it goes as one number, and which of these there are."""
        key = 2 * self.of + left
        return key, np.flatnonzero(np.bincount(key, minlength=2 * len(self.codes))[: 2 * len(self.codes)])

    def below(self, at: np.ndarray, side: int, bit: int, again: bool) -> tuple[np.ndarray, np.ndarray]:
        """The codes after one more condition, on a feature that is new on the path or was met before, and the place of each of `at` in them."""
        met, code = (at & 1) == side, self.codes[at >> 1]
        if again:
            return np.unique(np.where(met, code, code & ~np.uint64(1 << bit)), return_inverse=True)
        return code | (met.astype(np.uint64) << np.uint64(bit)), np.arange(len(at))

    def kept(self, codes: np.ndarray, key: np.ndarray, at: np.ndarray, place: np.ndarray, keep: np.ndarray) -> _Side:
        count = int(np.count_nonzero(keep))
        places = np.full(2 * len(self.codes) + 2, count)
        places[at] = np.where(keep, np.cumsum(keep) - 1, count)[place]
        return _Side(codes[keep], places[key])


def _makes_up(codes: np.ndarray, others: np.ndarray, d: int) -> np.ndarray:
    """Which pairs meet all d conditions between them, codes x others."""
    kind = np.uint16 if d <= 16 else np.uint32 if d <= 32 else np.uint64
    return (codes.astype(kind)[:, None] | others.astype(kind)) == kind((1 << d) - 1)


def _leaf_values(x: _Side, background: _Side, pairs: np.ndarray, d: int, weights: tuple[np.ndarray, np.ndarray], scale: float) -> np.ndarray:
    """Contributions of the leaf's conditions, conditions x codes of rows, for a leaf of value one. Of a pair every condition is met by one
    side, so the number u that only the row meets is that of those the background row does not, and the number v the other way round."""
    w_in, w_out = weights
    count = np.bincount(background.of, minlength=len(background.codes))[: len(background.codes)]
    u, v = d - np.bitwise_count(background.codes), d - np.bitwise_count(x.codes)
    bits = np.arange(d, dtype=np.uint64)
    order = np.argsort(u, kind="stable")
    edges = np.searchsorted(u[order], np.arange(d + 2))
    # whole numbers, exact in any order: the background rows of each u, and of those the ones that do not meet a condition
    kind = np.float32 if count.sum() < 1 << 24 else float
    alive, number = pairs[:, order].astype(kind), np.ones((len(order), d + 1), kind)
    number[:, :d] = (background.codes[order][:, None] >> bits) & np.uint64(1) == 0
    number *= count[order][:, None].astype(kind)
    gain, loss = np.zeros((len(v), d)), np.zeros(len(v))
    for n in np.flatnonzero(np.diff(edges)):
        part = alive[:, edges[n]:edges[n + 1]] @ number[edges[n]:edges[n + 1]]
        gain += w_in[n, v][:, None] * part[:, :d]
        loss += w_out[n, v] * part[:, d]
    return np.where((x.codes >> bits[:, None]) & np.uint64(1), gain.T, -loss) * scale


def _walk(tree: Trees, x: np.ndarray, background: np.ndarray, weights, scale: float, phi: np.ndarray) -> None:
    """Adds a tree's contributions to phi (labels x features x rows), by one walk: nodes share the path above them, and rows
    without a partner are left behind on the way: every condition has to be met by one of a pair. `x` and `background` have a row a feature."""
    every = [_Side(np.zeros(1, np.uint64), np.zeros(r.shape[1], np.intp)) for r in (x, background)]
    stack = [(0, (), *every, np.ones((1, 1), bool))]
    while stack:
        node, path, rows, others, pairs = stack.pop()
        if tree.left[node] < 0:
            if path:
                found = np.zeros((len(path), len(rows.codes) + 1))
                found[:, :-1] = _leaf_values(rows, others, pairs, len(path), weights, scale)
                for k, value in enumerate(tree.values[node]):
                    if value:
                        for f, per_code in zip(path, found * value):
                            phi[k, f] += per_code[rows.of]
            continue
        f, threshold = int(tree.features[node]), tree.thresholds[node]
        again = f in path
        bit = path.index(f) if again else len(path)
        below = path if again else (*path, f)
        (key, at), (other_key, other_at) = rows.split(x[f] <= threshold), others.split(background[f] <= threshold)
        for child, side in ((tree.right[node], 0), (tree.left[node], 1)):
            (codes, place), (other, other_place) = rows.below(at, side, bit, again), others.below(other_at, side, bit, again)
            pairs = _makes_up(codes, other, len(below))
            keep, kept = pairs.any(1), pairs.any(0)
            if keep.any():
                stack.append((int(child), below, rows.kept(codes, key, at, place, keep), others.kept(other, other_key, other_at, other_place, kept),
                              pairs if keep.all() and kept.all() else pairs[keep][:, kept]))


def forest_shapley(forest: Trees, trees: int, x: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Exact interventional Shapley values, rows x features x labels, averaged over background and
    trees.

    For a row and a background row only the conditions met by one and not the other matter: U
    met by the row alone, V by the background alone. A condition met by neither closes the
    leaf. Rows with the same met conditions share the work, and so do the labels and the leaves below a node. A condition
    is all that a path asks of one feature.
    """
    if len(x) > ROWS_PER_BLOCK:
        blocks = [x[i:i + ROWS_PER_BLOCK] for i in range(0, len(x), ROWS_PER_BLOCK)]
        return np.concatenate([forest_shapley(forest, trees, b, background) for b in blocks])
    phi = np.zeros((forest.values.shape[1], x.shape[1], x.shape[0]))
    weights = _shapley_weights(min(x.shape[1], 63))
    by_feature = [np.ascontiguousarray(r.T) for r in (x, background)]
    for i in range(forest.count()):
        _walk(forest.tree(i), *by_feature, weights, 1.0 / (background.shape[0] * trees), phi)
    return np.ascontiguousarray(phi.transpose(2, 1, 0))


def forest_probability(forest: Trees, trees: int, x: np.ndarray) -> np.ndarray:
    """Probabilities, rows x labels."""
    out = np.zeros((x.shape[0], forest.values.shape[1]))
    for i in range(forest.count()):
        tree, at, active = forest.tree(i), np.zeros(len(x), np.int64), np.arange(len(x))
        while len(active):
            here = at[active]
            inner = tree.left[here] >= 0
            active, here = active[inner], here[inner]
            goes_left = x[active, tree.features[here]] <= tree.thresholds[here]
            at[active] = np.where(goes_left, tree.left[here], tree.right[here])
        out += tree.values[at]
    return out / trees


@dataclass
class ForestExplainer:
    """A forest and its background, ready to explain rows anywhere."""

    leaves: Trees
    trees: int
    background: np.ndarray

    @classmethod
    def build(cls, model, background: DataFrame) -> ForestExplainer:
        """`background` is a bounded sample with a `features` vector; its size is checked."""
        rows = background.count()
        if rows == 0 or rows * model.numFeatures * 8 > MAX_EXPLAINER_BYTES:
            raise ContractError(f"background of {rows} rows x {model.numFeatures} features is empty or too large")
        b = np.array([r[0] for r in background.select(vector_to_array("features")).collect()])
        return cls(forest_trees(model), model.getNumTrees, b)

    def part(self, index: int, count: int) -> ForestExplainer:
        """Every count-th tree: the parts' values add up to the whole forest's."""
        if count == 1:
            return self
        chosen = [self.leaves.tree(i) for i in range(index, self.leaves.count(), count)]
        empty = self.leaves.tree(0) if self.leaves.count() else self.leaves
        flat = [np.concatenate([getattr(t, n) for t in chosen]) if chosen else getattr(empty, n)[:0] for n in ("left", "right", "features", "thresholds", "values")]
        offsets = np.concatenate([[0], np.cumsum([t.offsets[-1] for t in chosen], dtype=np.int64)]).astype(np.int64)
        return ForestExplainer(Trees(*flat, offsets), self.trees, self.background)

    @cached_property
    def base_values(self) -> np.ndarray:
        """Mean probability of each label over the background."""
        return forest_probability(self.leaves, self.trees, self.background).mean(axis=0)

    @cached_property
    def digest(self) -> str:
        """Fingerprint of forest and background."""
        h = hashlib.sha256(str(self.trees).encode())
        for x in [*self.leaves.arrays(), self.background]:
            h.update(str(x.shape).encode() + np.ascontiguousarray(x).tobytes())
        return h.hexdigest()


@dataclass
class StoredExplainer:
    """A forest that stays in a table, and its background; chunks of trees and blocks of rows meet in tasks."""

    forest: ExactForest
    background: np.ndarray
    base_values: np.ndarray

    @classmethod
    def build(cls, forest: ExactForest, background: DataFrame) -> StoredExplainer:
        """`background` is a bounded sample with case_id, a target and a `features` vector; its size is checked."""
        rows = background.count()
        if rows == 0 or rows * forest.features * 8 > MAX_EXPLAINER_BYTES:
            raise ContractError(f"background of {rows} rows x {forest.features} features is empty or too large")
        b = np.array([r[0] for r in background.select(vector_to_array("features")).collect()])
        p = predict_exact(forest, background).agg(F.avg("y_prob")).first()[0]
        return cls(forest, b, np.array([1 - p, p]))

    @cached_property
    def digest(self) -> str:
        """Fingerprint of forest and background; one short hash a tree comes to the driver."""
        tree = F.sha2(F.concat(F.col("tree").cast("string").cast("binary"), *"abcde"), 256).alias("h")
        h = hashlib.sha256(str(self.forest.trees).encode())
        for r in self.forest.packed.select("tree", tree).orderBy("tree").collect():
            h.update(r["h"].encode())
        h.update(str(self.background.shape).encode() + np.ascontiguousarray(self.background).tobytes())
        return h.hexdigest()

    def explained(self, rows: DataFrame, labels: Sequence[int]) -> DataFrame:
        """Of rows (case_id, others, x): these, label, phi, seconds and the forest's probability."""
        extra = [c for c in rows.columns if c != "x"]
        kinds = dict(rows.dtypes)
        schema = ", ".join(f"{c} {kinds[c]}" for c in extra) + ", label int, chunk int, x array<double>, phi array<double>, seconds double, probability double"
        blocks = max(1, -(-rows.count() // STORED_BLOCK))
        chunks = tree_chunks(self.forest, -(-2 * rows.sparkSession.sparkContext.defaultParallelism // blocks))
        background, count, wanted = self.background, self.forest.trees, list(labels)

        def run(chunk: int, some: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
            e = ForestExplainer(_trees(trees), count, background)
            if not len(some):
                return pd.DataFrame(columns=[*extra, "label", "chunk", "x", "phi", "seconds", "probability"])
            return _explain_frame(e, some, wanted, True).assign(chunk=np.int32(chunk))[[*extra, "label", "chunk", "x", "phi", "seconds", "probability"]]

        parts = by_chunks(self.forest, rows, chunks, STORED_BLOCK, run, schema)
        # in the order of the chunks, so that the sums are the same in every run
        ordered = F.array_sort(F.collect_list(F.struct("chunk", "phi", "probability", "seconds")))
        summed = parts.groupBy(*extra, "label").agg(F.any_value("x").alias("x"), ordered.alias("parts"))
        zero = F.array_repeat(F.lit(0.0), self.forest.features)
        total = lambda c: F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p[c]).alias(c)
        phi = F.aggregate("parts", zero, lambda acc, p: F.zip_with(acc, p["phi"], lambda a, b: a + b))
        return summed.select(*extra, "label", "x", phi.alias("phi"), total("seconds"), total("probability"))


def _trees(packed: pd.DataFrame) -> Trees:
    """The trees of some rows of `packed_trees`."""
    packed = packed.sort_values("tree")
    flat = [np.frombuffer(b"".join(packed[c]), kind) for c, kind in zip("abcde", ("<i4", "<i4", "<i4", "<f8", "<f8"))]
    return Trees(*flat[:4], flat[4].reshape(len(flat[0]), -1), np.r_[0, np.cumsum(packed["size"].to_numpy(np.int64))])


def _kernel_schema(data: DataFrame, *extra: str) -> str:
    kind = dict(data.dtypes)["case_id"]
    return ", ".join([f"case_id {kind}", *extra, "label int, x array<double>", "phi array<double>", "seconds double, probability double"])


def _base_of(e: ForestExplainer | StoredExplainer) -> Column:
    """The label's base value."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in e.base_values]), F.col("label") + 1)


def tree_attribution(
    explainer: ForestExplainer | StoredExplainer, data: DataFrame, dictionary: DataFrame, slices: int | None = None, labels: Sequence[int] = (1,)
) -> DataFrame:
    """(case_id, label, feature, feature_value, shap_value, base_value) for every row of `data` and
    each of `labels`, all from one pass.

    The values are sums over trees, so few rows are spread by slices of the forest and many
    rows by blocks; each task holds blocks and one slice. Forest and background travel once
    per executor.
    """
    spark = data.sparkSession
    if isinstance(explainer, StoredExplainer):
        cells = _cells(explainer.explained(data.select("case_id", vector_to_array("features").alias("x")), labels))
        return _named(cells, dictionary).drop("seconds", "probability").withColumn("base_value", _base_of(explainer))
    blocks = max(1, -(-data.count() // ROWS_PER_BLOCK))
    if slices is None:
        slices = max(1, spark.sparkContext.defaultParallelism // blocks)
    shared = spark.sparkContext.broadcast(explainer)
    wanted = list(labels)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, rows in pdf.groupby("slice"):
                yield _explain_frame(shared.value.part(int(part), slices), rows.drop(columns="slice"), wanted, False)

    block = F.pmod(F.xxhash64("case_id"), F.lit(blocks))
    rows = data.select("case_id", vector_to_array("features").alias("x"), block.alias("block"),
                       F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    tasks = min(blocks * slices, MAX_TASKS)
    slot = F.pmod(F.col("block") * slices + F.col("slice"), F.lit(tasks)).cast("int").alias("slot")
    placed = rows.select("case_id", "x", "slice", slot).repartitionById(tasks, "slot").drop("slot")
    cells = _cells(placed.mapInPandas(explain, _kernel_schema(data)))
    if slices > 1:
        cells = cells.groupBy("case_id", "label", "feature_index").agg(
            F.max("feature_value").alias("feature_value"), F.sum("shap_value").alias("shap_value")
        )
    return _named(cells, dictionary).drop("seconds", "probability").withColumn("base_value", _base_of(explainer))


def _explain_frame(e: ForestExplainer, pdf: pd.DataFrame, labels: Sequence[int], whole: bool) -> pd.DataFrame:
    """Contributions of the rows for each label; for the whole forest also its probability."""
    start = time.perf_counter()
    x = np.stack(pdf["x"].to_list())
    phi = forest_shapley(e.leaves, e.trees, x, e.background)
    probability = forest_probability(e.leaves, e.trees, x) if whole else np.full((len(x), phi.shape[2]), np.nan)
    seconds = (time.perf_counter() - start) / len(pdf)
    return pd.concat([
        pdf.assign(label=np.int32(k), phi=list(phi[:, :, k]), seconds=seconds, probability=probability[:, k]) for k in labels])


def _cells(rows: DataFrame) -> DataFrame:
    """One row per case and feature from the arrays of values and contributions."""
    cells = F.explode(F.transform(
        F.arrays_zip("x", "phi"),
        lambda c, i: F.struct(i.cast("long").alias("feature_index"), c["x"].alias("v"), c["phi"].alias("p")),
    )).alias("c")
    keep = [c for c in rows.columns if c not in ("x", "phi")]
    return rows.select(*keep, cells).select(
        *keep, "c.feature_index", F.col("c.v").alias("feature_value"), F.col("c.p").alias("shap_value")
    )


def _named(cells: DataFrame, dictionary: DataFrame) -> DataFrame:
    names = dictionary.select("feature_index", F.col("feature_name").alias("feature"))
    return cells.join(measured_broadcast(names), "feature_index").drop("feature_index")


def attribution_batches(
    explainer: ForestExplainer | StoredExplainer, data: DataFrame, dictionary: DataFrame, path: str, batch_size: int = 50, label: int = 1
) -> DataFrame:
    """Attribute in fixed-size batches below `path`, resuming after a stop.

    `data` has `sample_order`. A run is named by a hash of forest, background, dictionary, label
    and batch size, so another model never meets these files. A batch is done when the run's
    ledger holds it with the fingerprint of the same input; only missing batches are computed.
    Before a batch enters the ledger its values are read back: all finite, and base value plus
    contributions within BATCH_TOLERANCE of the forest's probability; otherwise the call fails
    after entering the good ones. Returns the batches of this call's input.
    """
    spark = data.sparkSession
    stored_forest = isinstance(explainer, StoredExplainer)
    shared = None if stored_forest else spark.sparkContext.broadcast(explainer)
    features = sorted((r["feature_index"], r["feature_name"]) for r in dictionary.select("feature_index", "feature_name").collect())
    run = hashlib.sha256(f"{explainer.digest}{features}{label}{batch_size}".encode()).hexdigest()[:32]
    rows = data.select(
        "case_id", "sample_order", vector_to_array("features").alias("x"),
        F.floor(F.col("sample_order") / batch_size).cast("int").alias("batch"),
    )
    digest = F.conv(F.substring(F.md5(F.concat_ws(",", "case_id", "sample_order", F.col("x").cast("string"))), 1, 12), 16, 10)
    prints = cut_lineage(rows.groupBy("batch").agg(
        n_rows("case_count"), F.sum(digest.cast("decimal(20,0)")).cast("string").alias("fingerprint")
    ))
    ledger_path, data_path = f"{path}/{run}/ledger", f"{path}/{run}/attributions"
    entry = ["batch", "case_count", "fingerprint"]
    schema = _kernel_schema(data, "sample_order long", "batch int", "fingerprint string")
    todo = prints.join(_ledger(spark, ledger_path), entry, "left_anti")
    waiting = todo.count()
    if waiting:
        attempt = uuid.uuid4().hex
        tasks = min(waiting, MAX_TASKS)
        pending = rows.join(todo.select("batch", "fingerprint"), "batch").withColumn("slot", F.pmod("batch", F.lit(tasks)))

        def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for _, group in pdf.groupby("batch"):
                    yield _explain_frame(shared.value, group, [label], True)

        given = ["case_id", "sample_order", "batch", "fingerprint", "x"]
        written = f"{data_path}/attempt={attempt}"
        if stored_forest:
            done = explainer.explained(pending.select(*given), [label]).select(*given[:-1], "label", "x", "phi", "seconds", "probability")
        else:
            done = pending.repartitionById(tasks, "slot").select(*given).mapInPandas(explain, schema)
        done.write.parquet(written)
        bad = _faulty_batches(spark.read.schema(schema).parquet(written), float(explainer.base_values[label]))
        good = todo.join(bad, "batch", "left_anti").withColumn("attempt", F.lit(attempt))
        good.write.mode("append").parquet(ledger_path)
        faults = bad.limit(20).collect()
        if faults:
            raise ContractError(f"batches whose values do not add up: {[tuple(r) for r in faults]}")
    current = prints.join(_ledger(spark, ledger_path), entry).groupBy("batch", "fingerprint").agg(F.max("attempt").alias("attempt"))
    stored = spark.read.schema(f"{schema}, attempt string").parquet(data_path).join(current, ["batch", "fingerprint", "attempt"])
    kept = stored.drop("fingerprint", "attempt")
    return _named(_cells(kept), dictionary).withColumn("base_value", F.lit(float(explainer.base_values[label])))


def _faulty_batches(rows: DataFrame, base: float) -> DataFrame:
    """(batch, faults): rows of a batch that are not finite or miss the probability."""
    total = F.aggregate("phi", F.lit(base), lambda acc, v: acc + v)
    gap = F.abs(total - F.col("probability"))
    return rows.groupBy("batch").agg(count_where(~F.coalesce(gap <= BATCH_TOLERANCE, F.lit(False)) | F.isnan(gap)).alias("faults")).filter(
        F.col("faults") > 0)


def _ledger(spark, path: str) -> DataFrame:
    """The batches that are done; an empty table where no run has been."""
    schema = "batch int, case_count long, fingerprint string, attempt string"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def batch_runtime(batches: DataFrame) -> DataFrame:
    """Seconds per batch, and total, fastest and slowest over the batches."""
    per_case = batches.groupBy("batch", "case_id").agg(F.max("seconds").alias("s"))
    per_batch = per_case.groupBy("batch").agg(n_rows("case_count"), F.sum("s").alias("seconds"))
    return per_batch.agg(
        n_rows("batches"), F.sum("case_count").alias("case_count"), F.sum("seconds").alias("total_seconds"),
        F.min_by("batch", "seconds").alias("fastest_batch"), F.min("seconds").alias("fastest_seconds"),
        F.max_by("batch", "seconds").alias("slowest_batch"), F.max("seconds").alias("slowest_seconds"),
    )


# --- checks on attributions -----------------------------------------------------------------

def reconstruction(attributions: DataFrame, predictions: DataFrame) -> DataFrame:
    """base + sum(phi) beside the model's probability per case."""
    sums = attributions.groupBy("case_id").agg(
        F.sum("shap_value").alias("__phi"), F.max("base_value").alias("base_value")
    )
    joined = sums.join(predictions.select("case_id", "y_prob"), "case_id")
    rebuilt = F.col("base_value") + F.col("__phi")
    return joined.select(
        "case_id", "base_value", F.col("y_prob").alias("model_probability"), rebuilt.alias("reconstructed_probability"),
        F.abs(rebuilt - F.col("y_prob")).alias("absolute_error"),
    )


def additivity_check(
    attributions: DataFrame, predictions: DataFrame, thresholds: Sequence[float] = (1e-9, 1e-6)
) -> DataFrame:
    """Size and spread of the additivity error and how many cases exceed each threshold."""
    r = cut_lineage(reconstruction(attributions, predictions).select("absolute_error"))
    e = F.col("absolute_error")
    out = r.agg(
        n_rows("case_count"), F.max(e).alias("max_error"), F.avg(e).alias("mean_error"), F.min(e).alias("min_error"),
        *[count_where(e > t).alias(f"above_{t:.0e}".replace("-", "_")) for t in thresholds],
    )
    return out.withColumn("median_error", scalar(exact_quantiles(r, "absolute_error", {"median": 0.5}), "median"))


def class_zero_additivity(
    positive: DataFrame, negative: DataFrame, predictions: DataFrame, tolerance: float = 1e-9
) -> DataFrame:
    """The other class's attributions reconstruct 1 - p, and both classes' values cancel."""
    other = predictions.withColumn("y_prob", 1 - F.col("y_prob"))
    back = reconstruction(negative, other)
    both = positive.select("case_id", "feature", F.col("shap_value").alias("a")).join(
        negative.select("case_id", "feature", F.col("shap_value").alias("b")), ["case_id", "feature"], "full_outer"
    )
    cancel = both.agg(F.max(F.abs(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)))).alias("m"))
    out = back.agg(n_rows("case_count"), F.max("absolute_error").alias("max_error"))
    return out.withColumn("max_class_sum", scalar(cancel, "m")).withColumn(
        "status", F.when((F.col("max_error") <= tolerance) & (F.col("max_class_sum") <= tolerance), "PASS").otherwise("FAIL")
    )


def attribution_numeric(attributions: DataFrame) -> DataFrame:
    phi = F.col("shap_value")
    return attributions.agg(
        n_rows("values"), F.min(phi).alias("min_value"), F.max(phi).alias("max_value"),
        F.avg(F.abs(phi)).alias("mean_abs_value"),
        count_where(F.isnan(phi)).alias("nan_values"),
        count_where(F.abs(phi) == float("inf")).alias("infinite_values"),
    )


# --- importance -----------------------------------------------------------------------------

def global_importance(attributions: DataFrame) -> DataFrame:
    """Mean absolute contribution, rank (ties by name) and share of the total.

    One row per feature remains before the ranking window.
    """
    means = attributions.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"))
    w = W.orderBy(F.desc("mean_abs_shap"), "feature")
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return means.select(
        F.row_number().over(w).cast("long").alias("rank"), "feature", "mean_abs_shap",
        F.try_divide(F.col("mean_abs_shap"), F.sum("mean_abs_shap").over(everything)).alias("share_of_total_importance"),
    )


def feature_groups(dictionary: DataFrame, groups: Mapping[str, str], prefixes: Mapping[str, str] | None = None,
                   strict: bool = False) -> DataFrame:
    """Conceptual group of every feature from its source group, and whether its name follows the
    source's prefix. Strict mode refuses unmapped sources and misnamed features."""
    rule = mapped(F.col("source_group"), prefixes or {"": ""})
    out = dictionary.select(
        F.col("feature_name").alias("feature"), "source_group",
        mapped(F.col("source_group"), groups).alias("group"),
        F.coalesce(F.startswith("feature_name", rule), F.lit(True)).alias("name_matches"),
    )
    if strict:
        bad = [r[0] for r in out.filter("group is null or not name_matches").select("feature").limit(50).collect()]
        if bad:
            raise ContractError(f"unmapped or misnamed features: {bad}")
    return out


def group_counts(groups: DataFrame) -> DataFrame:
    return groups.groupBy("group").agg(n_rows("feature_count"))


def group_importance(importance: DataFrame, groups: DataFrame) -> DataFrame:
    sums = importance.join(groups.select("feature", "group"), "feature").groupBy("group").agg(
        n_rows("feature_count"),
        F.sum("mean_abs_shap").alias("group_total_importance"),
        F.sum("share_of_total_importance").alias("share_of_total_importance"),
    )
    return sums.withColumn(
        "group_mean_importance_per_feature", F.col("group_total_importance") / F.col("feature_count")
    )


# --- single cases ----------------------------------------------------------------------------

def _category() -> Column:
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    return F.when(t & p, "TP").when(~t & ~p, "TN").when(~t & p, "FP").otherwise("FN")


def local_examples(explained: DataFrame) -> DataFrame:
    """The first case of each of TP, TN, FP, FN by sample order, found without sorting."""
    first = F.min_by(F.struct("case_id", "y_true", "y_pred", "y_prob"), "sample_order")
    out = explained.groupBy(_category().alias("category")).agg(
        F.min("sample_order").alias("sample_order"), first.alias("c")
    )
    return out.select("category", "sample_order", "c.*")


def local_contributions(examples: DataFrame, attributions: DataFrame) -> DataFrame:
    """Every feature of the example cases with the direction of its contribution.

    The examples are at most four rows.
    """
    phi = F.col("shap_value")
    direction = F.when(phi > 0, "positive").when(phi < 0, "negative").otherwise("zero")
    few = F.broadcast(examples.select("category", "sample_order", "case_id"))
    return attributions.join(few, "case_id").withColumns({"abs_shap_value": F.abs(phi), "direction": direction})


def local_signed_top(contributions: DataFrame, k: int = 5) -> DataFrame:
    """The k largest positive and k largest negative contributions per example."""
    w = W.partitionBy("category", "direction").orderBy(F.desc("abs_shap_value"), "feature")
    ranked = contributions.filter("direction <> 'zero'").withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.filter(F.col("rank") <= k).select("category", "direction", "rank", "feature", "shap_value")


def waterfall_data(contributions: DataFrame, base: str = "base_value", limit: int = 15) -> DataFrame:
    """Steps from the base value to the output: the largest contributions, the rest as one row,
    and the running total per example."""
    w = W.partitionBy("category").orderBy(F.desc("abs_shap_value"), "feature")
    ranked = contributions.withColumn("rank", F.row_number().over(w))
    count = F.count(F.lit(1)).over(W.partitionBy("category"))
    keep = (F.col("rank") < limit) | (count <= limit)
    steps = ranked.withColumn("keep", keep).groupBy(
        "category",
        F.when(F.col("keep"), F.col("rank")).otherwise(F.lit(limit)).cast("long").alias("step"),
    ).agg(
        F.when(F.max(F.col("keep")), F.max("feature")).otherwise(F.lit("(rest)")).alias("feature"),
        F.sum("shap_value").alias("contribution"),
        F.max(base).alias("base_value"),
    )
    running = W.partitionBy("category").orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    return steps.withColumn("running_total", F.col("base_value") + F.sum("contribution").over(running))


def summary_points(attributions: DataFrame, importance: DataFrame, k: int = 20) -> DataFrame:
    """All (value, contribution) points of the top features; the top list has k rows."""
    top = F.broadcast(importance.filter(F.col("rank") <= k).select("feature"))
    return attributions.join(top, "feature", "left_semi")
