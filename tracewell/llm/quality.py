"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every token bucket has a sparse random index vector. Its word vector is the sum of the index vectors
of its neighbours over the whole corpus, at unit length, plus its own index vector: co-occurrence
statistics in a fixed number of dimensions, summed by one distributed aggregation over all documents.
A document is the mean of its tokens' vectors with some of their spread. A two-layer numpy network is
fitted on at most `max_labelled` labelled rows (smallest hashes of the id), a fifth of which only sets
the temperature that calibrates the probabilities.

Nulls: null texts are empty, and an empty text has the zero vector and gets a score from it. Labels with
a null id or value are left out, and of several labels of an id the largest counts. Without labels all
scores are 0.5. Ids are only passed on, repeated rows each get a row, and an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bucket_of_id, small_batches, text_of

BUCKETS = 1 << 14
DIMS = 32
NONZERO = 2
REACH = 2  # neighbours on each side
WIDTH = 2 * DIMS + 2
HIDDEN = 24
MAX_LABELLED = 20_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
_GROUP = 1 << 18  # tokens handled together

_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+").findall


def _random(seed: int) -> np.random.Generator:
    return np.random.default_rng(seed)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of every bucket's index vector."""
    rng = _random(1)
    return rng.integers(0, DIMS, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def buckets_of(text: bytes) -> np.ndarray:
    tokens = _TOKEN(text)
    return np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens)).astype(np.int64) & (BUCKETS - 1)


def _groups(texts):
    """Bucket arrays of texts in groups of about _GROUP tokens: (buckets, sizes)."""
    held, sizes, n = [], [], 0
    for t in texts:
        b = buckets_of(t.as_py())
        held.append(b)
        sizes.append(len(b))
        n += len(b)
        if n >= _GROUP:
            yield np.concatenate(held), np.array(sizes)
            held, sizes, n = [], [], 0
    if sizes:
        yield np.concatenate(held), np.array(sizes)


def context_sums(docs: DataFrame, text: str = "text") -> np.ndarray:
    """For every bucket the sum of its neighbours' index vectors over all documents.

    Tasks send one row per bucket they saw; Spark sums them, and the result has a fixed size.
    """
    small_batches(docs.sparkSession)
    names = [f"d{i}" for i in range(DIMS)]

    def run(batches):
        place, sign = index_vectors()
        total = np.zeros(BUCKETS * DIMS)
        for batch in batches:
            for b, sizes in _groups(batch.column(0)):
                doc = np.repeat(np.arange(len(sizes)), sizes)
                for step in range(1, REACH + 1):
                    same = doc[step:] == doc[:-step]
                    left, right = b[:-step][same], b[step:][same]
                    for a, c in ((left, right), (right, left)):
                        for k in range(NONZERO):
                            total += np.bincount(a * DIMS + place[c, k], sign[c, k], BUCKETS * DIMS)
        total = total.reshape(BUCKETS, DIMS)
        seen = np.flatnonzero(np.any(total, axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64())] + [pa.array(total[seen, i].astype(np.int64)) for i in range(DIMS)], names=["bucket", *names])

    parts = docs.select(text_of(F.col(f"`{text}`")).cast("binary").alias("t")).mapInArrow(
        run, "bucket bigint, " + ", ".join(f"{n} bigint" for n in names))
    rows = parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toPandas().to_numpy()
    out = np.zeros((BUCKETS, DIMS))
    if len(rows):
        out[rows[:, 0].astype(np.int64)] = rows[:, 1:]
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    place, sign = index_vectors()
    own = np.zeros((BUCKETS, DIMS))
    for k in range(NONZERO):
        own[np.arange(BUCKETS), place[:, k]] += sign[:, k]
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    return (own + np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)).astype(np.float32)


def pooled(vectors: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean and mean square of each document's word vectors, how often a token repeats the one before, and the length."""
    out = np.zeros((len(sizes), WIDTH))
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        rows = vectors[b]
        out[full, :DIMS] = np.add.reduceat(rows, starts, axis=0) / sizes[full, None]
        out[full, DIMS : 2 * DIMS] = np.add.reduceat(rows * rows, starts, axis=0) / sizes[full, None]
        again = np.concatenate([[False], b[1:] == b[:-1]])
        again[starts] = False
        out[full, -2] = np.add.reduceat(again.astype(float), starts) / sizes[full]
    out[:, -1] = np.log1p(sizes) / 10
    return out


@dataclass
class Network:
    """tanh layer and a logistic unit over standardized inputs; logits are divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 60, seed: int = 3) -> Network:
    """Adam on the logistic loss; one row in five is kept for the temperature."""
    width = x.shape[1]
    if len(y) < 10 or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(rate / (1 - rate))))
    rng = _random(seed)
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-6
    net = Network(mean, scale, rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    moment, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (x - mean) / scale
    for _ in range(epochs):
        own = rng.permutation(own)
        for at in range(0, len(own), 256):
            rows = own[at : at + 256]
            h = np.tanh(z[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
            d = (p - y[rows]) / len(rows)
            back = d[:, None] * params[2] * (1 - h * h)
            grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(0), h.T @ d + 1e-4 * params[2], d.sum(keepdims=True)]
            step += 1
            for i, g in enumerate(grads):
                moment[i] = 0.9 * moment[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                params[i] -= 0.01 * (moment[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logits, truth = net.logits(x[held]), y[held]
    def loss(t: float) -> float:
        return float(np.logaddexp(0, np.where(truth > 0, -logits, logits) / t).mean())
    net.temperature = min(np.geomspace(0.5, 8, 60), key=loss)
    return net


def labelled_sample(labels: DataFrame, label: str, folds: int, held_out: int, max_labelled: int) -> DataFrame:
    """At most `max_labelled` (doc_id, y) outside the held-out fold, those with the smallest hashes."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (bucket_of_id(F.col("doc_id"), folds) != held_out))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT,
             max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns of every row with __score (0 to 1) and __predicted (__score >= threshold)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(word_vectors(context_sums(docs)))  # BUCKETS x DIMS
    sample = labelled_sample(labels.select("doc_id", label), label, folds, held_out, max_labelled)
    width = WIDTH

    def vectors(batches):
        for batch in batches:
            found = [pooled(shared.value, b, sizes) for b, sizes in _groups(batch.column(2))]
            x = np.concatenate(found) if found else np.zeros((0, width))
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1) * width, pa.int32()), flat)], names=["doc_id", "y", "x"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most max_labelled labels
    rows = chosen.select("doc_id", "y", text_of(F.col("text")).cast("binary").alias("t")).mapInArrow(
        vectors, f"doc_id {id_type}, y int, x array<double>").groupBy("doc_id").agg(F.first("y").alias("y"), F.first("x").alias("x")).orderBy("doc_id").collect()
    x = np.array([r["x"] for r in rows]).reshape(-1, width)
    net = fit_network(x, np.array([r["y"] for r in rows], float))

    def score(batches):
        for batch in batches:
            found = [net.score(pooled(shared.value, b, sizes)) for b, sizes in _groups(batch.column(len(keep)))]
            s = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(s)], names=[*keep, "__score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    scored = docs.select(*[F.col(f"`{c}`") for c in keep], text_of(F.col("text")).cast("binary").alias("__t")).mapInArrow(score, f"{schema}, __score double")
    return scored.withColumn("__predicted", (F.col("__score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject; all columns stay."""
    return classify(docs, labels, keep=tuple(docs.columns)).where("__predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = (bucket_of_id(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    return classify(docs, labels).select("doc_id", held, F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))
