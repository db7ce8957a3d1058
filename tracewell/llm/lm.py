"""Scores under a hashed maximum-entropy model with a class-factored softmax.

A word's hash gives its class and its subclass. P(class | history), P(subclass | class, history) and the smoothed
share of the word among the training words of its subclass make its factored probability q. Both softmaxes add
up weights of hashed n-gram and skip features: the previous word, the two before it, the pair of both, and the skip
over one and over two words. The word itself is given its history by the pair it forms with the previous word:
P(word | history) = (n + KAPPA * q) / (N + KAPPA), where n counts the pair and N the previous word in training. This
sums to one, and words unseen in training share one event a subclass.

Weights start from the class shares. An update is the gradient, observed minus expected feature counts, summed over all
training documents, each entry divided by its expected count; expected counts of the first update follow from the
shares, those of the others from a pass over the documents. There are about as many feature rows as the square
root of the text's bytes; word and pair counts grow with the corpus.

Tasks cut the documents into chunks. A chunk is one row: its words as sorted hashes with counts, its documents as places
in that list, and its pairs of neighbours as sorted hashes with counts, cut into ranges of the hash space. A range of
all chunks is merged in one task and each chunk gets its totals back, so no table of all words or pairs is ever in
one place, and a frequent word or pair has one entry a chunk. Word hashes have 64 bits; those of pairs as many as leave
about one in a thousand pairs with another one's count.

Nulls: a null text is empty and holds the end token alone; a null id hashes as the empty text. Repeated
rows count as often as they occur. An empty table gives an empty result. Columns beyond id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bucket_of_id, staged, text_of

CLASSES = 16  # and as many subclasses in each
BUCKETS = CLASSES * CLASSES
FEATURES = 5
UPDATES = 2
PRIOR = 8.0  # added to expected counts
KAPPA = 100.0  # weight of the factored probability beside the pair's count
SMOOTHING = 0.1
FOLDS, HELD_OUT = 10, 0
CHUNK_BYTES = 1 << 24
RANGE_BYTES = 1 << 25  # text whose words and pairs a range of the hash space holds on average
MIN_ROWS, MAX_ROWS = 1 << 12, 1 << 20  # hashed features of a softmax
END = b"\n"  # no word has white space
_GROUP = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Sizes:
    """What follows from the amount of text: feature rows, ranges as bits of a hash, and bits of a pair's hash."""

    rows: int
    range_bits: int
    pair_bits: int

    @staticmethod
    def of(text_bytes: int) -> Sizes:
        def bits(x: float) -> int:
            return max(0, math.ceil(math.log2(max(x, 1))))
        rows = min(MAX_ROWS, max(MIN_ROWS, 1 << bits(math.sqrt(text_bytes))))
        return Sizes(rows, bits(text_bytes / RANGE_BYTES), min(64, max(24, bits(text_bytes) + 7)))


def word_hash(word: bytes) -> int:
    import xxhash

    return zlib.crc32(word) << 32 | xxhash.xxh32_intdigest(word)


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    """Class times CLASSES plus subclass of words by their hash."""
    mixed = ((hashes >> np.uint64(32)) * np.uint64(0x9E3779B1)) >> np.uint64(16)
    return (mixed & np.uint64(BUCKETS - 1)).astype(np.int64)


def _before(values: np.ndarray, starts: np.ndarray, back: int) -> np.ndarray:
    """The value so many places earlier in the same document, zero before its beginning."""
    out = np.zeros_like(values)
    out[back:] = values[:-back] if back < len(values) else 0
    for i in range(back):
        at = starts + i
        out[at[at < len(out)]] = 0
    return out


def feature_rows(hashes: np.ndarray, starts: np.ndarray, rows: int) -> list[np.ndarray]:
    """Rows of the active features of every position; `starts` are the places where documents begin."""
    x = hashes + np.uint64(1)
    p1, p2, p3 = (_before(x, starts, back) for back in (1, 2, 3))
    keys = [p1, p2 * np.uint64(3) + np.uint64(1), p1 * np.uint64(0x85EBCA6B) + p2 * np.uint64(0xC2B2AE35),
            p3 * np.uint64(5) + np.uint64(2), p1 * np.uint64(0x27D4EB2F) + p3 * np.uint64(0x165667B1)]
    return [(((k * _MIX) >> np.uint64(40)) & np.uint64(rows - 1)).astype(np.int64) for k in keys]


def _second(row: np.ndarray, cls: np.ndarray, rows: int) -> np.ndarray:
    """Row of a feature in the second softmax, given the class."""
    return ((row * CLASSES + cls) * 40503 >> 3) & (rows - 1)


def pair_keys(hashes: np.ndarray, starts: np.ndarray, bits: int) -> np.ndarray:
    """Hash of each word with the one before it."""
    previous = _before(hashes + np.uint64(1), starts, 1)
    k = (previous * np.uint64(0xD6E8FEB86659FD93)) ^ (hashes * np.uint64(0xA0761D6478BD642F))
    k ^= k >> np.uint64(32)
    return (k * _MIX) >> np.uint64(64 - bits)


@dataclass
class Model:
    """Log shares of classes and subclasses, and feature weights."""

    bias1: np.ndarray
    bias2: np.ndarray
    w1: np.ndarray
    w2: np.ndarray

    def probabilities(self, rows: list[np.ndarray], cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all classes, and of all subclasses of the class."""
        out = []
        for level, w in enumerate((self.w1, self.w2)):
            at = rows if level == 0 else [_second(r, cls, len(w)) for r in rows]
            z = np.take(w, at[0], axis=0)
            z += self.bias1 if level == 0 else self.bias2[cls]
            for r in at[1:]:
                z += np.take(w, r, axis=0)
            np.exp(z, out=z)  # weights are clipped, so this stays finite
            z /= (z @ np.ones(CLASSES, np.float32))[:, None]
            out.append(z)
        return out[0], out[1]


def first_model(tokens: np.ndarray, rows: int) -> Model:
    """Without features: shares of classes and, within each, of subclasses, from training tokens a bucket."""
    counts = tokens.reshape(CLASSES, CLASSES) + 1.0
    one = counts.sum(1)
    zeros = np.zeros((rows, CLASSES), np.float32)
    return Model(np.log(one / one.sum()).astype(np.float32), np.log(counts / one[:, None]).astype(np.float32), zeros, zeros.copy())


def observed_counts(rows: list[np.ndarray], bucket: np.ndarray, size: int) -> np.ndarray:
    """How often each feature row occurs with each class, and each row of the second softmax with each subclass."""
    cls, sub = np.divmod(bucket, CLASSES)
    out = np.zeros(2 * size * CLASSES, np.int64)
    for r in rows:
        out[: size * CLASSES] += np.bincount(r * CLASSES + cls, minlength=size * CLASSES)
        out[size * CLASSES :] += np.bincount(_second(r, cls, size) * CLASSES + sub, minlength=size * CLASSES)
    return out.reshape(2 * size, CLASSES)


def expected_counts(model: Model, rows: list[np.ndarray], bucket: np.ndarray) -> np.ndarray:
    """The same as the model has it."""
    size, cls = len(model.w1), bucket // CLASSES
    out = np.zeros((2, CLASSES, size))
    for level, p in enumerate(model.probabilities(rows, cls)):
        by_class = np.ascontiguousarray(p.T)
        for r in rows:
            r = r if level == 0 else _second(r, cls, size)
            for k in range(CLASSES):
                out[level, k] += np.bincount(r, by_class[k], size)
    return out.transpose(0, 2, 1).reshape(2 * size, CLASSES)


def first_expected(model: Model, observed: np.ndarray) -> np.ndarray:
    """Expected counts before any weight: how often a row occurs, times the shares. A row of the second softmax holds
    features of several classes; they count with the mean share of the classes by their tokens."""
    size = len(model.w1)
    share2 = np.exp(model.bias1) @ np.exp(model.bias2)
    return np.concatenate([observed[:size].sum(1)[:, None] * np.exp(model.bias1), observed[size:].sum(1)[:, None] * share2])


def update(model: Model, observed: np.ndarray, expected: np.ndarray) -> Model:
    size = len(model.w1)
    step = np.clip((observed - expected) / (FEATURES * 0.5 * (expected + PRIOR)), -1.0, 1.0).astype(np.float32)
    return Model(model.bias1, model.bias2, model.w1 + step[:size], model.w2 + step[size:])


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z only, white space U+0020 and U+0009 to U+000D


# ---- numbers as bytes ----

def pack(x: np.ndarray) -> bytes:
    """Compressed whole numbers from zero on, byte place by byte place; the first byte is how many places they need."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zlib.compress(planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zlib.decompress(memoryview(data)[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


# ---- chunks ----

CHUNK = ("chunk bigint, ids array<{id}>, held array<boolean>, sizes binary, places binary, hashes binary, counts binary, observed binary, "
         "keys array<struct<kind:int,part:int,keys:binary,counts:binary>>")


def _cut(kind: int, keys: np.ndarray, counts: np.ndarray, key_bits: int, range_bits: int) -> list[dict]:
    """Sorted keys by ranges of their highest bits; empty ranges are left out."""
    if range_bits == 0:
        edges = np.array([0, len(keys)])
    else:
        firsts = np.arange(1, 1 << range_bits, dtype=np.uint64) << np.uint64(key_bits - range_bits)
        edges = np.concatenate([[0], np.searchsorted(keys, firsts), [len(keys)]])
    return [{"kind": kind, "part": i, "keys": pack_sorted(keys[a:b]), "counts": pack(counts[a:b])}
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]


class Chunk:
    """Documents that are written as one row."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.ids, self.held, self.docs = [], [], []
        self.size = 0

    def add(self, doc_id, held: bool, text: bytes) -> None:
        words = words_of(text)
        words.append(END)
        place = self.place
        new = set(words).difference(place)
        if new:
            place.update(zip(new, range(len(place), len(place) + len(new))))
        self.docs.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
        self.ids.append(doc_id)
        self.held.append(held)
        self.size += len(text) + 1

    def row(self, name: int, sizes: Sizes) -> dict:
        hashes = np.fromiter(map(word_hash, self.place), np.uint64, len(self.place))
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        hashes = hashes[order]
        lengths = np.array([len(d) for d in self.docs])
        places = rank[np.concatenate(self.docs)]
        starts = np.cumsum(lengths) - lengths
        learned = np.repeat(~np.array(self.held), lengths)
        counts = np.bincount(places[learned], minlength=len(hashes))
        pairs, nth = np.unique(pair_keys(hashes[places], starts, sizes.pair_bits), return_inverse=True)
        pair_counts = np.bincount(nth[learned], minlength=len(pairs))
        observed = np.zeros((2 * sizes.rows, CLASSES), np.int64)
        bucket = bucket_of(hashes)
        for all_places, begin in _groups(places[learned], lengths[~np.array(self.held)]):
            observed += observed_counts(feature_rows(hashes[all_places], begin, sizes.rows), bucket[all_places], sizes.rows)
        return {"chunk": name, "ids": self.ids, "held": self.held, "sizes": pack(lengths), "places": pack(places), "hashes": pack_sorted(hashes),
                "counts": pack(counts), "observed": pack(observed.ravel()),
                "keys": _cut(0, hashes, counts, 64, sizes.range_bits) + _cut(1, pairs, pair_counts, sizes.pair_bits, sizes.range_bits)}


def _groups(values: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(values, starts of documents) of whole documents, about _GROUP values together; longer documents alone."""
    ends = np.cumsum(lengths)
    first, base = 0, 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(ends, base + _GROUP, side="right")))
        yield values[base : ends[last - 1]], ends[first:last] - lengths[first:last] - base
        first, base = last, int(ends[last - 1])


def write_chunks(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """One row a chunk, as in CHUNK. `docs` has doc_id and text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", (bucket_of_id(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held"), text_of(F.col("text")).cast("binary").alias("t"))

    def run(batches):
        part, nth, chunk, schema = TaskContext.get().partitionId(), 0, Chunk(), None

        def written():
            nonlocal nth, chunk
            row = pa.RecordBatch.from_pylist([chunk.row((part << 32) | nth, sizes)], schema=schema)
            nth, chunk = nth + 1, Chunk()
            return row

        for batch in batches:
            schema = schema or pa.schema([
                ("chunk", pa.int64()), ("ids", pa.list_(batch.schema.field(0).type)), ("held", pa.list_(pa.bool_())),
                *[(n, pa.binary()) for n in ("sizes", "places", "hashes", "counts", "observed")],
                ("keys", pa.list_(pa.struct([("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])))])
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                chunk.add(doc_id, held, text.as_py())
                if chunk.size >= CHUNK_BYTES:
                    yield written()
        if chunk.ids:
            yield written()

    return source.mapInArrow(run, CHUNK.format(id=id_type))


# ---- counts ----

def merge_range(table: pa.Table) -> pa.Table:
    """(kind, part, chunk, totals, stats): the entries of one range of all chunks, totals in each chunk's own order as what is to
    be added to its own counts; and with chunk null the training tokens and the words seen in training of each bucket."""
    kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    chunks = table.column("chunk").to_pylist()
    keys = [unpack_sorted(k.as_py()) for k in table.column("keys")]
    counts = [unpack(c.as_py()).astype(np.int64) for c in table.column("counts")]
    lengths = [len(k) for k in keys]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    begin = np.flatnonzero(first)
    own = np.concatenate(counts)
    total = np.add.reduceat(own[order], begin)
    more = np.empty(len(every), np.int64)
    more[order] = total[np.cumsum(first) - 1]
    more -= own
    rows = [(kind, part, c, pack(more[end - n : end]), None) for c, n, end in zip(chunks, lengths, np.cumsum(lengths))]
    if kind == 0:
        bucket = bucket_of(ordered[begin])
        rows.append((kind, part, None, None, np.concatenate([np.bincount(bucket, total, BUCKETS), np.bincount(bucket[total > 0], minlength=BUCKETS)]).astype(np.int64)))
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["kind", "part", "chunk", "totals", "stats"])


def count_all(chunks: DataFrame) -> DataFrame:
    entries = chunks.select("chunk", F.explode("keys").alias("k")).select("chunk", "k.*")
    return entries.groupBy("kind", "part").applyInArrow(merge_range, "kind int, part int, chunk bigint, totals binary, stats array<bigint>")


# ---- training ----

def _opened(ids_of: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    """(hashes, places, lengths, held) of the i-th chunk of a batch."""
    hashes = unpack_sorted(ids_of.column("hashes")[i].as_py())
    return (hashes, unpack(ids_of.column("places")[i].as_py()).astype(np.int64), unpack(ids_of.column("sizes")[i].as_py()).astype(np.int64),
            np.array(ids_of.column("held")[i].as_py(), bool))


def _summed(parts: DataFrame) -> np.ndarray:
    """The table of all tasks' rows (row, v0, v1, ...); it has as many rows as the two softmaxes."""
    names = parts.columns[1:]
    rows = parts.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    return rows.to_numpy()


def _table_rows(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    seen = np.flatnonzero(np.any(table, axis=1))
    for at in range(0, len(seen), 8192):
        rows = seen[at : at + 8192]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows)] + [pa.array(table[rows, k].astype(np.float32)) for k in range(CLASSES)], names=["row", *[f"v{k}" for k in range(CLASSES)]])


_TABLE = "row bigint, " + ", ".join(f"v{k} float" for k in range(CLASSES))


def _gathered(chunks: DataFrame, of_batch, sizes: Sizes) -> np.ndarray:
    """A table of 2 * rows by classes that tasks add up over their chunks."""
    def run(batches):
        total = np.zeros((2 * sizes.rows, CLASSES))
        for batch in batches:
            for i in range(batch.num_rows):
                of_batch(batch, i, total)
        yield from _table_rows(total)

    out = np.zeros((2 * sizes.rows, CLASSES))
    rows = _summed(chunks.mapInArrow(run, _TABLE))
    if len(rows):
        out[rows[:, 0].astype(np.int64)] = rows[:, 1:]
    return out


def train(chunks: DataFrame, tokens: np.ndarray, sizes: Sizes, updates: int = UPDATES) -> Model:
    """`tokens`: training tokens of each bucket. Every update is over all training documents."""
    def add_observed(batch, i, total):
        total += unpack(batch.column("observed")[i].as_py()).reshape(total.shape)

    observed = _gathered(chunks.select("observed"), add_observed, sizes)
    model = first_model(tokens, sizes.rows)
    model = update(model, observed, first_expected(model, observed))
    for _ in range(updates - 1):
        shared = chunks.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_ROWS

        def add_expected(batch, i, total, shared=shared):
            hashes, places, lengths, held = _opened(batch, i)
            learned, bucket = np.repeat(~held, lengths), bucket_of(hashes)
            for at, begin in _groups(places[learned], lengths[~held]):
                total += expected_counts(shared.value, feature_rows(hashes[at], begin, sizes.rows), bucket[at])

        expected = _gathered(chunks.select("hashes", "places", "sizes", "held"), add_expected, sizes)
        model = update(model, observed, expected)
        shared.unpersist()
    return model


# ---- scores ----

class Scorer:
    """Scores the documents of one chunk."""

    def __init__(self, model: Model, stats: np.ndarray, kappa: float):
        self.model, self.kappa = model, kappa
        self.tokens, self.distinct = stats
        self.all, self.kinds = int(self.tokens.sum()), int(self.distinct.sum())
        self.inside = self.tokens + SMOOTHING * (self.distinct + 1)

    def score(self, hashes, places, lengths, counts, pair_totals, pair_bits) -> tuple[np.ndarray, ...]:
        """(known tokens, base score, score) of each document; counts are totals over all chunks."""
        rows, bucket = len(self.model.w1), bucket_of(hashes)
        share = (counts + SMOOTHING) / self.inside[bucket]
        base = np.log10((counts + SMOOTHING) / (self.all + SMOOTHING * (self.kinds + 1)))
        starts = np.cumsum(lengths) - lengths
        _, nth = np.unique(pair_keys(hashes[places], starts, pair_bits), return_inverse=True)
        n = pair_totals[nth]
        # the beginning of a text occurs as often as its end
        ends = np.searchsorted(hashes, np.uint64(word_hash(END)))
        context = np.empty(len(places), np.int64)
        context[1:] = counts[places[:-1]]
        context[starts] = counts[ends]
        value, done = np.empty(len(places)), 0
        for at, begin in _groups(places, lengths):
            b = bucket[at]
            one, two = self.model.probabilities(feature_rows(hashes[at], begin, rows), b // CLASSES)
            i, part = np.arange(len(at)), slice(done, done + len(at))
            q = one[i, b // CLASSES].astype(float) * two[i, b % CLASSES] * share[at]
            seen = np.where(counts[at] > 0, n[part], 0)  # a pair of an unseen word has no count
            value[part] = np.log10((seen + self.kappa * q) / (context[part] + self.kappa))
            done += len(at)
        return (np.add.reduceat((counts[places] > 0).astype(np.int64), starts), np.add.reduceat(base[places], starts), np.add.reduceat(value, starts))


RESULT = "doc_id {id}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_documents(docs: DataFrame, updates: int = UPDATES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, in log10."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    text_bytes = docs.agg(F.sum(F.octet_length(text_of(F.col("text"))))).first()[0] or 0
    sizes = Sizes.of(text_bytes)
    chunks = staged(write_chunks(docs, sizes), "lm-chunks")
    totals = staged(count_all(chunks), "lm-totals")
    stats = np.zeros(2 * BUCKETS, np.int64)
    for r in totals.select(F.posexplode("stats").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():  # 2 * BUCKETS rows
        stats[r["at"]] = r["n"]
    stats = stats.reshape(2, BUCKETS)
    scorer = spark.sparkContext.broadcast(Scorer(train(chunks, stats[0], sizes, updates), stats, KAPPA))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = [left.schema.field("ids").type.value_type, pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2]
        out = []
        for batch in left.to_batches():
            for i in range(batch.num_rows):
                hashes, places, lengths, held = _opened(batch, i)
                more = sorted(zip(right.column("kind").to_pylist(), right.column("part").to_pylist(), right.column("totals").to_pylist()))
                words, pairs = (np.concatenate([unpack(t).astype(np.int64) for k, _, t in more if k == kind]) for kind in (0, 1))
                counts = unpack(batch.column("counts")[i].as_py()).astype(np.int64) + words
                learned = np.repeat(~held, lengths)
                starts = np.cumsum(lengths) - lengths
                _, nth = np.unique(pair_keys(hashes[places], starts, sizes.pair_bits), return_inverse=True)
                pairs = pairs + np.bincount(nth[learned], minlength=len(pairs))
                known, base, value = scorer.value.score(hashes, places, lengths, counts, pairs, sizes.pair_bits)
                ids = batch.column("ids")
                ids = ids.values.slice(ids.offsets[i].as_py(), len(lengths))
                columns = [ids, held, lengths, known, np.full(len(lengths), scorer.value.all), base, value]
                out.append(pa.table([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names=names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], k) for k in kinds], names=names)

    read = chunks.select("chunk", "ids", "held", "sizes", "places", "hashes", "counts")
    return read.groupBy("chunk").cogroup(totals.where("chunk is not null").select("chunk", "kind", "part", "totals").groupBy("chunk")).applyInArrow(
        score, RESULT.format(id=id_type))
