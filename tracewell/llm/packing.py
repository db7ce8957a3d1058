"""Best-fit packing planned on a histogram of lengths.

Documents become token pieces of at most `size` tokens. Only the counts per length (at most `size`
numbers) reach the driver, where best-fit decreasing runs over counts: bins alike in what they hold are
one group, so a step fills any number of them. The plan has rows "pieces of this length ranked lo to
hi go to these sequences", whose number depends on `size` alone. Every piece then gets its rank within
its length, from sorted salted groups whose counts are summed, and takes its slot by joining the plan.

Nulls: a null text is empty and gives one piece with the end token; null ids are kept and ordered first.
Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import small_batches, staged, text_of

SIZE = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
ROWS_PER_SALT = 1_000_000
LEAST_SALTS = 16
CACHE_WORDS = 400_000
_CHUNK = 200_000

# Words as the tokenizer's own splitting rule finds them, for text within Latin-1, whose letters, numbers
# and white space are written out.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t\n\x0b\x0c\r\x85\xa0"
_WORDS = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'(?:[sdmt]|ll|ve|re)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
# Characters whose class differs between libraries.
_UNSURE = re.compile("[\x1c-\x1f\x85\xa0]")
# The vocabulary writes bytes as letters: printable ones as themselves, the others as U+0100 on, in turn.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
_CUT = re.compile(rf"(?<=[^{_S}]) (?=[^{_S}])")


def _chunks(text: str) -> Iterator[str]:
    """The text in pieces cut before a single space, where a word always begins."""
    at = 0
    while len(text) - at > _CHUNK:
        cut = _CUT.search(text, at + _CHUNK)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class _Encoder:
    """Ids of a text as little-endian bytes. Words recur, so their ids are kept up to a bound."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # texts that hold one of these are left to the tokenizer as a whole
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.merge = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            plain = not _UNSURE.search(text) and not self.added.search(text)
        except UnicodeEncodeError:
            plain = False
        if not plain:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for chunk in _chunks(text):
            words = _WORDS.findall(chunk)
            new = list(set(words).difference(self.known))
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known.clear()
                new = list(set(words))
            for word in new:
                letters = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
                self.known[word] = array("I", [t.id for t in self.merge(letters)]).tobytes()
            out.append(b"".join(map(self.known.__getitem__, words)))
        return b"".join(out)


@cache
def _encoder(name: str) -> _Encoder:
    """One for each Python worker, with what it has learned in earlier tasks."""
    return _Encoder(_tokenizer_path(name))


def _tokenizer_path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, size: int = SIZE, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document with its end token.

    `tokenizer` is the name of a vocabulary file of the tokenizers package or a path. A document longer
    than `size` is cut so that all pieces but the first are full.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def run(batches):
        encoder = _encoder(tokenizer)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            out: list[list] = [[] for _ in range(5 + with_ids)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py()) + end
                n, start = len(ids) // 4, 0
                piece = 0
                while start < n:
                    length = (n - start) % size or size
                    part = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, piece, start, length, zlib.crc32(part)) + ((part,) if with_ids else ())
                    for column, value in zip(out, row):
                        column.append(value)
                    piece, start = piece + 1, start + length
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    return docs.select("doc_id", text_of(F.col("text")).alias("text")).mapInArrow(run, schema)


def best_fit_plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, lo, hi, first_sequence, per_sequence, offset).

    Pieces of that length with rank lo to hi - 1 fill sequences from `first_sequence` on, `per_sequence`
    in each, from `offset`. Equal to best fit piece by piece: once a piece is placed, its bin is
    the tightest one for the next piece of that length as long as one fits.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> groups of (first sequence, sequences)
    following = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if length > size or length < 1:
            raise ValueError(f"a piece of {length} tokens does not fit {size}")

        def place(first: int, bins: int, per: int, free: int, length: int = length) -> None:
            nonlocal left, rank
            plan.append((length, rank, rank + bins * per, first, per, size - free))
            rank, left = rank + bins * per, left - bins * per
            if free > per * length:
                room.setdefault(free - per * length, []).append((first, bins))

        def fill(first: int, n: int, free: int, length: int = length) -> int:
            """Put pieces into n like bins, as many as fit into each; returns how many bins were used."""
            each = free // length
            whole = min(n, left // each)
            if whole:
                place(first, whole, each, free)
            if left and whole < n:  # fewer left than one bin takes
                place(first + whole, 1, left, free)
                whole += 1
            return whole

        for free in sorted(f for f in room if f >= length):
            groups, room[free] = room[free], []
            for first, n in groups:
                used = fill(first, n, free) if left else 0
                if used < n:
                    room[free].append((first + used, n - used))
            if not room[free]:
                del room[free]
        if left:
            bins = -(-left // (size // length))
            fill(following, bins, size)
            following += bins
    return plan


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to a table with doc_id, piece, start and length.

    The table is read several times, so hand over a written one.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(
        best_fit_plan(counts, size), "length bigint, lo bigint, hi bigint, first_seq bigint, per_seq bigint, at bigint")
    salts = LEAST_SALTS + sum(counts.values()) // ROWS_PER_SALT
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    group = Window.partitionBy("length", "salt")
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select(
        "length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(group.orderBy("doc_id", "start", *[c for c in pieces.columns if c == "ids_crc32"])) - 1
    ranked = salted.withColumn("inside", inside).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("inside"))
    placed = ranked.join(F.broadcast(plan), "length").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        *pieces.columns,
        (F.col("first_seq") + F.floor(nth / F.col("per_seq"))).cast("long").alias("sequence_id"),
        (F.col("at") + nth % F.col("per_seq") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, size: int = SIZE, tokenizer: str = TOKENIZER) -> DataFrame:
    """Tokenize once, write the pieces, and pack them."""
    return pack(staged(token_pieces(docs, size, tokenizer), "token-pieces"), size)
