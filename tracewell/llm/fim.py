"""Fill-in-the-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of at most FRAME_BYTES bytes, cut between characters, with
the units, code points, bytes and stored bytes before each frame. A unit is a run of letters A-Z and a-z, or any
one other code point, and belongs to the frame that holds its beginning. Cutting a text after so many
units looks up one frame and decompresses that one only; all other frames enter the output as they
are. The output is such a store as well, and digests stream its frames one after another.

The cuts and the form of a document come from the sha256 of the seed and its id, so they do not depend on
where or when it is processed.

Nulls: a null text is empty, hence plain; a null id hashes as the empty text. Repeated rows are transformed
alike. An empty table gives an empty result. Columns beyond id and text are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import small_batches, staged, text_of

FRAME_BYTES = 1 << 16
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = "1"
TRANSFORMED, SUFFIX_FIRST = 90, 20  # percent of the documents, and percent of those
_LONGS = pa.list_(pa.int64())
STORE = "units array<bigint>, chars array<bigint>, bytes array<bigint>, places array<bigint>, frames binary"
_OUT_ROWS = 256  # rows of a batch that leaves a task

# bytes that go on with a character, letters, and first bytes of other characters
_KIND = np.full(256, 2, np.uint8)
_KIND[0x80:0xC0] = 0
_KIND[ord("A") : ord("Z") + 1] = _KIND[ord("a") : ord("z") + 1] = 1


def unit_starts(raw: bytes, joined: bool) -> np.ndarray:
    """Places in UTF-8 bytes where units begin; `joined`: the letter before them is of the same run."""
    kind = _KIND[np.frombuffer(raw, np.uint8)]
    letter = kind == 1
    starts = kind == 2
    starts[1:] |= letter[1:] & ~letter[:-1]
    if len(raw) and letter[0] and not joined:
        starts[0] = True
    return np.flatnonzero(starts)


def count_chars(raw: bytes) -> int:
    return int(np.count_nonzero(_KIND[np.frombuffer(raw, np.uint8)]))


class Writer:
    """Frames and what stands before each of them."""

    def __init__(self, compressor):
        self.compress = compressor.compress
        self.units, self.chars, self.bytes, self.places = [0], [0], [0], [0]
        self.frames: list[bytes] = []
        self.open: list[bytes] = []
        self.size = 0
        self.letter = False  # whether the last byte written is one

    def add(self, raw: bytes, joined: bool | None = None) -> None:
        """At most FRAME_BYTES that no frame may cut apart; `joined`: after a frame taken over, whether a run of letters goes on."""
        if self.size + len(raw) > FRAME_BYTES:
            self.flush()
        if not self.open and joined is not None:
            self.letter = joined
        self.open.append(raw)
        self.size += len(raw)

    def add_text(self, raw: bytes) -> None:
        at = 0
        while at < len(raw):
            end = min(at + FRAME_BYTES, len(raw))
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end -= 1
            self.add(raw[at:end])
            at = end

    def add_frame(self, store: Store, nth: int) -> None:
        """A whole frame of another text as it is, after the frame before it or a cut."""
        self.flush()
        n = nth + 1
        self._put(store.units[n] - store.units[nth], store.chars[n] - store.chars[nth], store.bytes[n] - store.bytes[nth], store.stored(nth))

    def flush(self) -> None:
        if self.size:
            raw = b"".join(self.open)
            self.open, self.size = [], 0
            self._put(len(unit_starts(raw, self.letter)), count_chars(raw), len(raw), self.compress(raw))
            self.letter = _KIND[raw[-1]] == 1

    def _put(self, units: int, chars: int, size: int, stored: bytes) -> None:
        self.frames.append(stored)
        for column, n in ((self.units, units), (self.chars, chars), (self.bytes, size), (self.places, len(stored))):
            column.append(column[-1] + n)

    def row(self) -> tuple:
        self.flush()
        return self.units, self.chars, self.bytes, self.places, b"".join(self.frames)


class Store:
    """Reads the frames of one text."""

    def __init__(self, decompressor, units, chars, sizes, places, frames):
        self.decompress = decompressor.decompress
        self.units, self.chars, self.bytes, self.places, self.frames = units, chars, sizes, places, memoryview(frames)
        self.held: dict[int, bytes] = {}  # the two frames read last: those of both cuts

    def stored(self, nth: int) -> bytes:
        return bytes(self.frames[self.places[nth] : self.places[nth + 1]])

    def frame(self, nth: int) -> bytes:
        if nth not in self.held:
            self.held = dict([*self.held.items()][-1:])
            self.held[nth] = self.decompress(self.stored(nth))
        return self.held[nth]

    def cut(self, units: int) -> tuple[int, int]:
        """(byte, code point) where the text stands after so many units."""
        if units >= self.units[-1]:
            return self.bytes[-1], self.chars[-1]
        nth = bisect_right(self.units, units) - 1
        raw = self.frame(nth)
        at = int(unit_starts(raw, self.joined(nth))[units - self.units[nth]])
        return self.bytes[nth] + at, self.chars[nth] + count_chars(raw[:at])

    def joined(self, nth: int) -> bool:
        """Whether the frame begins inside a run of letters: it has a unit less than its bytes alone show."""
        return len(unit_starts(self.frame(nth), False)) > self.units[nth + 1] - self.units[nth]

    def pieces(self, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(frame, first byte, last byte) of the bytes from `begin` to `end`, one for each frame."""
        nth = bisect_right(self.bytes, begin) - 1
        while begin < end:
            first, stop = self.bytes[nth], min(end, self.bytes[nth + 1])
            yield nth, begin - first, stop - first
            begin, nth = stop, nth + 1

    def read(self, begin: int, end: int) -> Iterator[bytes]:
        for nth, first, last in self.pieces(begin, end):
            yield self.frame(nth)[first:last]

    def find(self, mark: bytes, begin: int) -> int:
        """The first place of the mark at or after `begin`."""
        at, tail = begin, b""
        for raw in self.read(begin, self.bytes[-1]):
            found = (tail + raw).find(mark)
            if found >= 0:
                return at - len(tail) + found
            at += len(raw)
            tail = (tail + raw)[1 - len(mark) :]
        raise ValueError(f"no {mark!r} in a transformed text")


@dataclass(frozen=True)
class Plan:
    """What the id decides: cuts in units and the form."""

    first: int
    second: int
    form: str


def plan(doc_id, n: int, marked: bool, seed: str = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> Plan:
    name = "" if doc_id is None else str(doc_id)
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "plain" if marked or n == 0 or h3 % 100 >= transformed else "spm" if h4 % 100 < suffix_first else "psm"
    return Plan(*cuts, form)


def transform(store: Store, p: Plan, out: Writer) -> tuple[int, int] | None:
    """Writes the transformed text; code points of prefix and middle, or None for a plain text."""
    end = store.bytes[-1]

    def copy(begin: int, stop: int) -> None:
        for nth, first, last in store.pieces(begin, stop):
            # frames without a cut are taken over; a text of one frame becomes one frame again
            if len(store.bytes) > 2 and last - first == store.bytes[nth + 1] - store.bytes[nth]:
                out.add_frame(store, nth)
            else:
                out.add(store.frame(nth)[first:last], first == 0 and store.joined(nth))

    if p.form == "plain":
        copy(0, end)
        return None
    (a, a_chars), (b, b_chars) = store.cut(p.first), store.cut(p.second)
    parts = [(PREFIX, 0, a), (SUFFIX, b, end)]
    for mark, begin, stop in (parts if p.form == "psm" else parts[::-1]) + [(MIDDLE, a, b)]:
        out.add(mark)
        copy(begin, stop)
    return a_chars, b_chars - a_chars


def restore(output: Store, form: str) -> Iterator[bytes]:
    """The text in pieces, from the transformed text and its form alone."""
    ranges = [(0, output.bytes[-1])]
    if form != "plain":
        first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
        one = output.find(first, 0)
        two = output.find(second, one + 3)
        three = output.find(MIDDLE, two + 3)
        bodies = {first: (one + 3, two), second: (two + 3, three), MIDDLE: (three + 3, output.bytes[-1])}
        ranges = [bodies[PREFIX], bodies[MIDDLE], bodies[SUFFIX]]
    for begin, end in ranges:
        yield from output.read(begin, end)


def _batches(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _OUT_ROWS:
            yield _batch(held, fields)
            held = []
    if held:
        yield _batch(held, fields)


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


_STORE_FIELDS = [("units", _LONGS), ("chars", _LONGS), ("bytes", _LONGS), ("places", _LONGS), ("frames", pa.binary())]


def write_frames(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, marked, units, chars, bytes, places, frames): every text as frames; the four lists have what stands
    before each frame and, last, the totals. `marked`: the text holds a mark of the transformation itself."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        import zstandard

        compressor = zstandard.ZstdCompressor(level=3)

        def rows(batch):
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = body.as_py()
                out = Writer(compressor)
                out.add_text(body)
                yield (key, any(mark in body for mark in (PREFIX, SUFFIX, MIDDLE)), *out.row())

        for batch in batches:
            yield from _batches(rows(batch), [("doc_id", batch.schema.field(0).type), ("marked", pa.bool_()), *_STORE_FIELDS])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(F.col(f"`{text}`")).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"doc_id {id_type}, marked boolean, {STORE}")


def fill_in_middle(stored: DataFrame, seed: str = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, units, chars, bytes, places, frames): the transformed texts of
    a table of `write_frames`, as frames again."""
    id_type = stored.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import zstandard

        compressor, decompressor = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()

        def rows(batch):
            for key, marked, *lists, frames in zip(*[c.to_pylist() for c in batch.columns]):
                store, out = Store(decompressor, *lists, frames), Writer(compressor)
                n = store.units[-1]
                p = plan(key, n, marked, seed, transformed, suffix_first)
                sizes = transform(store, p, out) or (None, None)
                yield (key, n, p.form, *sizes, *out.row())

        fields = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), *_STORE_FIELDS]
        for batch in batches:
            yield from _batches(rows(batch), [("doc_id", batch.schema.field(0).type), *fields])

    return stored.mapInArrow(run, f"doc_id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint, {STORE}")


def fim_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The transformed texts of all documents; their frames are written to the shared folder first."""
    return fill_in_middle(staged(write_frames(docs, doc_id, text), "fim-frames"), **how)


def digests(transformed: DataFrame) -> DataFrame:
    """One row per document: digests of the transformed text and of the text restored from it, frame by frame."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in transformed.select(names).schema)

    def run(batches):
        import zstandard

        decompressor = zstandard.ZstdDecompressor()
        for batch in batches:
            found = [[], []]
            for form, *lists, frames in zip(*[batch.column(c).to_pylist() for c in ("form", "units", "chars", "bytes", "places", "frames")]):
                store, whole, restored = Store(decompressor, *lists, frames), hashlib.sha256(), hashlib.sha256()
                for raw in store.read(0, store.bytes[-1]):
                    whole.update(raw)
                for raw in restore(store, form):
                    restored.update(raw)
                found[0].append(whole.hexdigest())
                found[1].append(restored.hexdigest())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *map(pa.array, found)], names=[*names, "output_sha256", "restored_sha256"])

    return transformed.mapInArrow(run, f"{schema}, output_sha256 string, restored_sha256 string")


def fim_report(docs: DataFrame) -> DataFrame:
    return digests(fim_documents(docs))
