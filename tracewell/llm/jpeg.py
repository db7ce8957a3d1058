"""Media columns: baseline JPEG written and read with numpy.

`write_media` stores bytes as grey images: every sample is the constant value of one 8x8 block, so the
block is its DC coefficient alone and nothing is lost. Restart markers stand after each 64 blocks.
`read_media` reads any baseline JPEG (one scan, up to four components, any Huffman tables, with or
without restart markers): it parses markers, decodes the scan, skips AC coefficients, and rebuilds the
luminance thumbnail of one pixel a block from the DC coefficients. All restart intervals of a batch are
decoded side by side, one block of each at a time.

Nulls: a null text is empty and gives one block row of zeros; null media and media that are no baseline
JPEG give null results. A payload beyond one image's size goes to several images, one after another.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import small_batches, text_of

ROW = 64  # samples a block row, and blocks between restart markers
IMAGE_SAMPLES = ROW * 8191  # JPEG sides end at 65535 pixels
_GROUP = 1 << 20  # samples handled together

# Huffman code lengths of the DC size categories 0 to 8 (the all-ones code stays free), and the one AC code, end of block.
DC_LENGTHS = [4, 4, 4, 3, 3, 3, 3, 3, 4]
AC_LENGTHS = {0: 1}


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol -> (code, length)."""
    code, last, out = 0, 0, {}
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[symbol], code, last = (code, n), code + 1, n
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _dht(kind: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths.items(), key=lambda x: (x[1], x[0]))
    return bytes([kind]) + bytes(sum(n == i for _, n in order) for i in range(1, 17)) + bytes(s for s, _ in order)


@cache
def _header(rows: int) -> bytes:
    size = (8 * rows).to_bytes(2, "big") + (8 * ROW).to_bytes(2, "big")
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, bytes([0]) + bytes([8]) * 64),
        _segment(0xC0, b"\x08" + size + b"\x01\x01\x11\x00"),
        _segment(0xC4, _dht(0x00, dict(enumerate(DC_LENGTHS))) + _dht(0x10, AC_LENGTHS)),
        _segment(0xDD, ROW.to_bytes(2, "big")),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


_CATEGORY = np.array([int(i).bit_length() for i in range(256)], np.int32)
_DC = _codes(dict(enumerate(DC_LENGTHS)))
_DC_CODE = np.array([_DC[i][0] for i in range(9)], np.int32)
_DC_SIZE = np.array([_DC[i][1] for i in range(9)], np.int32)


def encode_images(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload; lengths are positive multiples of 64, up to IMAGE_SAMPLES."""
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW).astype(np.int32) - 128
    diff = np.diff(samples, axis=1, prepend=0)
    size = _CATEGORY[np.abs(diff)]
    bits = np.where(diff < 0, diff + (1 << size) - 1, diff)
    code = (((_DC_CODE[size] << size) | bits) << 1).ravel()  # the last 0 ends the block
    length = _DC_SIZE[size] + size + 1
    ends = np.cumsum(length, axis=1)
    row_bytes = (ends[:, -1] + 7) // 8
    row_at = np.cumsum(row_bytes) - row_bytes
    total = int(row_bytes.sum())
    at = (ends - length + 8 * row_at[:, None]).ravel()
    window = code << (24 - (at & 7) - length.ravel())
    first = at >> 3
    data = sum(np.bincount(first + k, (window >> (16 - 8 * k)) & 255, total + 3)[: total + 3] for k in range(3))[:total].astype(np.uint8)
    data[row_at + row_bytes - 1] |= ((1 << (-ends[:, -1] % 8)) - 1).astype(np.uint8)
    # zero bytes after 0xFF, and two marker bytes after each row
    stuffed = data == 255
    row = np.repeat(np.arange(len(row_bytes)), row_bytes)
    place = np.arange(total) + np.cumsum(stuffed) - stuffed + 2 * row
    out = np.zeros(total + int(stuffed.sum()) + 2 * len(row_bytes), np.uint8)
    out[place] = data
    last = row_at + row_bytes - 1
    marker = place[last] + 1 + stuffed[last]
    rows = np.array([len(p) // ROW for p in payloads])
    begin = np.cumsum(rows) - rows
    within = np.arange(len(row_bytes)) - np.repeat(begin, rows)
    out[marker], out[marker + 1] = 0xFF, 0xD0 + within % 8
    final = begin + rows - 1
    out[marker[final] + 1] = 0xD9
    stops = marker[final] + 2
    starts = np.concatenate([[0], stops[:-1]])
    blob = out.tobytes()
    return [_header(int(n)) + blob[a:b] for n, a, b in zip(rows, starts, stops)]


def encode_media(payload: bytes) -> list[bytes]:
    """The parts of a payload that become one image each."""
    return [payload[i : i + IMAGE_SAMPLES] for i in range(0, len(payload), IMAGE_SAMPLES)]


# ---- reading ----

@cache
def _lookup(table: bytes) -> np.ndarray:
    """For the next 16 bits: code length << 8 | symbol; 0 where no code fits."""
    out, code, at = np.zeros(65536, np.uint16), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


class NotBaseline(ValueError):
    """The bytes are no baseline JPEG with one scan."""


class Frame:
    """What the markers of one image say."""

    def __init__(self, data: bytes, at: int):
        if data[at : at + 2] != b"\xff\xd8":
            raise NotBaseline("no start of image")
        quant, tables, self.interval, self.components = {}, {}, 0, []
        at += 2
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 4 > len(data) or data[at] != 0xFF:
                raise NotBaseline("marker expected")
            kind, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = bytes(body[1 : 17 + n])
                    body = body[17 + n :]
            elif kind == 0xC0:
                if body[0] != 8:
                    raise NotBaseline("8 bits expected")
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            elif 0xC1 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
                raise NotBaseline("another coding process")
            elif kind == 0xDD:
                self.interval = int.from_bytes(body[:2], "big")
            elif kind == 0xDA:
                break
        if not self.components or not self.width or not self.height or body[0] != len(self.components):
            raise NotBaseline("one scan with all components expected")
        chosen = {body[i]: body[i + 1] for i in range(1, 1 + 2 * body[0], 2)}
        try:
            coders = [(_lookup(tables[chosen[c] >> 4]), _lookup(tables[0x10 | chosen[c] & 15])) for c, *_ in self.components]
            self.scale = quant[self.components[0][3]]
        except KeyError as e:
            raise NotBaseline("a table is missing") from e
        self.h, self.v = (self.components[0][1:3] if len(self.components) > 1 else (1, 1))
        across = max(h for _, h, _, _ in self.components) if len(self.components) > 1 else 1
        down = max(v for _, _, v, _ in self.components) if len(self.components) > 1 else 1
        self.mcus_x, self.mcus_y = -(-self.width // (8 * across)), -(-self.height // (8 * down))
        # coders and component of every block of an MCU
        self.blocks = [(i, *coders[i]) for i, (_, h, v, _) in enumerate(self.components)
                       for _ in range(h * v if len(self.components) > 1 else 1)]
        self.scan_at = at
        # the luminance plane is cropped to the image
        self.thumb_w = -(-self.width * self.h // (8 * across))
        self.thumb_h = -(-self.height * self.v // (8 * down))

    def thumbnail(self, dc: np.ndarray) -> np.ndarray:
        """One luminance pixel a block, from its DC coefficients in MCU order."""
        grid = dc.reshape(self.mcus_y, self.mcus_x, self.v, self.h).transpose(0, 2, 1, 3)
        grid = grid.reshape(self.mcus_y * self.v, self.mcus_x * self.h)[: self.thumb_h, : self.thumb_w]
        return np.clip((grid * self.scale + 4) // 8 + 128, 0, 255).astype(np.uint8)


def _scan(data: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Coded bytes without stuffing, where each restart interval starts in them, and where the scan ends."""
    rest = data[at:]
    escape = np.flatnonzero(rest[:-1] == 0xFF)
    follow = rest[escape + 1]
    restart = (follow & 0xF8) == 0xD0
    other = np.flatnonzero((follow != 0) & ~restart & (follow != 0xFF))
    end = int(escape[other[0]]) if len(other) else len(rest)
    stuffed, marks = escape[follow == 0], escape[restart]
    keep = np.ones(end, bool)
    keep[stuffed[stuffed + 1 < end] + 1] = False
    marks = marks[marks < end]
    keep[marks] = False
    keep[marks + 1] = False
    before = np.cumsum(keep)
    return rest[:end][keep], np.concatenate([[0], before[marks]]), at + end


def decode_images(media: list[bytes]) -> list[tuple[list[Frame], list[np.ndarray]] | None]:
    """For each media value its frames and luminance thumbnails; None where it is no baseline JPEG."""
    frames: list[list[Frame] | None] = []
    lanes: dict[tuple, list] = {}  # by coders of the blocks: (image, first MCU, MCUs, byte where it starts)
    images, parts, size = [], [], 0
    for blob in media:
        own: list[Frame] = []
        try:
            data, at = np.frombuffer(blob, np.uint8), 0
            while at < len(blob):
                frame = Frame(blob, at)
                coded, starts, end = _scan(data, frame.scan_at)
                per = frame.interval or frame.mcus_x * frame.mcus_y
                n = frame.mcus_x * frame.mcus_y
                if len(starts) < -(-n // per):
                    raise NotBaseline("restart intervals are missing")
                key = tuple((c, id(d), id(a)) for c, d, a in frame.blocks)
                lanes.setdefault(key, []).extend(
                    (len(images) + len(own), m * per, min(per, n - m * per), size + int(starts[m])) for m in range(-(-n // per)))
                own.append(frame)
                parts.append(coded)
                size += len(coded)
                at = end + 2 if blob[end : end + 2] == b"\xff\xd9" else len(blob)
        except (NotBaseline, IndexError):
            lanes = {k: [x for x in v if x[0] < len(images)] for k, v in lanes.items()}
            own = []
        frames.append(own or None)
        images += own
    stream = np.concatenate([*parts, np.full(64, 255, np.uint8)])
    # luminance blocks of all images in one array
    counts = [f.mcus_x * f.mcus_y * f.h * f.v for f in images]
    offset = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    dc = np.zeros(offset[-1], np.int32)
    for rows in lanes.values():
        if rows:
            table = np.array(rows, np.int64)
            _decode_lanes(stream, images[rows[0][0]].blocks, table, dc, offset[table[:, 0]])
    out, i = [], 0
    for own in frames:
        n = len(own or [])
        out.append((own, [f.thumbnail(dc[offset[k] : offset[k + 1]]) for k, f in enumerate(own, i)]) if own else None)
        i += n
    return out


def _decode_lanes(stream: np.ndarray, blocks: list, table: np.ndarray, dc: np.ndarray, base: np.ndarray) -> None:
    """Decode intervals with the same coders side by side; writes luminance DC values into `dc`."""
    order = np.argsort(-table[:, 2], kind="stable")
    table, base = table[order], base[order]
    mcus, bit = table[:, 2], table[:, 3] * 8
    luma = sum(c == 0 for c, _, _ in blocks)
    limit = 8 * (len(stream) - 8)
    wide = stream.astype(np.uint32)
    wide = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]  # 24 bits from each byte on
    last = {c: np.zeros(len(table), np.int32) for c, _, _ in blocks}

    def peek(pos):
        return (wide[pos >> 3] >> (8 - (pos & 7)).astype(np.uint32)) & 0xFFFF

    for mcu in range(int(mcus[0])):
        active = int(np.searchsorted(-mcus, -mcu, "left"))  # lanes are sorted, the longest first
        pos, nth = bit[:active], 0
        for component, dc_coder, ac_coder in blocks:
            found = dc_coder[peek(pos)]
            pos = pos + (found >> 8)
            n = (found & 255).astype(np.int64)
            bits = (peek(pos) >> (16 - n).astype(np.uint32)).astype(np.int32)
            pos = np.minimum(pos + n, limit)
            last[component][:active] += np.where((n > 0) & (bits < (1 << np.maximum(n - 1, 0))), bits - (1 << n) + 1, bits).astype(np.int32)
            if component == 0:
                dc[base[:active] + (table[:active, 1] + mcu) * luma + nth] = last[0][:active]
                nth += 1
            # pass over the AC coefficients up to the end of the block
            lanes, at, place = None, pos, np.ones(active, np.int64)
            while len(at):
                found = ac_coder[peek(at)]
                symbol = (found & 255).astype(np.int64)
                at = np.minimum(at + (found >> 8) + (symbol & 15), limit)
                place = place + (symbol >> 4) + 1
                more = (symbol != 0) & (place < 64) & (found != 0)
                if lanes is None:
                    pos = at
                    lanes = np.flatnonzero(more)
                else:
                    pos[lanes] = at
                    lanes = lanes[more]
                at, place = at[more], place[more]
        bit[:active] = pos


def thumbnail_hash(pixels: np.ndarray) -> str:
    """Average hash and difference hash of an 8x8 reduction, as hex."""
    h, w = pixels.shape
    rows, cols = np.arange(8) * h // 8, np.arange(9) * w // 9
    sums = np.cumsum(np.cumsum(pixels.astype(np.int64), 0), 1)
    sums = np.pad(sums, ((1, 0), (1, 0)))
    r_end, c_end = np.maximum(rows + 1, (np.arange(8) + 1) * h // 8), np.maximum(cols + 1, (np.arange(9) + 1) * w // 9)
    area = (r_end - rows)[:, None] * (c_end - cols)[None, :]
    mean = (sums[r_end][:, c_end] - sums[rows][:, c_end] - sums[r_end][:, cols] + sums[rows][:, cols]) / area
    average, steps = mean[:, :8] > mean[:, :8].mean(), mean[:, 1:] > mean[:, :-1]
    return np.packbits(average).tobytes().hex() + ":" + np.packbits(steps).tobytes().hex()


# ---- Spark ----

def _grouped(values: list[bytes]) -> list[list[int]]:
    """Places of values, together at most about _GROUP bytes a group."""
    out, size = [[]], 0
    for i, v in enumerate(values):
        if size and size + len(v) > _GROUP:
            out.append([])
            size = 0
        out[-1].append(i)
        size += len(v)
    return out


def write_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): the UTF-8 bytes, zero-padded to a positive multiple of 64, as JPEG."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            parts = [p for t in texts for p in encode_media(t + b"\0" * (-len(t) % ROW or ROW * (not t)))]
            images: list[bytes] = []
            for group in _grouped(parts):
                images += encode_images([parts[i] for i in group]) if group else []
            media, at = [], 0
            for t in texts:
                n = -(-max(len(t), 1) // IMAGE_SAMPLES)
                media.append(b"".join(images[at : at + n]))
                at += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["key", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(f"`{key}`").alias("key"), text_of(F.col(f"`{text}`")).cast("binary").alias("t")).mapInArrow(
        run, f"key {kind}, n_bytes bigint, media binary")
    return out.withColumnRenamed("key", key)


def read_media(media: DataFrame, column: str = "media") -> DataFrame:
    """Adds width, height, thumbnails (luminance pixels of all images in turn) and feature to the table."""
    small_batches(media.sparkSession)
    kept = [c for c in media.columns if c not in ("width", "height", "thumbnails", "feature")]
    names = [*kept, "width", "height", "thumbnails", "feature"]

    def run(batches):
        for batch in batches:
            blobs = [x.as_py() for x in batch.column(kept.index(column))]
            rows: list[tuple] = []
            for group in _grouped([b or b"" for b in blobs]):
                for found in decode_images([blobs[i] or b"" for i in group]) if group else []:
                    if found is None:
                        rows.append((None, None, None, None))
                        continue
                    frames, thumbs = found
                    height = sum(f.height for f in frames)
                    rows.append((frames[0].width, height, b"".join(t.tobytes() for t in thumbs),
                                 f"{len(frames)}:{frames[0].width}x{height}:{'+'.join(thumbnail_hash(t) for t in thumbs)}"))
            added = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.int64(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)

    schema = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in kept)
    return media.select(*[f"`{c}`" for c in kept]).mapInArrow(run, f"{schema}, width bigint, height bigint, thumbnails binary, feature string")


def media_report(docs: DataFrame) -> DataFrame:
    """Digests of what was stored and of what reading it back gives."""
    read = read_media(write_media(docs))
    payload = F.col("thumbnails")
    return read.select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(thumbnails, -64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature")
