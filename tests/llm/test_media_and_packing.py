import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import brute
from tests.llm.conftest import EDGE_TEXTS
from tracewell.llm import jpeg, packing

# ---- JPEG ----


def _payload(text):
    b = (text or "").encode()
    return b + b"\0" * (-len(b) % 64 or 64 * (not b))


def test_payload_comes_back(edge_docs):
    rows = jpeg.media_report(edge_docs).collect()
    want = sorted((len((t or "").encode()), brute.sha(_payload(t)), zlib.crc32(_payload(t)[-64:])) for _, t in EDGE_TEXTS)
    assert sorted((r.n_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in rows}) == len({r.payload_sha256 for r in rows})


def test_no_rows(no_docs):
    assert jpeg.media_report(no_docs).collect() == []


def test_several_images_for_a_large_payload():
    payload = np.random.default_rng(1).integers(0, 256, jpeg.IMAGE_SAMPLES + 640, dtype=np.uint8).tobytes()
    parts = jpeg.encode_media(payload)
    frames, thumbs = jpeg.decode_images([b"".join(jpeg.encode_images(parts))])[0]
    assert len(frames) == 2 and b"".join(t.tobytes() for t in thumbs) == payload
    assert (frames[0].width, frames[0].height) == (512, 8 * 8191)


def test_the_feature_covers_every_image(spark):
    start = "a" * jpeg.IMAGE_SAMPLES
    df = spark.createDataFrame([(0, start + "b" * 64 + "z" * 640), (1, start + "z" * 640 + "b" * 64)], "doc_id long, text string")
    features = [r.feature for r in jpeg.media_report(df).collect()]
    assert len(set(features)) == 2 and all(f.startswith(f"2:512x{8 * 8191 + 88}:") for f in features)


class _Bits:
    def __init__(self):
        self.bits = ""

    def put(self, code, n):
        self.bits += format(code, f"0{n}b") if n else ""

    def bytes(self):
        self.bits += "1" * (-len(self.bits) % 8)
        return b"".join(bytes([int(self.bits[i:i + 8], 2)]) + (b"\0" if self.bits[i:i + 8] == "1" * 8 else b"") for i in range(0, len(self.bits), 8))


def _color_jpeg(rng, across=3, down=2, interval=0):
    """A 4:2:0 image with AC coefficients, written one symbol at a time."""
    dc = jpeg._codes({0: 2, 1: 3, 2: 3, 3: 3, 4: 3, 5: 3, 6: 4, 7: 5, 8: 6})
    ac = jpeg._codes({0x00: 2, 0x01: 2, 0x02: 3, 0x11: 4, 0xF0: 5, 0x23: 6})
    luma = np.zeros((2 * down, 2 * across), int)
    parts, out, last = [], _Bits(), [0, 0, 0]

    def block(c, value):
        diff = value - last[c]
        last[c] = value
        n = abs(diff).bit_length()
        out.put(*dc[n])
        out.put(diff if diff >= 0 else diff + (1 << n) - 1, n)
        place = 1
        for _ in range(rng.randrange(4)):
            symbol = rng.choice([0x01, 0x02, 0x11, 0xF0, 0x23])
            step = 16 if symbol == 0xF0 else (symbol >> 4) + 1
            if place + step > 63:
                break
            out.put(*ac[symbol])
            out.put(rng.getrandbits(symbol & 15) if symbol & 15 else 0, symbol & 15)
            place += step
        out.put(*ac[0])

    mcus = [(y, x) for y in range(down) for x in range(across)]
    for i, (y, x) in enumerate(mcus):
        if interval and i and i % interval == 0:
            parts.append(out.bytes() + bytes([0xFF, 0xD0 + (i // interval - 1) % 8]))
            out, last[:] = _Bits(), [0, 0, 0]
        for v in range(2):
            for h in range(2):
                luma[2 * y + v, 2 * x + h] = rng.randrange(-100, 100)
                block(0, int(luma[2 * y + v, 2 * x + h]))
        block(1, rng.randrange(-50, 50))
        block(2, rng.randrange(-50, 50))
    scan = b"".join(parts) + out.bytes()
    lengths = {k: n for k, (_, n) in dc.items()}, {k: n for k, (_, n) in ac.items()}
    size = (16 * down - 3).to_bytes(2, "big") + (16 * across - 9).to_bytes(2, "big")
    head = b"\xff\xd8" + jpeg._segment(0xE0, b"JFIF\0") + jpeg._segment(0xDB, b"\0" + bytes([6]) + b"\1" * 63)
    head += jpeg._segment(0xC0, b"\x08" + size + b"\x03\x01\x22\0\x02\x11\0\x03\x11\0")
    head += jpeg._segment(0xC4, jpeg._dht(0, lengths[0])) + jpeg._segment(0xC4, jpeg._dht(0x10, lengths[1]))
    head += jpeg._segment(0xDD, interval.to_bytes(2, "big")) if interval else b""
    head += jpeg._segment(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0")
    return head + scan + b"\xff\xd9", luma


@pytest.mark.parametrize("interval", [0, 2])
def test_subsampled_color_with_ac_coefficients(interval):
    rng = random.Random(interval)
    images = [_color_jpeg(rng, rng.randrange(1, 5), rng.randrange(1, 4), interval) for _ in range(20)]
    for (blob, luma), found in zip(images, jpeg.decode_images([b for b, _ in images])):
        frames, (thumb,) = found
        want = np.clip((luma * 6 + 4) // 8 + 128, 0, 255)[: thumb.shape[0], : thumb.shape[1]]
        assert thumb.shape == (-(-frames[0].height // 8), -(-frames[0].width // 8)) and (thumb == want).all()


def test_other_bytes_are_no_image(spark):
    good = jpeg.encode_images([b"x" * 64])[0]
    rows = [(1, None), (2, b""), (3, b"junk"), (4, good), (5, good[:30]), (6, good.replace(b"\xff\xc0", b"\xff\xc2")), (7, good[:-3])]
    got = {r.k: r.width for r in jpeg.read_media(spark.createDataFrame(rows, "k int, media binary")).collect()}
    assert [got[k] for k in (1, 2, 3, 5, 6)] == [None] * 5 and got[4] == 512


# ---- packing ----


def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def test_ids_are_the_tokenizers(spark):
    t, encoder = _tokenizer(), packing._encoder(packing.TOKENIZER)
    texts = [x or "" for _, x in EDGE_TEXTS] + ["don't  WE'LL\t\tgo \n\n on<|endoftext|>", "a\x1cb\x85c\xa0d", " lead and trail ", "½²³ 12ab34", "\n" * 500]
    texts += ["<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|endoftext|", "x" * 300_000 + " <|endoftext|>"]
    assert 50256 in t.encode(texts[-4], add_special_tokens=False).ids
    for x in texts:
        assert encoder.encode(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x[:50]


def test_pieces_and_places(edge_docs, no_docs):
    got = packing.pack_documents(edge_docs).collect()
    t, want = _tokenizer(), []
    for i, x in EDGE_TEXTS:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        start = 0
        while start < len(ids):
            n = (len(ids) - start) % 1024 or 1024
            want.append((i is None, i, start, n, zlib.crc32(ids[start:start + n].tobytes())))
            start += n
    assert sorted((r.doc_id is None, r.doc_id or -1, r.start, r.length, r.ids_crc32) for r in got) == sorted((a, i or -1, *b) for a, i, *b in want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(no_docs).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_plan_equals_best_fit_piece_by_piece(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 16, 37])
    counts = {n: rng.randint(1, 60) for n in rng.sample(range(1, size + 1), rng.randint(1, size))}
    filled, placed = {}, Counter()
    for length, lo, hi, first, per, at in packing.best_fit_plan(counts, size):
        for r in range(lo, hi):
            filled.setdefault(first + (r - lo) // per, []).append((at + (r - lo) % per * length, length))
            placed[length] += 1
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [i for i, b in enumerate(bins) if b >= length]
            if fits:
                bins[min(fits, key=lambda i: bins[i])] -= length
            else:
                bins.append(size - length)
    assert placed == counts and sorted(bins) == sorted(size - sum(n for _, n in x) for x in filled.values())


