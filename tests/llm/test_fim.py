import hashlib
import random
import re

import pytest
import zstandard

from tests.llm import brute
from tests.llm.conftest import EDGE_TEXTS
from tests.oracle import TESTDATA, compare
from tracewell.llm import fim, queries, sql

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def wanted(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output, text) by whole strings."""
    t = text or ""
    units = UNIT.findall(t)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, t, t
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", t
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", t


def _texts(n, seed=5):
    rng = random.Random(seed)
    pool = ["word", "x", " ", "\n", "é", "日本", "😀", "1", "<", "<P", "P>", "S", "ABC" * 9, "\x00", ">"]
    return [(i, "".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 9, 60, 400])))) for i in range(n)]


def _stored(text, compressor):
    out = fim.Writer(compressor)
    out.add_text(text.encode())
    return out.row()


@pytest.mark.parametrize("frame_bytes", [8, 31, 1 << 16])
def test_transformation_and_restoring_equal_whole_strings(monkeypatch, frame_bytes):
    """Frames of a few bytes: letters, marks and characters meet every kind of border."""
    monkeypatch.setattr(fim, "FRAME_BYTES", frame_bytes)
    compressor, decompressor = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()
    forms = set()
    for doc_id, text in [*_texts(400), (7, "a<P>b"), (8, "x" * 500), (9, "é" * 100), (10, "ab " * 200), (11, "<M>")]:
        store = fim.Store(decompressor, *_stored(text, compressor))
        n, form, prefix, middle, output, _ = wanted(doc_id, text)
        assert store.units[-1] == n and b"".join(store.read(0, store.bytes[-1])).decode() == text
        assert max((len(decompressor.decompress(store.stored(i))) for i in range(len(store.bytes) - 1)), default=0) <= frame_bytes
        plan, out = fim.plan(doc_id, n, any(m in text for m in ("<P>", "<S>", "<M>"))), fim.Writer(compressor)
        sizes = fim.transform(store, plan, out)
        moved = fim.Store(decompressor, *out.row())
        forms.add(form)
        assert plan.form == form and (sizes or (None, None)) == (prefix, middle)
        assert b"".join(moved.read(0, moved.bytes[-1])).decode() == output
        # the index of the output is right as well, though most of it was taken over
        assert moved.units[-1] == len(UNIT.findall(output)) and moved.chars[-1] == len(output)
        assert b"".join(fim.restore(moved, form)).decode() == text
    assert forms == {"plain", "psm", "spm"}


def test_a_cut_decompresses_one_frame_only(monkeypatch):
    monkeypatch.setattr(fim, "FRAME_BYTES", 64)
    text = "some words, and more of them " * 100
    seen = []

    class Counting:
        def decompress(self, data):
            seen.append(data)
            return zstandard.ZstdDecompressor().decompress(data)

    store, out = fim.Store(Counting(), *_stored(text, zstandard.ZstdCompressor())), fim.Writer(zstandard.ZstdCompressor())
    for units in (0, 1, 700, 1234, 1235, store.units[-1]):
        seen.clear()
        at, chars = store.cut(units)
        assert text[:chars] == "".join(UNIT.findall(text)[:units]) and at == len(text[:chars].encode()) and len(seen) <= 1
    seen.clear()
    fim.transform(store, fim.Plan(300, 900, "psm"), out)
    assert len(seen) == 2 and len(out.frames) > 40  # the frames of both cuts; all others were taken over


def test_documents_edge_rows(spark, edge_docs, no_docs):
    clash = edge_docs.selectExpr("*", "'x' AS n", "'x' AS form", "'x' AS frames", "'x' AS units")
    found = fim.fim_report(clash).collect()
    want = sorted(((i, *wanted(i, t)[:4], *map(brute.sha, wanted(i, t)[4:])) for i, t in EDGE_TEXTS), key=repr)
    assert sorted((tuple(r) for r in found), key=repr) == want
    assert fim.fim_report(no_docs).collect() == []


def test_text_ids_and_shares(spark):
    rows = spark.range(3000).selectExpr("concat('doc-', id) AS doc_id", "'one two three' AS text")
    out = fim.fim_documents(rows, transformed=50, suffix_first=50)
    counts = {r.form: r["count"] for r in out.groupBy("form").count().collect()}
    assert abs(counts["plain"] - 1500) < 150 and abs(counts["spm"] - 750) < 120 and out.schema["doc_id"].dataType.simpleString() == "string"


def test_equal_to_sql(spark):
    assert compare(spark, "op11", queries.op11_fim, sql.FIM, f"{TESTDATA}/sf0.001") == ""
