import random

import pytest

from tests.llm import brute
from tests.llm.conftest import EDGE_TEXTS, LONG
from tracewell.llm import line_dedup, pii


def _lines(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in line_dedup.dedup_lines(df).select("doc.doc_id", "n_lines", "n_dropped", "kept").collect()}


def test_lines_equal_brute_force(spark):
    rng = random.Random(1)
    pool = ["Common line number %d" % i for i in range(30)] + ["  common LINE number 3\t", "short", "", "ÄÖÜ zehn Zeichen"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 200)))) for i in range(60)]
    rows.append((60, None))
    assert _lines(spark, rows) == brute.first_lines(rows)


def test_one_line_in_most_rows_is_spread_over_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    rows = [(i, "the very same line everywhere\nown line of %d here" % i) for i in range(400)]
    found = _lines(spark, rows)
    assert found[0] == (2, 0, rows[0][1])
    assert all(found[i] == (2, 1, "own line of %d here" % i) for i in range(1, 400))


def test_bitmap_words_beyond_the_first(spark):
    body = "\n".join("line number %05d of it" % i for i in range(300))
    found = _lines(spark, [(1, body), (2, body + "\nsomething else here"), (3, "line number 00299 of it")])
    assert found[2] == (301, 300, "something else here") and found[3] == (1, 1, "")


def test_lines_edge_rows(edge_docs, no_docs):
    rows = line_dedup.dedup_lines(edge_docs).select("doc.*", "n_lines", "n_dropped", "kept").collect()
    assert len(rows) == len(EDGE_TEXTS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.n_lines, r.n_dropped) for r in by[0]] == [(1, 0)]
    # the repeated row is one document: both rows lose the line of document 4 and keep their own
    assert [r.kept for r in by[5]] == ["\nmore of it"] * 2
    # documents without an id come after all others
    assert sorted((r.n_lines, r.n_dropped) for r in by[None]) == [(1, 0), (1, 1)]
    assert [r.kept for r in by[6]] == [LONG]
    assert line_dedup.line_report(no_docs).collect() == []
    stage = line_dedup.without_repeated_lines(edge_docs)
    assert stage.columns == edge_docs.columns and stage.where("doc_id = 0").first().text is None


PII_TEXTS = [
    "a.b+c@d-e.fg.hi. x@y @z.de q@r.s_t@u.v", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 0255.0.0.1 1.2.3", "4041 8949 7460 8795 and 4041-8949-7460-8795",
    "4041 8949  7460 8795", "4041894974608795 4041894974608796", "12 4041894974608795", "+1 (988) 555-2485. +49 30 1234567890 +12 3", "++1 555 123 4567",
    "", None, "é@x.de ñ 4041894974608795 日本 a@b.cd", "1 2 3 4 5 6 7 8 9 " * 3000, "a@" + "b." * 20000, "1" * 30000, "a" * 30000, "+1" * 3000,
    "Zahlen 10.0.0.1- 5 a.@b.c-.d",
]


def test_spans_equal_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(PII_TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pii_report(df).collect()}
    for i, text in enumerate(PII_TEXTS):
        spans = brute.base_spans(text)
        assert got[i].base_sha256 == brute.sha(brute.span_text(spans)), text
        assert got[i].n_card == sum(k == "card" for _, _, k, _ in spans)
        assert got[i].n_email == sum(k == "email" for _, _, k, _ in spans)


@pytest.mark.parametrize("seed", range(3))
def test_random_spans_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("0123456789 -.@+ab_()é\n") for _ in range(rng.randrange(400))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.pii_report(df).collect():
        assert r.base_sha256 == brute.sha(brute.span_text(brute.base_spans(texts[r.doc_id]))), texts[r.doc_id]


def test_checksums_and_context_add_spans(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "DE88370400440532013000"), (3, "ssn: 123-45-6789"), (4, "part 123-45-6789")]
    got = {r.doc_id: r for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_iban, got[2].n_iban) == (1, 0)
    assert got[1].spans.endswith("iban:5:32")
    assert (got[3].n_ssn, got[4].n_ssn) == (1, 0)  # only the nearby word lifts it over the threshold


def test_pii_edge_rows(edge_docs, no_docs):
    rows = pii.pii_report(edge_docs).collect()
    assert len(rows) == len(EDGE_TEXTS)
    assert [(r.n_email, r.n_phone) for r in rows if r.doc_id == 8] == [(1, 1)]
    assert all(r.spans == "" for r in rows if r.doc_id in (0, 1, 2, 6))
    assert pii.pii_report(no_docs).collect() == []
