import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import EDGE_TEXTS
from tests.oracle import TESTDATA, compare
from tracewell.llm import fingerprint, queries, sql

STEPS = [(hashlib.md5(str(j).encode()).digest()[0] | 1, hashlib.md5(str(j).encode()).digest()[1]) for j in range(256)]


def runs(text):
    w = brute.words(text)
    return {" ".join(w[i:i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def wanted(text):
    bins = {}
    for s in runs(text):
        h = hashlib.md5(s.encode()).hexdigest()
        bins[int(h[:2], 16)] = min(h, bins.get(int(h[:2], 16), "g"))
    if not bins:
        return ""
    return "".join((bins[j] if j in bins else bins[min(bins, key=lambda b: (b * u + v) % 256)])[-1] for j, (u, v) in enumerate(STEPS))


def like(a, b):
    if not a or not b:
        return float(a == b)
    return max((sum(x == y for x, y in zip(a, b)) / 256 - 1 / 16) / (15 / 16), 0.0)


def report(rows):
    """Rows of the report by plain Python; rows are (id, text) with distinct ids."""
    order = sorted(rows, key=lambda r: -r[0])
    out = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        k = len(t) // 3
        edited = t[:len(t) - k] + after[:k]
        out.append((i, len(t), brute.sha(edited), wanted(t), wanted(edited), like(wanted(t), wanted(edited)), like(wanted(t), wanted(after))))
    return sorted(out)


def _rows(n, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "Mixed", "日本"]
    return [(i * 3, rng.choice([" ", "\t", " \n"]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 5, 6, 30, 400])))) for i in range(n)]


def test_report_equals_brute_force(spark):
    rows = [*_rows(80), (1, None), (2, ""), (10**18, "a b c"), (-5, "negative id " * 30)]
    found = fingerprint.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert sorted(tuple(r) for r in found) == report(rows)


@pytest.mark.parametrize("n", [1, 2, 9])
def test_few_rows(spark, n):
    rows = _rows(n, seed=n)
    found = fingerprint.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in found) == report(rows)


def test_likeness_is_close_to_jaccard_for_short_and_long_texts(spark):
    """The mean error over many pairs is near zero for texts of 3 to 3,000 words: donors and chance bring no bias."""
    rng = random.Random(4)
    for size in (8, 30, 3000):
        errors = []
        pairs = []
        for _ in range(60 if size < 3000 else 12):
            a = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            cut = rng.randrange(size // 2, size)
            b = a[:cut] + [f"w{rng.randrange(10**6)}" for _ in range(size - cut)]
            pairs.append((" ".join(a), " ".join(b)))
        df = spark.createDataFrame(pairs, "a string, b string")
        df = fingerprint.with_fingerprint(fingerprint.with_fingerprint(df, "a", "fa"), "b", "fb")
        for r in df.select("a", "b", fingerprint.likeness(F.col("fa"), F.col("fb")).alias("s")).collect():
            x, y = runs(r.a), runs(r.b)
            errors.append(r.s - len(x & y) / len(x | y))
        assert abs(sum(errors) / len(errors)) < 0.03 and max(map(abs, errors)) < (0.45 if size == 8 else 0.2 if size == 30 else 0.12)


def test_edge_rows(spark, edge_docs, no_docs):
    clash = edge_docs.selectExpr("*", "'x' AS id", "'x' AS tie", "'x' AS body", "'x' AS packed", "'x' AS part", "'x' AS own")
    found = fingerprint.fingerprint_report(clash).collect()
    assert sorted((repr(r.doc_id), r.n_chars, r.fingerprint) for r in found) == sorted((repr(i), len(t or ""), wanted(t)) for i, t in EDGE_TEXTS)
    # below a row with an id that occurs once stands the row with the next smaller id; ids without a value come last
    texts = {i: t or "" for i, t in EDGE_TEXTS}
    for r in found:
        if r.doc_id not in (None, 0):
            same = [t for i, t in EDGE_TEXTS if i == r.doc_id]
            after = {texts[r.doc_id - 1]} | (set(same) if len(same) > 1 else set())
            k = r.n_chars // 3
            assert r.edited_sha256 in {brute.sha(texts[r.doc_id][:r.n_chars - k] + a[:k]) for a in after}
            assert r.near_next in {like(r.fingerprint, wanted(a)) for a in after}
    assert fingerprint.fingerprint_report(no_docs).collect() == []
    assert fingerprint.fingerprints(no_docs).collect() == []


def test_equal_to_sql(spark):
    assert compare(spark, "op13", queries.op13_fingerprint, sql.FINGERPRINTS, f"{TESTDATA}/sf0.001") == ""


def test_texts_travel_once_and_without_python(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    plan = fingerprint.edited_pairs(docs)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange (?!SinglePartition)\w+partitioning", plan)) <= 1 and "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan
