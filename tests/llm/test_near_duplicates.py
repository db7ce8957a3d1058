import random

import numpy as np

from tests.llm import brute
from tests.llm.conftest import EDGE_TEXTS
from tracewell.llm import simhash
from tracewell.llm.common import table

SF = "/root/testdata/sf0.001"


def test_fingerprints_follow_the_definition(spark):
    texts = ["", "one", "Two words", "three little words", "a b c a b c a b c", "Ünï CODE " * 40]
    assert [simhash.fingerprint(t.encode()) % (1 << 64) for t in texts] == [brute.fingerprint(t) for t in texts]
    assert simhash.fingerprint(b"a b c d e", 5) % (1 << 64) == brute.fingerprint("a b c d e", 5)


def _near(spark, fps, max_node):
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    named = {r.v: r.root for r in simhash.components(simhash.node_links(simhash.top_nodes(df, max_node=max_node))).collect()}
    ids = {f: i for i, f in enumerate(sorted(fps))}
    groups = {}
    for f in fps:
        s = f - (1 << 64) if f >> 63 else f
        groups.setdefault(named.get(s, s), []).append(f)
    return {f: min(g) for g in groups.values() for f in g}, ids


def test_index_finds_all_links_even_in_split_nodes(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(25):
            f = base
            for _ in range(rng.randrange(6)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    # a chain: neighbours differ in three bits, ends in many
    f = rng.getrandbits(64)
    for i in range(20):
        fps.add(f)
        f ^= 0b111 << (3 * i)
    want = brute.linked({f: f for f in fps})
    for max_node in (10_000, 16):
        got, _ = _near(spark, sorted(fps), max_node)
        assert got == want, max_node


def test_gray_index_against_all_pairs():
    rng = np.random.default_rng(2)
    fp = np.unique(rng.integers(0, 2**64, 30, dtype=np.uint64)[rng.integers(0, 30, 900)] ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)))
    rank = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    fp = fp[np.argsort(rank)]
    root = simhash.GrayIndex(fp, np.zeros(len(fp), np.int64)).components(3)
    want = brute.linked({i: int(f) for i, f in enumerate(fp)})
    assert {i: int(r) for i, r in enumerate(root)} == want


def test_documents_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_report(docs).collect()}
    fps = {r.doc_id: brute.fingerprint(r.text) for r in docs.collect()}
    want = brute.linked(fps)
    assert got == {i: (f"{f:016x}", want[i]) for i, f in fps.items()}


def test_edge_rows(edge_docs, no_docs):
    rows = simhash.simhash_report(edge_docs).collect()
    assert len(rows) == len(EDGE_TEXTS)
    empty = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in empty} >= {0, 1, 2, None} and {r.component_id for r in empty} == {0}
    assert simhash.simhash_report(no_docs).collect() == []
    kept = simhash.keep_one_of_each(edge_docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == edge_docs.columns and len(ids) == len(set(ids)) and 0 in ids and 1 not in ids and ids.count(5) == 1
    assert simhash.keep_one_of_each(no_docs).collect() == []
