import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.oracle import compare
from tracewell.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"


def _found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.similarity, r.word_start) for r in decontaminate.leak_report(d, b).collect()}


def test_copies_and_near_copies_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([3, 5, 14, 20, 36, 36, 59, 120, 1])]
    items += [(50, "Repeat repeat " * 20), (51, None), (52, "")]
    docs = []
    for i in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 200))]
        _, text = items[rng.randrange(10) if i % 10 else 9]
        piece = (text or "").split()
        for _ in range(rng.randrange(3)):  # a few words changed
            piece[rng.randrange(len(piece))] = "changed"
        cut = rng.randrange(len(body) + 1)
        docs.append((i, " ".join([*body[:cut], *[w.upper() for w in piece], *body[cut:]])))
    docs += [(100, None), (101, "")]
    got = _found(spark, docs, items)
    want = brute.leaks(docs, items)
    # at the edge of the similarity a pair may be beyond the radius; everything found is right
    assert {k: round(v[0], 6) for k, v in want.items() if v[0] >= 0.9 or k in got} == {k: v[0] for k, v in got.items()}
    assert len(got) >= 0.95 * len(want)
    assert all(got[k][1] == want[k][1] for k in got)


def test_long_items_take_few_windows(spark, monkeypatch):
    """A copy of a 5,000-word item and one with some words changed: work grows with the length, not its square."""
    rng = random.Random(11)
    item = [f"w{rng.randrange(20_000)}" for _ in range(5000)]
    changed = [w if rng.random() < 0.985 else "changed" for w in item]
    around = [f"v{rng.randrange(20_000)}" for _ in range(5000)]
    docs = [(1, " ".join(around[:2000] + item + around[2000:])), (2, " ".join(around + changed)), (3, " ".join(around)), (4, " ".join(item[:2000] + around))]
    built = []
    real = decontaminate.simhash
    monkeypatch.setattr(decontaminate, "simhash", lambda df, *a: (built.append(df.count()), real(df, *a))[1])
    found = _found(spark, docs, [(9, " ".join(item))])
    grams = [tuple(item[i:i + 5]) for i in range(4996)]
    same = len(set(grams) & {tuple(changed[i:i + 5]) for i in range(4996)})
    assert found[1, 9] == (1.0, 2000) and found[2, 9] == (round(same / (2 * 4996 - same), 6), 5000) and set(found) == {(1, 9), (2, 9)}
    assert max(built) < 3 * decontaminate.GRID


@pytest.mark.parametrize("size", [1, 4, 30, 200])
def test_exact_overlaps_equal_brute_force(spark, size):
    """Shingles that recur, in documents shorter and longer than the item."""
    rng = random.Random(size)
    item = [rng.randrange(12) for _ in range(size)]
    docs = {i: [rng.randrange(14) for _ in range(rng.choice([1, size, size + 1, 3 * size, 100]))] for i in range(20)}
    rows = [(d, 0, len(hs), p, 5, h) for d, hs in docs.items() for p, h in enumerate(hs)]
    shingles = spark.createDataFrame(rows, "doc long, row long, n int, pos int, k int, h long")
    wanted = spark.createDataFrame([(d, 0, 7, 5, size, h, item.count(h)) for d in docs for h in set(item)], "doc long, row long, item long, k int, m int, h long, times long")
    got = {r.doc: (round(r.similarity, 9), r.start) for r in decontaminate.exact_overlaps(shingles, wanted).collect()}
    for d, hs in docs.items():
        best = max(((lambda o: o / (size + min(size, len(hs)) - o))(sum((Counter(item) & Counter(hs[s:s + size])).values())), -s) for s in range(max(1, len(hs) - size + 1)))
        assert got.get(d, (0, 0)) == (round(best[0], 9), -best[1]) or best[0] == 0


def test_every_pair_within_the_radius_meets(spark):
    """The block index against all pairs of fingerprints."""
    rng = random.Random(4)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items = [(1, i, signed(rng.getrandbits(64))) for i in range(30)]
    probes = []
    for i in range(300):
        f = items[i % 30][2]
        for b in rng.sample(range(64), rng.randrange(25)):
            f ^= signed(1 << b)
        probes.append((1, i, f))
    filed = decontaminate._filed(spark.createDataFrame(items, "size int, item long, item_fp long"), decontaminate.RADIUS, decontaminate.BLOCKS)
    probed = decontaminate._probes(spark.createDataFrame(probes, "size int, probe long, window_fp long"), decontaminate.BLOCKS)
    near = probed.join(filed, ["size", "block", "value"]).where(F.bit_count(F.col("window_fp").bitwiseXOR(F.col("item_fp"))) <= decontaminate.RADIUS)
    got = {(r.probe, r.item) for r in near.select("probe", "item").collect()}
    assert got == {(p, i) for _, p, f in probes for _, i, g in items if ((f ^ g) % (1 << 64)).bit_count() <= decontaminate.RADIUS}


@pytest.mark.parametrize("longest", [100, 40_000])
def test_simhash_is_the_majority(spark, longest):
    rng = random.Random(6)
    rows = [(i, [rng.getrandbits(64) - (1 << 63) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 5, 60])]
    df = decontaminate.simhash(spark.createDataFrame(rows, "i int, hs array<long>"), "hs", "out", longest)
    for r in df.collect():
        want = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in r.hs) > len(r.hs))
        assert r.out % (1 << 64) == want


def test_edge_rows(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "a line that is long enough"), (2, None), (3, "word " * 200)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leak_report(edge_docs, items).collect()}
    assert got == {(4, 1), (5, 1), (None, 1), (6, 3), (7, 3)}
    kept = decontaminate.drop_contaminated(edge_docs, items)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id is None and -1 or r.doc_id for r in kept.collect()) == [-1, 0, 1, 2, 3, 8, 9, 10, 11]
    assert decontaminate.leak_report(no_docs, items).collect() == []
    none = items.limit(0)
    assert decontaminate.leak_report(edge_docs, none).collect() == []
    assert decontaminate.drop_contaminated(edge_docs, none).count() == edge_docs.count()


def test_items_without_id(spark):
    texts = [" ".join(f"{c}{i}" for i in range(20)) for c in "abc"]
    docs, items = [(i, f"before {t} after") for i, t in enumerate([*texts, "nothing here"])], [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2])]
    assert _found(spark, docs, items) == {(0, None): (1.0, 1), (1, None): (1.0, 1), (2, 7): (1.0, 1)}
    kept = decontaminate.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [3]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_registered_sql(spark, name):
    assert compare(spark, name, queries.QUERIES[name], queries.SQL[name], SF) == ""


def test_personal_data_sql_on_hard_texts(spark, tmp_path):
    """The SQL follows the operator on texts with checksums and context words."""
    texts = ["IBAN DE89 3704 0044 0532 0130 00 ok", "DE89370400440532013000", "DE88370400440532013000", "xDE89370400440532013000", "ssn: 123-45-6789",
             "part 123-45-6789", "a.b@c-d.ef 4041 8949 7460 8795 +1 (988) 555-2485 10.0.0.1", "", None, "1.2.3.4.5.6.7.8 256.1.1.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    (tmp_path / "documents.parquet").write_bytes(next((tmp_path / "d").glob("*.parquet")).read_bytes())
    assert compare(spark, "pii", queries.QUERIES["op8_pii"], queries.SQL["op8_pii"], str(tmp_path)) == ""
