"""Benchmark decontamination: item-sized windows, SimHash, multi-index Hamming blocks, exact check.

Words are separated by white space and A-Z is lower-cased; shingles are SHINGLE_WORDS words (an item
with fewer words is one shingle). A window has as many shingles as an item (a shorter document is one
window), so a copied item is one whole window. Window and item are compared by weighted Jaccard
similarity, each shingle weighing its number of occurrences.

1. A window that reaches the similarity holds a known share of shingles of items of its size, so windows with
   fewer are never built: the document shingles are looked up among the item shingles, each one found raises the count of
   the windows that hold it, and a running sum over these rises and falls gives the runs of windows with enough.
2. Of each run the fullest window and those at a grid of GRID steps an item get a SimHash (all of them for items of up
   to GRID shingles); the window that holds an item best is at most half a step away. 64 bits in BLOCKS blocks:
   fingerprints within RADIUS bits agree on one block up to RADIUS // BLOCKS bits, and items are filed under all
   such block values, so every pair within the radius meets.
3. Pairs of a document and an item within the radius are checked exactly, for all windows at once: a shingle counts
   in the windows that hold it and not too many of the same before it, and a running sum gives every window's overlap.

So work is linear in the length of documents and items. The radius leaves a margin: at similarity 0.8 two windows differ
in about 9.7 of 64 bits (standard deviation 2.9), copies in none. The first table is broadcast only after its rows
are counted, and so is the second; beyond that both joins shuffle. Documents are joined again only where windows are left.

Nulls: a null text or item has no words and matches nothing; null ids are kept. Rows that repeat an id
give one result row if any of them holds the item.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.tables import measured_broadcast
from tracewell.llm.common import ascii_lower, staged, text_of

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 17
BLOCKS = 6
GRID = 32
_WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text_of(text)), F.lit(_WORD), F.lit(0))


def shingle_hashes(words: Column, k: Column | int) -> Column:
    """Hashes of all runs of k words in order; empty if there are fewer."""
    if isinstance(k, int):
        hashed = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
        return F.when(F.size(words) >= k, hashed).otherwise(F.expr("cast(array() as array<bigint>)"))
    raise TypeError("k is a number of words")


def _lanes(hashes: Column, bits: int) -> list[Column]:
    """Per-bit counts of set bits, 64 // bits counts side by side in each of `bits` sums."""
    mask = sum(1 << (bits * lane) for lane in range(64 // bits))
    def one(j):
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(mask)))
    return [one(j) for j in range(bits)]


def simhash(df: DataFrame, hashes: str, out: str, longest: int) -> DataFrame:
    """Adds the SimHash: a bit is set where over half of the hashes set it. `longest`: most hashes of a row."""
    bits = 16 if longest < 1 << 15 else 32
    names = [f"__lane{j}" for j in range(bits)]
    kept = df.columns
    df = df.select("*", *[c.alias(n) for n, c in zip(names, _lanes(F.col(hashes), bits))])
    size = F.size(hashes)
    parts = []
    for j, n in enumerate(names):
        for lane in range(64 // bits):
            count = F.shiftrightunsigned(F.col(n), bits * lane).bitwiseAND(F.lit((1 << bits) - 1))
            bit = 1 << (bits * lane + j)
            parts.append(F.when(count * 2 > size, F.lit(bit - (1 << 64) if bit >> 63 else bit)).otherwise(F.lit(0).cast("long")))
    while len(parts) > 1:
        parts = [a.bitwiseOR(b) for a, b in zip(parts[::2], parts[1::2])]
    return df.select(*kept, parts[0].alias(out))


def block_edges(blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _block_value(fp: Column, lo: int, n: int) -> Column:
    return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << n) - 1))


def _block_masks(n: int, flips: int) -> list[int]:
    """All values of n bits with at most `flips` set."""
    return [sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(n), k)]


def _filed(items: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Items under every block value within the radius's share."""
    entries = [
        F.struct(F.lit(i).alias("block"), _block_value(F.col("item_fp"), lo, n).alias("value"), F.array(*[F.lit(m) for m in _block_masks(n, radius // blocks)]).alias("masks"))
        for i, (lo, n) in enumerate(block_edges(blocks))]
    each = items.select("size", "item", "item_fp", F.explode(F.array(*entries)).alias("e"))
    return each.select("size", "item", "item_fp", "e.block", F.col("e.value").alias("own"), F.explode("e.masks").alias("mask")).select(
        "size", "item", "item_fp", "block", F.col("own").bitwiseXOR(F.col("mask").cast("long")).alias("value"))


def _probes(windows: DataFrame, blocks: int) -> DataFrame:
    entries = [F.struct(F.lit(i).alias("block"), _block_value(F.col("window_fp"), lo, n).alias("value")) for i, (lo, n) in enumerate(block_edges(blocks))]
    return windows.withColumn("e", F.explode(F.array(*entries))).select("*", "e.block", "e.value").drop("e")


def _running(events: DataFrame, keys: list[str], end: str) -> DataFrame:
    """(keys, lo, hi, total): stretches of window starts from `at` to the next event, the last one to `end`, with the sum of the
    deltas up to there. Groups are as long as one document at most."""
    summed = events.groupBy(*keys, end, "at").agg(F.sum("delta").alias("delta"))
    order = Window.partitionBy(*keys).orderBy("at")
    return summed.select(*keys, F.col("at").alias("lo"), F.coalesce(F.lead("at").over(order) - 1, F.col(end)).alias("hi"), F.sum("delta").over(order).alias("total"))


def _rise_and_fall(first: Column, last: Column) -> Column:
    """One more from `first` on, one less after `last`."""
    return F.explode(F.array(F.struct(first.alias("at"), F.lit(1).alias("delta")), F.struct((last + 1).alias("at"), F.lit(-1).alias("delta"))))


def window_runs(hits: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc, row, k, size, m, lo, hi, best): runs of starts of windows with enough hits, and the first one with most of them.

    `hits` has doc, row, k, size, m, n (shingles of the document) and pos, once for each place of a shingle that items of
    the size have.
    """
    keys = ["doc", "row", "k", "size", "m", "n"]
    end = F.greatest(F.lit(0), F.col("n") - F.col("m"))
    first, last = F.greatest(F.lit(0), F.col("pos") - F.col("m") + 1), F.least("pos", end)
    events = hits.select(*keys, end.alias("end"), _rise_and_fall(first, last).alias("e")).select(*keys, "end", "e.*")
    enough = F.col("total") * (1 + similarity) >= similarity * (F.col("m") + F.least("m", "n")) - 1e-9
    full = _running(events, keys, "end").where(enough & (F.col("hi") >= F.col("lo")))
    order = Window.partitionBy(*keys).orderBy("lo")
    parted = full.withColumn("new", F.coalesce(F.lag("hi").over(order) + 1 < F.col("lo"), F.lit(True)).cast("int"))
    runs = parted.withColumn("run", F.sum("new").over(order)).groupBy(*keys, "run").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max_by("lo", F.struct("total", -F.col("lo"))).alias("best"))
    return runs.drop("run", "n")


def exact_overlaps(shingles: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, row, item, similarity, start): the best weighted similarity over all windows, and the first window that reaches it.

    `shingles` has doc, row, n, pos, k and h; `wanted` has doc, row, item, k, m and h with its `times` in the item.
    """
    same = [F.col("s.doc").eqNullSafe(F.col("w.doc")), F.col("s.row") == F.col("w.row"), F.col("s.k") == F.col("w.k"), F.col("s.h") == F.col("w.h")]
    met = shingles.alias("s").join(wanted.alias("w"), same).select("w.doc", "w.row", "w.item", "w.m", "w.h", "w.times", "s.n", "s.pos")
    places = met.groupBy("doc", "row", "item", "m", "h", "times", "n").agg(F.sort_array(F.collect_list("pos")).alias("places"))
    # a place counts in a window that holds it, unless the window holds as many of them before it as the item has
    before = F.transform("places", lambda p, i: F.struct(p.alias("pos"), F.coalesce(F.when(i >= F.col("times"), F.get(F.col("places"), i - F.col("times").cast("int"))), F.lit(-1)).alias("before")))
    each = places.select("doc", "row", "item", "m", "n", F.explode(before).alias("p"))
    end = F.greatest(F.lit(0), F.col("n") - F.col("m"))
    first, last = F.greatest(F.lit(0), F.col("p.pos") - F.col("m") + 1, F.col("p.before") + 1), F.least("p.pos", end)
    events = each.where(first <= last).select("doc", "row", "item", "m", "n", end.alias("end"), _rise_and_fall(first, last).alias("e")).select(
        "doc", "row", "item", "m", "n", "end", "e.*")
    level = _running(events, ["doc", "row", "item", "m", "n"], "end").where("hi >= lo")
    value = F.col("total") / (F.col("m") + F.least("m", "n") - F.col("total"))
    scored = level.withColumn("similarity", value)
    return scored.groupBy("doc", "row", "item").agg(
        F.max("similarity").alias("similarity"), F.max_by("lo", F.struct("similarity", -F.col("lo"))).alias("start"))


def benchmark_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """(item, size, k, item_hashes): items with at least one word; size is the number of words."""
    words = benchmark.select(F.col(f"`{item_id}`").alias("item"), words_of(F.col(f"`{text}`")).alias("words")).where(F.size("words") > 0)
    parts = [F.when(F.size("words") == n, shingle_hashes(F.col("words"), n)) for n in range(1, k)]
    hashes = F.coalesce(*parts, shingle_hashes(F.col("words"), k))
    return words.select("item", F.size("words").alias("size"), F.least(F.size("words"), F.lit(k)).alias("k"), hashes.alias("item_hashes"))


def contaminated_windows(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS,
                         blocks: int = BLOCKS, k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc, row, item, start, similarity): items that a window of a document reaches the similarity to, with the best window.

    `docs` has doc_id and text; `row` is a hash of the text and `start` counts words from 0.
    """
    # inside, an item goes by a key that is never null
    items = benchmark_items(benchmark, k=k).withColumnRenamed("item", "item_id")
    items = items.withColumn("item", F.xxhash64("item_id", F.col("item_id").isNull(), "size", "item_hashes")).dropDuplicates(["item"])
    items = staged(items, "benchmark-items")
    shape = items.agg(F.max(F.size("item_hashes")).alias("longest"), F.collect_set("k").alias("ks")).first()  # at most k sizes
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text_of(F.col("text"))).alias("row"), F.col("text").alias("body"))
    ks = shape["ks"] or [k]
    grams = measured_broadcast(items.select("k", "size", F.size("item_hashes").alias("m"), F.explode("item_hashes").alias("h")).distinct())

    # 1. windows with enough shingles of items of their size
    split = rows.select("doc", "row", words_of(F.col("body")).alias("words"))
    found = []
    for n in ks:
        hashed = split.select("doc", "row", shingle_hashes(F.col("words"), n).alias("hs"))
        # outer: otherwise a filter on the array's size is pushed below and computes it again
        each = hashed.select("doc", "row", F.size("hs").alias("n"), F.posexplode_outer("hs").alias("pos", "h"))
        met = each.join(grams.where(F.col("k") == n).drop("k"), "h").withColumn("k", F.lit(n))
        found.append(met.select("doc", "row", "n", "pos", "k", "size", "m"))
    runs = window_runs(reduce(DataFrame.unionByName, found), similarity)
    step = F.greatest(F.lit(1), F.floor(F.col("m") / GRID).cast("int"))
    from_grid = F.ceil(F.col("lo") / step).cast("int") * step
    grid = F.when(from_grid <= F.col("hi"), F.sequence(from_grid, F.col("hi"), step)).otherwise(F.array().cast("array<int>"))
    starts = runs.select("doc", "row", "k", "size", "m", F.explode(F.array_union(F.array("best"), grid)).alias("start"))
    per_row = staged(starts.groupBy("doc", "row").agg(F.collect_list(F.struct("k", "size", "m", "start")).alias("windows")), "benchmark-windows")

    # 2. fingerprints of these windows, and items within the radius
    joined = rows.join(per_row.withColumnRenamed("doc", "d").withColumnRenamed("row", "r"), F.col("doc").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")))
    joined = joined.select("doc", "row", "windows", words_of(F.col("body")).alias("words"))
    built = []
    for n in ks:
        own = joined.select("doc", "row", "windows", shingle_hashes(F.col("words"), n).alias("hs")).select("doc", "row", "hs", F.explode("windows").alias("w"))
        built.append(own.where(F.col("w.k") == n).select("doc", "row", "w.size", "w.start", F.slice("hs", F.col("w.start") + 1, F.col("w.m")).alias("window_hashes")))
    longest = shape["longest"] or 1
    marked = staged(simhash(reduce(DataFrame.unionByName, built), "window_hashes", "window_fp", longest), "window-fingerprints")
    filed = measured_broadcast(_filed(simhash(items, "item_hashes", "item_fp", longest), radius, blocks))
    near = _probes(marked, blocks).join(filed, ["size", "block", "value"])
    near = near.where(F.bit_count(F.col("window_fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    # the same pair may meet in several blocks: it counts in its first one
    first_block = F.lit(blocks)
    for i, (lo, n) in reversed(list(enumerate(block_edges(blocks)))):
        differ = F.bit_count(_block_value(F.col("window_fp").bitwiseXOR(F.col("item_fp")), lo, n))
        first_block = F.when(differ <= radius // blocks, F.lit(i)).otherwise(first_block)
    near = near.where(F.col("block") == first_block)

    # 3. exact similarity
    pairs = staged(near.select("doc", "row", "item").distinct(), "benchmark-pairs")
    counts = items.select("item", "k", F.size("item_hashes").alias("m"), F.explode("item_hashes").alias("h")).groupBy("item", "k", "m", "h").agg(F.count("*").alias("times"))
    wanted = pairs.join(counts, "item")
    again = rows.join(pairs.select(F.col("doc").alias("d"), F.col("row").alias("r")).distinct(), F.col("doc").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left_semi")
    again = again.dropDuplicates(["doc", "row"]).select("doc", "row", words_of(F.col("body")).alias("words"))
    parts = []
    for n in ks:
        hashed = again.select("doc", "row", shingle_hashes(F.col("words"), n).alias("hs"))
        parts.append(hashed.select("doc", "row", F.size("hs").alias("n"), F.lit(n).alias("k"), F.posexplode_outer("hs").alias("pos", "h")))
    checked = exact_overlaps(reduce(DataFrame.unionByName, parts), wanted).where(F.col("similarity") >= similarity)
    return checked.join(items.select("item", "item_id"), "item").select("doc", "row", F.col("item_id").alias("item"), "start", "similarity")


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found in it: the best similarity and where it is reached first."""
    best = contaminated_windows(docs, benchmark).groupBy("doc", "item").agg(
        F.max("similarity").alias("similarity"), F.max_by("start", F.struct("similarity", -F.col("start"))).alias("word_start"))
    return best.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "word_start", F.round("similarity", 6).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; all columns stay. Rows are judged one by one."""
    leaks = staged(contaminated_windows(docs.select("doc_id", "text"), benchmark).select(F.col("doc").alias("id"), F.col("row").alias("leak")).distinct(), "leaks")
    # the given row as one value: its names stay apart from those used here
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), F.col("doc_id").alias("own"), F.xxhash64(text_of(F.col("text"))).alias("row"))
    return marked.join(leaks, F.col("own").eqNullSafe(F.col("id")) & (F.col("row") == F.col("leak")), "left_anti").select("given.*")
