"""One-permutation MinHash fingerprints of documents.

Every run of five words (fewer words: the whole sequence) is hashed once, by md5. The first two hex digits of
a hash name one of 256 bins, and a bin keeps its smallest hash. An empty bin takes the hash of a donor:
its own seeded order (a linear walk with odd step through all bins, one of a 2-universal family for each bin)
leads to the first bin that is not empty, so two texts that share their donors agree there as well. Stored
is the last hex digit of each bin's hash, four bits, packed in 64-bit numbers and shown as hex.

Digits of different hashes agree by chance once in 16 times; `likeness` takes that off the share of agreeing
bins. Its standard error is at most 0.034.

Nulls: a null text is empty. A text without words has the empty fingerprint, which is like another empty
one (1.0) and unlike all others (0.0). Null ids come last in descending order, rows with equal ids are ordered
by a hash of their text, and equal rows are interchangeable. An empty table gives an empty result; columns
beyond id and text are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import BLANK, LOWER, UPPER, ascii_lower, staged, text_of
from tracewell.operators.order import range_number

SHINGLE_WORDS = 5
BINS = 256  # two hex digits of a hash
BITS = 4  # one hex digit
DIGITS = "0123456789abcdef"
_PROBES = 8
_PACKED = 64 // BITS


def _steps(bins: int = BINS) -> tuple[list[int], list[int], list[int]]:
    """For each bin the odd step, the offset and the inverse of the step, from the md5 of its number."""
    hashes = [hashlib.md5(str(j).encode()).digest() for j in range(bins)]
    step, offset = [h[0] | 1 for h in hashes], [h[1] for h in hashes]
    return step, offset, [pow(u, -1, bins) for u in step]


def words_of(text: Column) -> Column:
    blanks = F.translate(ascii_lower(text_of(text)), BLANK, " " * len(BLANK))
    return F.filter(F.split(blanks, " ", -1), lambda w: w != "")


def _shingle_hashes(words: Column, k: int) -> Column:
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.md5(F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)]).cast("binary")))
    whole = F.array(F.md5(F.array_join(words, " ").cast("binary")))
    return F.when(F.size(words) >= k, runs).when(F.size(words) > 0, whole).otherwise(F.array().cast("array<string>"))


def _digit(hashed: Column, at: int) -> Column:
    return F.instr(F.lit(DIGITS), F.substring(hashed, at, 1)) - 1


def with_fingerprint(df: DataFrame, text: str, out: str, words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """Adds the packed fingerprint of a text column as an array of 64-bit numbers, empty where the text has no word."""
    step, offset, inverse = (F.array(*[F.lit(x) for x in xs]) for xs in _steps())
    kept = df.columns
    name = lambda s: f"__{out}_{s}"
    words, hashes, least, bins, filled = (F.col(name(s)) for s in ("words", "hashes", "least", "bins", "filled"))
    df = df.select("*", words_of(F.col(text)).alias(name("words")))
    df = df.select(*kept, F.sort_array(_shingle_hashes(words, words_per_shingle)).alias(name("hashes")))
    # sorted hashes: the first of each bin is its smallest
    is_first = lambda h, i: (i == 0) | (F.substring(h, 1, 2) != F.substring(F.get(hashes, i - 1), 1, 2))
    smallest = F.transform(F.filter(hashes, is_first), lambda h: F.struct((_digit(h, 1) * 16 + _digit(h, 2)).alias("bin"), _digit(h, 32).alias("low")))
    df = df.select(*kept, smallest.alias(name("least")))

    def gap(x, i):  # the empty bins before a bin, then the bin
        before = F.when(i > 0, F.get(least, i - 1)["bin"]).otherwise(-1)
        return F.concat(F.array_repeat(F.lit(None).cast("int"), x["bin"] - before - 1), F.array(x["low"]))
    df = df.select(*kept, name("least"), F.flatten(F.transform(least, gap)).alias(name("bins")))

    def donated(j):
        """The first bin that is not empty in the order of bin j; few steps mostly find it, else it has the least rank."""
        probes = [F.get(bins, ((F.lit(t) - F.get(offset, j)) * F.get(inverse, j)).bitwiseAND(F.lit(BINS - 1))) for t in range(_PROBES)]
        rank = lambda m: F.struct((m["bin"] * F.get(step, j) + F.get(offset, j)).bitwiseAND(F.lit(BINS - 1)), m["low"].alias("low"))
        return F.coalesce(F.get(bins, j), *probes, F.array_min(F.transform(least, rank))["low"])
    df = df.select(*kept, F.when(F.size(least) > 0, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), donated)).alias(name("filled")))
    pack = lambda w: F.aggregate(F.slice(filled, w * _PACKED + 1, F.lit(_PACKED)), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x.cast("long")))
    packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // _PACKED - 1)), pack)
    return df.select(*kept, F.when(filled.isNotNull(), packed).otherwise(F.array().cast("array<bigint>")).alias(out))


def as_hex(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.translate(F.lpad(F.hex(x), 16, "0"), UPPER[:6], LOWER[:6])), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints: the share of equal bins less what chance gives."""
    ones = F.lit(int("1" * _PACKED, 16))

    def unlike(x, y):
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(ones))
    differ = F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda acc, n: acc + n)
    chance = 1 / 2**BITS
    corrected = F.greatest(((BINS - differ) / F.lit(float(BINS)) - chance) / (1 - chance), F.lit(0.0))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(corrected)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, packed): the fingerprint of every row."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("body"))
    return with_fingerprint(rows, "body", "packed", words_per_shingle).select("doc_id", "packed")


def with_next(rows: DataFrame, payload: list[str]) -> DataFrame:
    """Adds `next`, the payload of the next row in descending order of (id, tie), for the last row that of the first.

    Rows go to ranges of the order by one exchange. The greatest row of a range goes to the following range as
    well, where it stands before all others.
    """
    spark = rows.sparkSession
    order = staged(rows.select("id", "tie"), "fingerprint-order")
    number, ranges = range_number(order, ["id", "tie"])
    greatest = order.groupBy(number.alias("part")).agg(F.max(F.struct("id", "tie")).alias("row")).orderBy("part").collect()  # one row a range
    target = [r["part"] for r in greatest[1:] + greatest[:1]]
    halo = spark.createDataFrame(
        [(r["part"], r["row"]["id"], r["row"]["tie"], t) for r, t in zip(greatest, target)],
        f"at int, last_id {rows.schema['id'].dataType.simpleString()}, last_tie bigint, target int")
    also = (F.col("part") == F.col("at")) & F.col("id").eqNullSafe(F.col("last_id")) & (F.col("tie") == F.col("last_tie"))
    places = F.array_compact(F.array(F.struct(F.col("part"), F.lit(True).alias("own")), F.when(F.col("target").isNotNull(), F.struct(F.col("target").alias("part"), F.lit(False).alias("own")))))
    dealt = rows.withColumn("part", number).join(F.broadcast(halo), also, "left").select(*rows.columns, F.explode(places).alias("to"))
    dealt = dealt.select(*rows.columns, "to.part", "to.own").repartitionById(ranges, "part")
    before = Window.partitionBy("part").orderBy("own", "id", "tie")
    return dealt.select(*rows.columns, "own", F.lag(F.struct(*payload)).over(before).alias("next")).where("own").drop("own")


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, body, n_chars, edited, packed, edited_packed, next_packed): each text, the text whose last third is
    replaced by the beginning of the next document, and the fingerprints of both and of the next document."""
    body = text_of(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(body).alias("tie"), body.alias("body"))
    found = with_next(with_fingerprint(rows, "body", "packed", words_per_shingle), ["body", "packed"])
    found = found.withColumn("n_chars", F.length("body").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("body", F.lit(1), F.col("n_chars").cast("int") - third), F.substring(F.col("next.body"), F.lit(1), third))
    found = found.select(F.col("id").alias("doc_id"), "body", "n_chars", edited.alias("edited"), "packed", F.col("next.packed").alias("next_packed"))
    return with_fingerprint(found, "edited", "edited_packed", words_per_shingle)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """One row per document: the fingerprints of its text and of its edited text, and how like they and the next document's are."""
    pairs = edited_pairs(docs.select("doc_id", "text"))
    return pairs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_hex(F.col("packed")).alias("fingerprint"), as_hex(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"), likeness(F.col("packed"), F.col("next_packed")).alias("near_next"))
