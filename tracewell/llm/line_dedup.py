"""Exact line deduplication that returns keep bitmaps instead of text.

Line keys are hashed and range-partitioned with the document and position as secondary sort, so a line
that a third of all documents share is spread over many ranges. Inside each range the rows of a hash
stream in order and the first one names the owning document; a hash that crosses ranges takes its owner
from the earlier range, and there are fewer such hashes than ranges. Lines owned by another document
become bits, 64 lines to a word, and words without such lines are left out.

Nulls: a null text is one empty line; documents with a null id count as one document that comes after
all others. Rows that repeat an id are one document: a line owned by the id stays in all its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import BLANK, ascii_lower, staged, text_of

MIN_KEY_CHARS = 10
LAST_ID = 2**63 - 1  # where a null id sorts
ID = ["__id", "__row"]


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Id and a hash of the text: rows equal in both have equal lines, so they share a bitmap."""
    body = text_of(F.col(f"`{text}`"))
    return docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST_ID)).alias("__id"), F.xxhash64(body).alias("__row"),
        body.alias("__body"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))


def _line_hashes(identified: DataFrame, min_chars: int) -> DataFrame:
    key = ascii_lower(F.btrim(F.col("line"), F.lit(BLANK)))
    lines = identified.select(*ID, F.posexplode_outer(F.split("__body", "\n", -1)).alias("pos", "line")).select(*ID, "pos", key.alias("key"))
    return lines.where(F.length("key") >= min_chars).select(
        *ID, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def foreign_lines(hashes: DataFrame) -> DataFrame:
    """(id, row, pos) of the lines whose hash first occurs in another document."""
    order = ["h1", "h2", *ID, "pos"]
    # written first: finding range bounds reads its input an extra time
    ranged = staged(hashes, "line-hashes").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    stream = Window.partitionBy("part", "h1", "h2").orderBy(*ID, "pos")
    seen = staged(ranged.select(*order, "part", F.first("__id").over(stream).alias("first_id")), "line-firsts")
    # a hash that goes on in the next range is the last one of its own, and the earliest such range
    # holds its owner: one row for each range at most
    tails = seen.groupBy("part").agg(F.max(F.struct("h1", "h2", F.col("first_id").alias("owner"))).alias("tail"))
    carried = F.broadcast(tails.groupBy("tail.h1", "tail.h2").agg(F.min("tail.owner").alias("owner")))
    owner = F.least("first_id", "owner")
    return seen.join(carried, ["h1", "h2"], "left").where(F.col("__id") > owner).select(*ID, "pos")


def drop_bitmaps(hashes: DataFrame) -> DataFrame:
    """(id, row, words): the dropped lines of documents that lose any, as (word, bits) sorted by word."""
    words = foreign_lines(hashes).repartition(*ID).groupBy(*ID, F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    return words.groupBy(*ID).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))


def _dense(words: Column) -> Column:
    """All words up to the last stored one, zeros filled in, so that a line finds its word by place."""
    def filled(x, i):
        before = F.when(i > 0, F.element_at(words, i)["word"]).otherwise(-1)
        return F.concat(F.array_repeat(F.lit(0).cast("long"), x["word"] - before - 1), F.array(x["bits"]))
    return F.flatten(F.transform(words, filled))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """(doc, words, n_lines, n_dropped, kept): each input row as a struct, its bitmap, and the lines left.

    A key is the line without white space at both ends, A-Z lower-cased. Lines whose key has at least
    `min_chars` code points and occurs in a document with a smaller id are dropped; the others are
    joined by newlines. An empty table gives an empty result.
    """
    rows = _identified(docs, doc_id, text)
    bitmaps = drop_bitmaps(_line_hashes(rows, min_chars)).hint("shuffle_hash")
    joined = rows.join(bitmaps, ID, "left").withColumn("__dense", F.when(F.col("words").isNotNull(), _dense(F.col("words"))))
    dropped = F.coalesce(F.aggregate("words", F.lit(0).cast("long"), lambda n, x: n + F.bit_count(x["bits"])), F.lit(0).cast("long"))

    def stays(line, i):
        word = F.get(F.col("__dense"), F.shiftright(i, 6))
        return F.coalesce(F.getbit(word, F.col("__none") + (i.bitwiseAND(F.lit(63)))) == 0, F.lit(True))

    lines = F.split("__body", "\n", -1)
    kept = F.when(F.col("words").isNull(), F.col("__body")).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    return joined.withColumn("__none", F.lit(0)).select(
        F.col("__doc").alias("doc"), "words",
        (F.length("__body") - F.length(F.replace("__body", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        dropped.alias("n_dropped"), kept.alias("kept"))


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str = "n_chars", **how) -> DataFrame:
    """The documents with foreign lines left out of their text, and its length in `length` where it changed."""
    found = dedup_lines(docs, doc_id, text, **how)
    changed = F.col("n_dropped") > 0
    new = {text: F.when(changed, F.col("kept")).otherwise(F.col(f"doc.`{text}`"))}
    if length in docs.columns:
        new[length] = F.when(changed, F.length("kept").cast("long")).otherwise(F.col(f"doc.`{length}`"))
    return found.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def line_report(docs: DataFrame) -> DataFrame:
    """One row per document: lines, dropped lines, and a digest of what is kept."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
