"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
# White space of the text contracts: space and U+0009 to U+000D.
BLANK = " \t\n\x0b\x0c\r"
# Rows of an Arrow batch sent to Python, unless the session names another number.
BATCH_ROWS = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(column.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; `lower` does that where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def staged(df: DataFrame, name: str) -> DataFrame:
    """The table written to the cluster's shared folder and read back.

    Cuts the lineage as a checkpoint does, but in compressed columns: a lost executor loses
    nothing, and no later stage runs the work again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds: texts may be long, so batches are of few rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def bucket_of_id(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
