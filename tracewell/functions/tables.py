"""Table helpers with measured sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut_lineage

# Tables up to this many (narrow) rows are broadcast; larger ones are joined by shuffle.
MAX_BROADCAST_ROWS = 100_000


def measured_broadcast(df: DataFrame, limit: int | None = None) -> DataFrame:
    """The table, marked for broadcast if it was measured to be small.

    It is computed once and written; a table beyond the limit is read back from there and joined by shuffle.
    """
    limit = MAX_BROADCAST_ROWS if limit is None else limit
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= limit else kept
