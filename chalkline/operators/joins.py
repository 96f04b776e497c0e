"""Joins with a side that is expected to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SMALL_ROWS = 100_000
MAX_SMALL_BYTES = 64 * 1024 * 1024


def join_small(
    large: DataFrame, small: DataFrame, on: str, max_rows: int = MAX_SMALL_ROWS, max_bytes: int = MAX_SMALL_BYTES
) -> DataFrame:
    """Inner join; ``small`` is broadcast only when it has at most ``max_rows`` rows and ``max_bytes`` as JSON.

    Otherwise both sides are shuffled, and adaptive execution splits the keys that are too large.
    """
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
    rows, held = small.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    if rows <= max_rows and held <= max_bytes:
        small = F.broadcast(small)
    return large.join(small, on)
