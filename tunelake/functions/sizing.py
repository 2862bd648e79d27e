"""Size-checked broadcast: broadcast a side only after counting it, and
fall back to a shuffle join (with AQE skew splitting) beyond the bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_ROWS = 2_000_000


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner",
                 max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Join ``big`` with ``small``; ``small`` is broadcast only when a count
    proves it holds at most ``max_rows`` rows."""
    n = small.count()
    if n <= max_rows:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)
