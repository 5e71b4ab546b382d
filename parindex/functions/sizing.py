"""Size checks that guard every broadcast.

Only query-side and parameter tables are broadcast, and only when their size
is proven small: a plan whose leaves are all local relations has exact
Catalyst statistics; anything else is counted, partition by partition.
Above the bound nothing is hinted and the planner / AQE choose the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Query tables up to this many rows are broadcast.
MAX_BROADCAST_QUERY_ROWS = 2_000_000
# Local parameter tables up to this size (Catalyst's exact estimate) are
# broadcast without counting.
MAX_BROADCAST_LOCAL_BYTES = 64 << 20


def is_local(df: DataFrame) -> bool:
    """True when every leaf of the optimised plan is a local relation (its
    size statistics are then exact)."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        names = [leaves.apply(i).nodeName() for i in range(leaves.size())]
    except Exception:  # noqa: BLE001 - no JVM plan at hand: fall back to counting
        return False
    return bool(names) and all(n in ("LocalRelation", "OneRowRelation") for n in names)


def estimated_bytes(df: DataFrame) -> int:
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - unknown size
        return 1 << 62


def fits_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_QUERY_ROWS) -> bool:
    """Whether ``df`` is a local relation under ``MAX_BROADCAST_LOCAL_BYTES`` or has at most ``max_rows`` rows.

    Rows are counted partition by partition (a limit would send them to one task); of
    a query table made ready for several passes, once."""
    if is_local(df) and estimated_bytes(df) <= MAX_BROADCAST_LOCAL_BYTES:
        return True
    n = getattr(df, "_parindex_rows", None)
    if n is None:
        n = df.count()
        if getattr(df, "_parindex_prepared", False):
            df._parindex_rows = n
    return n <= max_rows


def small_side(df: DataFrame, bound: DataFrame | None = None,
               max_rows: int = MAX_BROADCAST_QUERY_ROWS) -> DataFrame:
    """Broadcast ``df`` when ``bound`` (a table whose row count bounds ``df``'s,
    by default ``df`` itself) is proven small: a local relation under
    ``MAX_BROADCAST_LOCAL_BYTES``, or at most ``max_rows`` rows when counted.
    Otherwise the planner and AQE choose the join."""
    return F.broadcast(df) if fits_broadcast(df if bound is None else bound, max_rows) else df


def per_partition(df: DataFrame) -> DataFrame:
    """Broadcast a table with one row per Spark partition of another table
    (bounded by the partition count, never by the data)."""
    return F.broadcast(df)
