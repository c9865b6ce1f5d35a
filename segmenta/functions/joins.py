"""Join helpers that keep broadcasts behind a size bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Largest dimension broadcast after a row-count check; above it the join falls
# back to the planner's shuffle join (sort-merge, AQE skew handling).
DEFAULT_BROADCAST_MAX_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only after checking it holds at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows, and a table within the bound
    is joined as read: it is computed once.  Larger inputs are returned
    unhinted and joined by shuffle.
    """
    read = df.limit(max_rows + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(read, df.schema)) if read.num_rows <= max_rows else df


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the session's checkpoint folder, if it has
    one: later steps neither recompute it nor depend on the executors that made it."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def any_row(df: DataFrame) -> bool:
    """Whether ``df`` has a row (a bounded job: it stops at the first one)."""
    return len(df.take(1)) > 0


def one_row(df: DataFrame):
    """The single row of a global aggregate (``df.agg(...)`` without keys).

    A global aggregate yields exactly one row by construction (partials per
    task, one merge), so bringing it to the driver is bounded; callers put the
    values back into plans as literals instead of joining a one-row relation.
    """
    rows = df.take(2)
    if len(rows) != 1:
        raise ValueError(f"expected exactly one row, got {len(rows)}")
    return rows[0]


def literal(value, data_type: str) -> Column:
    """A typed literal column (typed NULL when ``value`` is None)."""
    return F.lit(value).cast(data_type)
