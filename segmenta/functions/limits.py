"""Positions in an order, and the first rows of it, without one task that holds them all.

``orderBy().limit(n)`` keeps up to ``n`` rows per task and merges them in a single one, which for a
limit of millions is the slowest task of the job; a row number over the whole table is worse.  Here
rows are sorted by ranges and settled; a row's position is its place in its range plus the number
of rows in the ranges before it, one count per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmenta.functions.joins import settled
from segmenta.session import ensure_checkpoint_dir

#: Bits of a row's place within its task in ``monotonically_increasing_id``.
PLACE_BITS = 33


def total_order(df: DataFrame, order_by: Sequence[str | tuple[str, bool]]) -> list[Column]:
    """Sort columns: names, or ``(name, ascending)``, then all other columns.  NULLs last when
    ascending, first when descending, as in the cards' own SQL."""
    named = [(o, True) if isinstance(o, str) else o for o in order_by]
    rest = [(c, True) for c in df.columns if c not in {name for name, _ in named}]
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_first() for c, up in [*named, *rest]]


def with_positions(
    df: DataFrame, order_by: Sequence[str | tuple[str, bool]], name: str, *, ranges: int | None = None
) -> tuple[DataFrame, int]:
    """``df``, sorted, with every row's 0-based position by :func:`total_order` in column ``name``,
    and the number of rows.  Equal rows are interchangeable.  Needs a checkpoint folder."""
    spark = df.sparkSession
    if not ensure_checkpoint_dir(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    order = total_order(df, order_by)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Settled, since ranges are drawn by sampling: a second computation could draw others.
    ranged = settled(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order))
    placed = ranged.withColumn(name, F.monotonically_increasing_id())
    task = F.shiftright(name, PLACE_BITS)
    counted = placed.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("rows")).collect()
    starts, total = [], 0
    for r in sorted(counted, key=lambda r: r["task"]):
        starts += [F.lit(r["task"]), F.lit(total).cast("bigint")]
        total += r["rows"]
    if not starts:
        return placed, 0
    start = F.element_at(F.create_map(*starts), task)
    return placed.withColumn(name, start + F.col(name).bitwiseAND((1 << PLACE_BITS) - 1)), total


def ordered_limit(df: DataFrame, n: int, order_by: Sequence[str | tuple[str, bool]], *, ranges: int | None = None) -> DataFrame:
    """The first ``n`` rows of ``df`` by ``order_by``, sorted."""
    placed, _ = with_positions(df, order_by, "_position", ranges=ranges)
    return placed.where(F.col("_position") < n).drop("_position")
