"""Per-key sequence helpers that stay balanced when one key is huge.

A plain ``lag().over(Window.partitionBy(key).orderBy(ts))`` puts every row of a
key into one task.  Click-stream keys are skewed (anonymous traffic shares one
NULL uid), so :func:`lag_by_key` cuts each key's rows into pieces of a total
order (time with NULLs last, then the tie-break columns):

1. the rows of a (key, time chunk) are counted on the order columns alone; a
   chunk of more than ``piece_rows`` rows is cut further by histograms of its
   times and, where times are equal or missing, of the tie-break, until no piece
   holds more than twice ``piece_rows``;
2. ``lag`` runs inside (key, chunk, piece) windows;
3. the last row of every piece, taken from the same windows, is carried to the
   next piece of the key: one row per piece meets a per-key window;
4. the first row of each piece takes the carried row.

The carried row holds every column, so both readings of the windows share one
exchange: the table is scanned and parsed once, besides the narrow count.  The
result equals ``lag(col, 1)`` over the whole key (NULLs kept, no ignore-nulls).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmenta.functions.joins import any_row, broadcast_if_small, settled

DEFAULT_PIECE_ROWS = 1_000_000
#: Bins per histogram when a hot chunk is cut.
BINS = 256
LAST = (1 << 63) - 1


def _micros(ts: str, ts_type: T.DataType) -> Column:
    """Microseconds, monotone in the column's own ordering (no time-zone shift
    for timestamp_ntz, so no daylight-saving gap can reorder rows)."""
    if isinstance(ts_type, T.TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, F.col(ts))
    return F.unix_micros(F.col(ts).cast("timestamp"))


_PARTS = ["_kv", "_kn", "_chunk"]


def _bin(value: str, low: str, high: str) -> Column:
    """Which of ``BINS`` equal bins of ``[low, high]`` holds the value (exact decimals)."""
    away, width = (F.col(c).cast("decimal(20,0)") - F.col(low).cast("decimal(20,0)") for c in (value, high))
    return F.floor(away * BINS / (width + 1)).cast("bigint")


def _cut_points(rows: DataFrame, piece_rows: int) -> DataFrame | None:
    """For every (key, chunk) of more than ``piece_rows`` rows: the sorted
    ``(micros, tie)`` at which its second and later pieces start, or None when no
    chunk is that large.  ``rows`` has the parts, ``_m`` and ``_t``.

    A hot chunk is one range at first.  A range falls into bins of its times, or
    of its ties once all its times are equal; a bin of more than ``piece_rows``
    rows becomes a range again.  Each step is a narrow aggregate over the rows
    of ranges that are still too large, and divides the range by ``BINS``, so the
    steps are few whatever the number of rows.  Equal (time, tie) stay together.
    """
    spans = [F.min("_m").alias("_m0"), F.max("_m").alias("_m1"), F.min("_t").alias("_t0"), F.max("_t").alias("_t1")]
    counted = rows.groupBy(*_PARTS).agg(F.count(F.lit(1)).alias("_n"), *spans)
    open_ranges = counted.where(F.col("_n") > piece_rows)
    done = None
    while any_row(open_ranges):
        by_time = F.col("_m0") < F.col("_m1")
        by_tie = ~by_time & (F.col("_t0") < F.col("_t1"))
        ranges = open_ranges.select(*[F.col(c).alias("r" + c) for c in [*_PARTS, "_m0", "_m1", "_t0", "_t1"]])
        inside = [F.col(c) == F.col("r" + c) for c in _PARTS] + [
            F.col("_m").between(F.col("r_m0"), F.col("r_m1")),
            (F.col("r_m0") < F.col("r_m1")) | F.col("_t").between(F.col("r_t0"), F.col("r_t1")),
        ]
        condition = inside[0]
        for c in inside[1:]:
            condition = condition & c
        hot = rows.join(broadcast_if_small(ranges), condition)
        number = F.when(F.col("r_m0") < F.col("r_m1"), _bin("_m", "r_m0", "r_m1")).otherwise(_bin("_t", "r_t0", "r_t1"))
        start = [F.col("r_m0").alias("_r0"), F.col("r_t0").alias("_r1")]
        binned = hot.groupBy(*_PARTS, *start, number.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), *spans)
        binned = settled(binned.drop("_r0", "_r1", "_bin"))
        splittable = (F.col("_n") > piece_rows) & (by_time | by_tie)
        closed = binned.where(~splittable)
        done = closed if done is None else done.unionByName(closed)
        open_ranges = binned.where(splittable)
    if done is None:
        return None
    # A bin of times takes all rows of its first time; a bin of ties starts at its first tie.
    order = Window.partitionBy(*_PARTS).orderBy("_m0", "_t0")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = done.withColumn("_piece", F.floor(before / piece_rows))
    starts = pieces.groupBy(*_PARTS, "_piece").agg(F.min(F.struct("_m0", "_t0")).alias("_start"))
    return starts.where(F.col("_piece") > 0).groupBy(*_PARTS).agg(F.sort_array(F.collect_list("_start")).alias("_starts"))


def lag_by_key(
    df: DataFrame,
    key: str,
    order: str,
    columns: Sequence[str],
    *,
    tiebreak: Sequence[str] = (),
    chunk_seconds: int = 3600,
    piece_rows: int = DEFAULT_PIECE_ROWS,
    ignore_nulls: bool = False,
    prefix: str = "prev_",
) -> DataFrame:
    """Add ``prefix + c`` = value of ``c`` on the immediately preceding row of the
    same ``key`` ordered by ``order`` (NULLs last), then ``tiebreak`` (NULLs last).
    NULL keys form one group, as in SQL window partitions.

    ``ignore_nulls=True`` instead gives the last non-NULL value on any earlier
    row (a forward fill), still without gathering a key into one task.

    Rows that the tie-break leaves equal are ordered by a hash of all their
    columns, so the order is the same wherever it is needed.  An integral first
    tie-break column lets rows of one instant, or without a time, be spread as
    well; without one they stay in one piece.
    """
    cols = list(columns)
    # NULL keys form one group.  The key is carried as (value-or-default, is-NULL)
    # so windows and the final join all hash on the same plain columns.
    key_type = df.schema[key].dataType
    default = F.lit("") if isinstance(key_type, T.StringType) else F.lit(0).cast(key_type)
    micros = _micros(order, df.schema[order].dataType)
    whole = tiebreak and isinstance(df.schema[tiebreak[0]].dataType, T.IntegralType)
    tie = F.coalesce(F.col(tiebreak[0]).cast("bigint"), F.lit(LAST)) if whole else F.lit(0).cast("bigint")
    rows = df.withColumns(
        {
            "_kv": F.coalesce(F.col(key), default),
            "_kn": F.col(key).isNull(),
            # Rows without a time are the key's last chunk.
            "_chunk": F.coalesce(F.floor(micros / F.lit(chunk_seconds * 1_000_000)).cast("bigint"), F.lit(LAST)),
            "_m": F.coalesce(micros, F.lit(LAST)),
            "_t": tie,
        }
    )
    starts = _cut_points(rows.select(*_PARTS, "_m", "_t"), piece_rows)
    if starts is None:
        placed, parts = rows, _PARTS  # every chunk is one piece
    else:
        at = F.struct(F.col("_m").alias("_m0"), F.col("_t").alias("_t0"))
        placed = rows.join(broadcast_if_small(starts), _PARTS, "left").withColumn(
            "_piece", F.coalesce(F.size(F.filter("_starts", lambda start: start <= at)), F.lit(0))
        )
        parts = [*_PARTS, "_piece"]
    # An exchange of its own: both readings below see the same one, whatever they compute above it.
    placed = placed.select(*df.columns, *parts).repartition(*parts)

    sorting = [F.col(c).asc_nulls_last() for c in (order, *tiebreak)]
    w = Window.partitionBy(*parts).orderBy(*sorting, F.xxhash64(*df.columns))
    upto_here = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.select(
        *df.columns,
        *parts,
        F.row_number().over(w).alias("_rn"),
        *[(F.last(c, ignorenulls=True).over(before) if ignore_nulls else F.lag(c).over(w)).alias(f"_lag_{c}") for c in cols],
    )
    # The piece's last row, with all columns: the same exchange serves both readings.
    latest = [F.last(c, ignorenulls=True).over(upto_here) if ignore_nulls else F.col(c) for c in cols]
    lasts = placed.select(
        *parts,
        F.lead(F.lit(1)).over(w).alias("_next"),
        F.struct(*df.columns).alias("_row"),
        *[value.alias(c) for c, value in zip(cols, latest)],
    ).where(F.col("_next").isNull())

    w_pieces = Window.partitionBy("_kv", "_kn").orderBy(*parts[2:])
    earlier = w_pieces.rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(
        *[F.col(c).alias("c" + c) for c in parts],
        F.lag("_row").over(w_pieces).isNotNull().alias("_carried"),
        *[(F.last(c, ignorenulls=True).over(earlier) if ignore_nulls else F.lag(c).over(w_pieces)).alias(f"_before_{c}") for c in cols],
    )
    same = F.col("_kv") == F.col("c_kv")
    for c in parts[1:]:
        same = same & (F.col(c) == F.col("c" + c))
    out = inner.join(carried, same, "left")
    for c in cols:
        first = F.when(F.col("_carried"), F.col(f"_before_{c}"))
        if ignore_nulls:
            value = F.coalesce(F.col(f"_lag_{c}"), first)
        else:
            value = F.when(F.col("_rn") == 1, first).otherwise(F.col(f"_lag_{c}"))
        out = out.withColumn(prefix + c, value)
    return out.select(*df.columns, *[prefix + c for c in cols])


def replicate_in_order(
    df: DataFrame, count_col: str, by: str, *, then: Sequence[str] = (), block: int = 4096, slots: int | None = None
) -> DataFrame:
    """Emit every row ``count_col`` times (then drop the column), sorted by ``by``
    descending, NULLs first; rows of one value by ``then`` within a task.

    Only blocks of at most ``block`` copies move: they are counted per value of
    ``by`` (few values: a calendar's days), which gives every value its share of
    the ``slots`` output tasks, several for a value with many copies; each task
    sorts its blocks and emits their copies last.  ``slots`` is the number of
    shuffle partitions by default.
    """
    spark = df.sparkSession
    slots = slots or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = F.col(count_col)
    number = F.floor((n - 1) / F.lit(block)).cast("bigint")
    blocks = df.where(n > 0).withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("bigint"), number))).withColumn(
        "_copies_here", F.least(F.lit(block).cast("bigint"), n - F.col("_blk") * block)
    )
    counted = df.where(n > 0).groupBy(F.col(by).cast("bigint").alias("v")).agg(F.sum(n).alias("n")).collect()
    share = max(1, -(-sum(r.n for r in counted) // slots))
    cells, before = [], 0
    for r in sorted(counted, key=lambda r: (r.v is not None, -(r.v or 0))):
        cells.append(f"({'CAST(NULL AS BIGINT)' if r.v is None else f'{r.v}L'}, {before}L, {r.n}L)")
        before += r.n
    if not cells:
        return df.limit(0).drop(count_col)
    places = spark.sql(f"SELECT * FROM VALUES {', '.join(cells)} AS t(_v, _before, _total)")
    placed = blocks.join(F.broadcast(places), F.col(by).cast("bigint").eqNullSafe(F.col("_v")))
    # A block's place among the copies of its value is drawn by its hash.
    place = F.col("_before") + F.pmod(F.xxhash64(*df.columns, "_blk"), F.col("_total"))
    moved = placed.withColumn("_slot", F.floor(place / share).cast("int")).repartitionById(slots, F.col("_slot"))
    ordered = moved.sortWithinPartitions(F.col(by).desc_nulls_first(), *then)
    copies = ordered.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies_here"))))
    return copies.select(*[c for c in df.columns if c != count_col])


def replicate(df: DataFrame, count_col: str, *, block: int = 4096, index_col: str | None = None) -> DataFrame:
    """Emit every row ``count_col`` times (then drop the column).

    Rows are first cut into blocks of at most ``block`` copies and the blocks are
    spread over the cluster, so a row with a huge count never makes one task
    build a huge array or write all copies alone.  ``index_col`` keeps the copy
    number (0-based), e.g. as a final sort tie-break so a range partitioner can
    split runs of identical rows.
    """
    n = F.col(count_col)
    blocks = df.where(n > 0).withColumn(
        "_blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / F.lit(block)).cast("bigint")))
    )
    spread = blocks.repartition(*[F.col(c) for c in df.columns], F.col("_blk"))
    copies = spread.withColumn(
        "_i",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(block).cast("bigint"), n - F.col("_blk") * block) - 1)),
    )
    if index_col:
        copies = copies.withColumn(index_col, F.col("_blk") * block + F.col("_i"))
    return copies.drop("_blk", "_i", count_col)
