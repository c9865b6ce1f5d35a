"""Campaign parameters from URLs (Q19), per-user attribution fill (Q20), long
form (Q21) and event counts per parameter (Q22).

Plan at scale: the query string is split once in the scan stage and its tokens
are folded into the four values;
the fill is a per-user LAG computed in pieces of bounded size
(``functions.sequence``) so the anonymous / NULL uid does not land in one task; the long form is one
``explode`` over the four columns (a single pass, not four unions); the counts
are a partial + final hash aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.functions.columns import url_values
from segmenta.functions.sequence import DEFAULT_PIECE_ROWS, lag_by_key
from segmenta.operators.filters import apply_filters, date_range_predicate
from segmenta.sources.tables import require_columns

# Fixed values (must equal the reference's): parameter keys, in output order.
PARAM_KEYS: tuple[str, ...] = ("discount", "utm_source", "funnel", "source")


def url_params(
    stat: DataFrame,
    keys: Sequence[str] = PARAM_KEYS,
    *,
    date_range=None,
    exact_key: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """uid, event, created_at, the columns to ``keep`` (such as the log's own
    event id) and one column per key (NULL when absent or empty).

    The period filter applies here, before the fill, so rows outside it cannot
    lend values to rows inside.
    """
    require_columns(stat, ["uid", "event", "created_at", "url_params", *keep], "stat")
    rows = apply_filters(stat, date_range_predicate("created_at", date_range))
    parsed = rows.withColumn("_values", url_values("url_params", keys, exact_key=exact_key))
    return parsed.select("uid", "event", "created_at", *keep, *[F.col("_values")[k].alias(k) for k in keys])


def attribution_fill(
    parsed: DataFrame,
    keys: Sequence[str] = PARAM_KEYS,
    *,
    carry_forward: bool = False,
    tiebreak: Sequence[str] = (),
    chunk_seconds: int = 3600,
    piece_rows: int = DEFAULT_PIECE_ROWS,
) -> DataFrame:
    """uid, event, created_at, the tie-break columns, <key>_filled for every key.

    Faithful default: a missing value takes the value of the user's
    immediately preceding row (by created_at, rows without a time last; rows of
    one instant by the tie-break) — one row back only, so two blanks in a row
    leave the second blank.  ``carry_forward=True`` takes the
    last non-missing earlier value instead.
    """
    with_prev = lag_by_key(
        parsed,
        "uid",
        "created_at",
        list(keys),
        tiebreak=tiebreak,
        chunk_seconds=chunk_seconds,
        piece_rows=piece_rows,
        ignore_nulls=carry_forward,
        prefix="_prev_",
    )
    return with_prev.select(
        "uid",
        "event",
        "created_at",
        *tiebreak,
        *[F.coalesce(F.col(k), F.col(f"_prev_{k}")).alias(f"{k}_filled") for k in keys],
    )


def param_rows(filled: DataFrame, keys: Sequence[str] = PARAM_KEYS) -> DataFrame:
    """uid, event, param — one row per present filled value, ``param = 'key=value'``."""
    pairs = F.array(
        *[F.concat(F.lit(f"{k}="), F.col(f"{k}_filled")) for k in keys]
    )
    return (
        filled.select("uid", "event", F.explode(pairs).alias("param"))
        .where(F.col("param").isNotNull())
    )


def param_event_counts(rows: DataFrame) -> DataFrame:
    """params, event, cnt — events per (parameter, event), most frequent first."""
    return (
        rows.groupBy(F.col("param").alias("params"), "event")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.col("cnt").desc())
    )
