"""Optional dashboard filters (period, shop, segment, parameter pattern).

Every filter defaults to ``None`` = not applied.  Each operator applies a filter
at the same point of its pipeline as the reference card does; these helpers
only build the predicates, so Catalyst can push them into the Parquet scan.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmenta.functions.columns import as_list

DateLike = str | _dt.date | None


def _as_date(value: DateLike) -> _dt.date | None:
    if isinstance(value, _dt.datetime):  # a moment counts as its day
        return value.date()
    if value is None or isinstance(value, _dt.date):
        return value
    return _dt.date.fromisoformat(str(value)[:10])


def date_range_predicate(col: str | Column, date_range) -> Column | None:
    """``(start, end)`` inclusive calendar dates on a timestamp/date column.

    Written as ``col >= 'start' AND col < 'end + 1 day'``: the ISO string is
    cast to the column's own type (date, timestamp or timestamp_ntz), the
    comparison folds to a literal and reaches the Parquet scan as a pushed
    filter.  Either bound may be None (open).
    """
    if date_range is None:
        return None
    start, end = (_as_date(v) for v in date_range)
    c = F.col(col) if isinstance(col, str) else col
    preds = []
    if start is not None:
        preds.append(c >= F.lit(start.isoformat()))
    if end is not None:
        preds.append(c < F.lit((end + _dt.timedelta(days=1)).isoformat()))
    return reduce(lambda a, b: a & b, preds) if preds else None


def in_predicate(col: str | Column, values) -> Column | None:
    """Equality (one value) or ``IN`` (several); None = no filter."""
    vals = as_list(values)
    if vals is None:
        return None
    c = F.col(col) if isinstance(col, str) else col
    return c == F.lit(vals[0]) if len(vals) == 1 else c.isin(vals)


def ilike_predicate(col: str | Column, pattern: str | None) -> Column | None:
    """Case-insensitive LIKE; None = no filter."""
    if pattern is None:
        return None
    c = F.col(col) if isinstance(col, str) else col
    return c.ilike(pattern)


def apply_filters(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """AND together the supplied predicates, skipping the unset ones."""
    preds = [p for p in predicates if p is not None]
    if not preds:
        return df
    return df.where(reduce(lambda a, b: a & b, preds))
