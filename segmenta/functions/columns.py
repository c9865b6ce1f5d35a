"""Column expressions shared by the operators (all JVM-side, codegen-friendly).

Numeric rule: the reference computes ratios in exact NUMERIC.  Spark keeps a
decimal literal exact, so ``100.0 * k / n`` stays decimal until the final
ROUND and ties round half-up exactly as NUMERIC does; the rounded value is then
cast to double for output.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_WEEK = 7 * 24 * 60 * 60 * 1_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def percent(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    """``ROUND(100.0 * part / whole, digits)`` in exact decimal, NULL when whole is 0."""
    # decimal(20,0) operands keep 14 fractional digits through the division,
    # so no false rounding tie appears below ~1e12 rows.
    q = F.expr("100.0") * _col(part).cast("decimal(20,0)") / F.nullif(
        _col(whole).cast("decimal(20,0)"), F.lit(0)
    )
    return F.round(q, digits).cast("double")


def ratio(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    """``ROUND(part::numeric / NULLIF(whole, 0), digits)`` in exact decimal."""
    q = _col(part).cast("decimal(20,0)") / F.nullif(_col(whole).cast("decimal(20,0)"), F.lit(0))
    return F.round(q, digits).cast("double")


def mean(total: Column | str, count: Column | str, digits: int = 1) -> Column:
    """``ROUND(total / count, digits)`` for an AVG built from an exact sum and a count.

    ``total`` may be integral or decimal; division happens in decimal so the
    rounding tie behaves like NUMERIC.
    """
    t = _col(total)
    q = t.cast("decimal(28,4)") / F.nullif(_col(count).cast("decimal(20,0)"), F.lit(0))
    return F.round(q, digits).cast("double")


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Integer days ``later - earlier`` (date minus date)."""
    return F.datediff(_col(later), _col(earlier)).cast("bigint")


def month_start(c: Column | str) -> Column:
    """First day of the month as a DATE (the reference's month truncation)."""
    return F.trunc(_col(c), "MM")


def months_between_starts(later_month: Column | str, earlier_month: Column | str) -> Column:
    """Whole months between two month starts (``AGE`` folded to months)."""
    return F.months_between(_col(later_month), _col(earlier_month)).cast("int")


def whole_weeks_between(later_ts: Column | str, earlier_ts: Column | str) -> Column:
    """``FLOOR(epoch seconds of (later - earlier) / 604800)`` with sub-second precision.

    ``timestamp_diff`` works on the values themselves: for timestamp_ntz no
    session time zone (and no daylight-saving hour) enters the difference."""
    delta = F.timestamp_diff("MICROSECOND", _col(earlier_ts), _col(later_ts))
    return F.floor(delta / F.lit(MICROS_PER_WEEK)).cast("bigint")


def _token_value(token: Column, key: str, exact_key: bool) -> Column:
    """The value that the last ``key=`` of a token without ``&`` gives, NULL without one.  A
    ``key=`` at the very end has no value; then the one before it counts, if there is one."""
    sign = f"?{key}=" if exact_key else f"{key}="
    text = F.concat(F.lit("?"), token) if exact_key else token
    from_last, from_one_before = (F.substring_index(text, sign, -n) for n in (1, 2))
    ends = F.endswith(text, F.lit(sign))
    return F.when(F.contains(text, F.lit(sign)), F.when(~ends, from_last).when(from_one_before != text, from_one_before))


def url_values(url: Column | str, keys, exact_key: bool = False) -> Column:
    """A struct with the value of every key in a query string, NULL when absent or empty.

    The string is split once at ``&``, and its tokens are folded into the struct, later ones
    over earlier ones.  Faithful mode (default): the *last* ``key=`` followed by a non-empty
    value wins, the value runs to the next ``&``, and the key may end another name (``source``
    also matches inside ``utm_source``).  ``exact_key=True`` wants the key at the start of the
    string or after a ``?`` or ``&``.
    """
    nothing = F.struct(*[F.lit(None).cast("string").alias(k) for k in keys])

    def fold(found: Column, token: Column) -> Column:
        return F.struct(*[F.coalesce(_token_value(token, k, exact_key), found[k]).alias(k) for k in keys])

    return F.aggregate(F.split(_col(url), "&"), nothing, fold)


def as_list(value) -> list | None:
    """Accept a scalar or an iterable for list-valued filters; None stays None."""
    if value is None:
        return None
    if isinstance(value, (str, bytes)):
        return [value]
    return list(value)
