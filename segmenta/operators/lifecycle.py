"""Customer lifecycle: month-cohort retention by segment (Q10), churn rate by
recency bucket (Q11), per-receipt churn-risk labels (Q12) and weekly retention
of site visitors (Q18).

Skew plan: each operator first reduces the event rows to a grain bounded by the
calendar per key — distinct (client, month), (client, day) or (user, day) —
with a partial aggregate that spreads a hot key over many tasks.  Only those
reduced rows meet per-key windows or joins, so no task ever holds all the rows
of one client or user.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmenta.functions.columns import (
    days_between,
    mean,
    month_start,
    months_between_starts,
    percent,
    ratio,
    whole_weeks_between,
)
from segmenta.functions.joins import literal, one_row
from segmenta.functions.limits import ordered_limit
from segmenta.functions.sequence import replicate_in_order
from segmenta.operators.filters import apply_filters, in_predicate
from segmenta.operators.rfm import as_receipts
from segmenta.operators.value import segment_weights
from segmenta.sources.tables import require_columns

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's): output labels.
# ---------------------------------------------------------------------------
RECENCY_UP_TO_30 = "До 30 дней"
RECENCY_OVER_90 = "Более 90 дней"
RECENCY_31_90 = "31-90 дней"
RISK_LOW = "низкий риск ухода"
RISK_MEDIUM = "средний риск ухода"
RISK_HIGH = "высокий риск ухода"


def _date_lit(value) -> Column:
    if value is None:
        return F.current_date()
    if isinstance(value, _dt.date):
        value = value.isoformat()
    return F.to_date(F.lit(str(value)[:10]))


# ---------------------------------------------------------------------------
# Q10 cohort_retention
# ---------------------------------------------------------------------------


def cohort_retention(tx: DataFrame, segments: DataFrame, *, rfm_group=None, published_columns: bool = False) -> DataFrame:
    """cohort_month, rfm_group, retained_users, cohort_users, retention_rate,
    months_after_first — sorted by cohort_month, months_after_first, rfm_group.

    Cohort = month of the client's first purchase; a client counts in every
    segment it belongs to; ``retained_users`` = distinct clients active
    ``months_after_first`` months later; ``cohort_users`` = those at offset 0.
    ``published_columns=True`` drops months_after_first (the printed card's
    five columns, told apart only by order).
    """
    client_months = tx.select("client_id", month_start("transaction_date").alias("tx_month")).distinct()
    # Cohort = first month of the client: a window over the client's distinct
    # months (bounded by the calendar), so no aggregate-and-join-back.
    cohort = F.min("tx_month").over(Window.partitionBy("client_id"))
    offsets = client_months.withColumn("cohort_month", cohort).select(
        "client_id",
        "cohort_month",
        months_between_starts("tx_month", "cohort_month").alias("months_after_first"),
    )
    groups = apply_filters(
        segments.select("client_id", "rfm_group"), in_predicate("rfm_group", rfm_group)
    ).distinct()
    # (client, offset) and (client, segment) are both distinct: COUNT(*) = COUNT(DISTINCT client).
    retained = (
        offsets.join(groups, "client_id")
        .groupBy("cohort_month", "rfm_group", "months_after_first")
        .agg(F.count(F.lit(1)).alias("retained_users"))
    )
    # Cohort size = the offset-0 count of the same (cohort, segment): a window
    # over the aggregated rows (at most one per month offset), not a self-join.
    size_w = Window.partitionBy("cohort_month", "rfm_group")
    cohort_users = F.max(F.when(F.col("months_after_first") == 0, F.col("retained_users"))).over(size_w)
    out = (
        retained.withColumn("cohort_users", cohort_users)
        .where(F.col("cohort_users").isNotNull())
        .select(
            "cohort_month",
            "rfm_group",
            F.col("retained_users").cast("bigint").alias("retained_users"),
            F.col("cohort_users").cast("bigint").alias("cohort_users"),
            ratio(F.least("retained_users", "cohort_users"), "cohort_users", 2).alias("retention_rate"),
            "months_after_first",
        )
        .orderBy(*[F.col(c).asc_nulls_last() for c in ("cohort_month", "months_after_first", "rfm_group")])
    )
    if published_columns:
        out = out.drop("months_after_first")
    return out


# ---------------------------------------------------------------------------
# Q11 churn_rate
# ---------------------------------------------------------------------------


def _daily_with_next(tx: DataFrame) -> DataFrame:
    """(client_id, transaction_date, rows, next_date): next *distinct* purchase day.

    Per client there is at most one row per calendar day, so the window is
    bounded by the time span however many receipts a client has."""
    daily = as_receipts(tx).groupBy("client_id", "transaction_date").agg(F.sum("lines").alias("rows"))
    w = Window.partitionBy("client_id").orderBy("transaction_date")
    return daily.withColumn("next_date", F.lead("transaction_date").over(w))


def churn_rate(
    tx: DataFrame,
    segments: DataFrame,
    *,
    as_of=None,
    gap_days: int = 90,
    buckets: tuple[int, int] = (30, 90),
    rfm_group=None,
    keep_middle: bool = False,
) -> DataFrame:
    """recency_group, rfm_group, total_clients, churn_clients, churn_percent.

    A receipt row is flagged when the client's next receipt row (by date) is
    missing or more than ``gap_days`` later.  Receipts on the same day: all
    but one have a same-day successor, so per (client, day) exactly one row can
    be flagged.  Buckets use ``as_of`` (default: today) minus the receipt date;
    the middle bucket is dropped unless ``keep_middle``.  Counts are receipt
    rows weighted by the client's shop rows in the segment.
    """
    low, high = buckets
    today = _date_lit(as_of)
    daily = _daily_with_next(tx)
    age = F.datediff(today, F.col("transaction_date"))
    bucket = (
        F.when(age <= low, F.lit(RECENCY_UP_TO_30))
        .when(age > high, F.lit(RECENCY_OVER_90))
        .otherwise(F.lit(RECENCY_31_90))
    )
    flagged = F.col("next_date").isNull() | (F.col("next_date") > F.date_add("transaction_date", gap_days))
    per_client = (
        daily.withColumn("recency_group", bucket)
        .where(F.lit(True) if keep_middle else F.col("recency_group").isin(RECENCY_UP_TO_30, RECENCY_OVER_90))
        .groupBy("client_id", "recency_group")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum(F.when(flagged, 1).otherwise(0)).alias("flagged"),
        )
    )
    weights = segment_weights(segments, rfm_group)
    totals = (
        per_client.join(weights, "client_id")
        .groupBy("recency_group", "rfm_group")
        .agg(
            F.sum(F.col("rows") * F.col("k")).alias("total_clients"),
            F.sum(F.col("flagged") * F.col("k")).alias("churn_clients"),
        )
    )
    return totals.select(
        "recency_group",
        "rfm_group",
        F.col("total_clients").cast("bigint").alias("total_clients"),
        F.col("churn_clients").cast("bigint").alias("churn_clients"),
        percent("churn_clients", "total_clients", 2).alias("churn_percent"),
    ).orderBy(F.col("rfm_group").asc_nulls_last(), F.col("churn_percent").desc_nulls_first())


# ---------------------------------------------------------------------------
# Q12 churn_risk_segment
# ---------------------------------------------------------------------------


def churn_risk_segment(
    tx: DataFrame,
    segments: DataFrame,
    *,
    bounds: tuple[int, int] = (30, 90),
    rfm_group=None,
    today=None,
) -> DataFrame:
    """client_id, rfm_group, transaction_date, recency_days, churn_risk_segment.

    One row per receipt row and per shop row of the client (the reference's
    client-only join), age measured against the newest receipt date (``today``,
    taken from the segments when not given);
    sorted by age, descending.  Receipt rows are first counted per
    (client, day), so the join only sees calendar-bounded rows per client; the
    counted rows are sorted and their copies emitted after the sort.
    """
    low, high = bounds
    if today is None:  # newest receipt date, as carried by the segments
        today = one_row(segments.agg(F.max("current_dt").alias("d")))["d"]
    today = literal(today, "date")
    per_day = as_receipts(tx).groupBy("client_id", "transaction_date").agg(F.sum("lines").alias("rows"))
    weights = segment_weights(segments, rfm_group)
    age = days_between(today, "transaction_date")
    label = (
        F.when(F.col("recency_days") <= low, F.lit(RISK_LOW))
        .when(F.col("recency_days").between(low + 1, high), F.lit(RISK_MEDIUM))
        .otherwise(F.lit(RISK_HIGH))
    )
    rows = (
        per_day.join(weights, "client_id")
        .select(
            "client_id",
            "rfm_group",
            "transaction_date",
            age.alias("recency_days"),
            (F.col("rows") * F.col("k")).alias("_copies"),
        )
        .withColumn("churn_risk_segment", label)
    )
    return replicate_in_order(rows, "_copies", "recency_days", then=("client_id", "rfm_group"))


def avg_interval_by_churn_risk(tx: DataFrame, *, bounds: tuple[int, int] = (30, 90), today=None) -> DataFrame:
    """churn_risk_segment, clients_count, avg_interval_days — how many days clients of each
    risk let pass between two purchase days, on average over all their intervals.

    A client's risk is that of the newest purchase (as in :func:`churn_risk_segment`), against the
    newest receipt date.  The intervals of a client add up to last minus first day, and number one
    less than the distinct days, so no row meets its successor.  Clients of a single day count, but
    have no interval; a risk without any interval has a NULL mean.
    """
    low, high = bounds
    days = tx.select("client_id", "transaction_date").where(F.col("transaction_date").isNotNull()).distinct()
    per_client = days.groupBy("client_id").agg(
        F.max("transaction_date").alias("last"), F.min("transaction_date").alias("first"), F.count(F.lit(1)).alias("days")
    )
    if today is None:
        today = one_row(days.agg(F.max("transaction_date").alias("d")))["d"]
    age = days_between(literal(today, "date"), "last")
    label = F.when(age <= low, F.lit(RISK_LOW)).when(age <= high, F.lit(RISK_MEDIUM)).otherwise(F.lit(RISK_HIGH))
    return (
        per_client.groupBy(label.alias("churn_risk_segment"))
        .agg(
            F.count(F.lit(1)).alias("clients_count"),
            F.sum(days_between("last", "first")).alias("total"),
            F.sum(F.col("days") - 1).alias("intervals"),
        )
        .select("churn_risk_segment", "clients_count", mean("total", "intervals", 1).alias("avg_interval_days"))
        .orderBy("churn_risk_segment")
    )


# ---------------------------------------------------------------------------
# Q18 weekly_retention
# ---------------------------------------------------------------------------


def weekly_retention(entries: DataFrame, *, row_cap: int | None = None) -> DataFrame:
    """cohort_month, weeks_since_first, retention_percent.

    Cohort = month of the user's first entry; week index = whole weeks (exact,
    sub-second) since that first entry; percent of the cohort active in that
    exact week, weeks > 0 only; sorted by cohort then week.  Entries without a
    user or a time do not count.

    Entries are first reduced to (user, day) min/max: a day is shorter than a
    week, so the weeks a user touches on a day are exactly those of that day's
    first and last entry.  ``row_cap`` reproduces the dashboard export cap
    (1,048,575) when set; by default the result is whole.
    """
    require_columns(entries, ["user_id", "entry_at"], "userentry")
    daily = entries.where(F.col("entry_at").isNotNull() & F.col("user_id").isNotNull()).groupBy(
        "user_id", F.to_date("entry_at").alias("_day")
    ).agg(F.min("entry_at").alias("_lo"), F.max("entry_at").alias("_hi"))
    # First visit by a window over the user's days (bounded by the calendar),
    # not an aggregate joined back.
    daily = daily.withColumn("first_visit", F.min("_lo").over(Window.partitionBy("user_id")))
    touched = daily.select(
        "user_id",
        month_start("first_visit").alias("cohort_month"),
        F.explode(
            F.array(
                whole_weeks_between("_lo", "first_visit"),
                whole_weeks_between("_hi", "first_visit"),
            )
        ).alias("weeks_since_first"),
    )
    # All rows of a user lie in one task since the window, so the distinct needs no
    # exchange; only counts per (cohort, week) move.
    active = (
        touched.where(F.col("weeks_since_first") > 0)
        .distinct()
        .groupBy("cohort_month", "weeks_since_first")
        .agg(F.count(F.lit(1)).alias("active_users"))
    )
    # Exactly one day per user starts at its first visit: one row per user.
    sizes = (
        daily.where(F.col("_lo") == F.col("first_visit"))
        .groupBy(month_start("first_visit").alias("cohort_month"))
        .agg(F.count(F.lit(1)).alias("cohort_size"))
    )
    out = active.join(sizes, "cohort_month").select(
        "cohort_month",
        "weeks_since_first",
        percent("active_users", "cohort_size", 2).alias("retention_percent"),
    )
    order = ["cohort_month", "weeks_since_first"]
    if row_cap is not None:
        return ordered_limit(out, row_cap, order)
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in order])
