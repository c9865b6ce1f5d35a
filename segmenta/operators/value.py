"""Customer value: lifetime value (Q07), seasonality index (Q08), revenue share
of the high-value segments (Q09) and the KPI cards over it (Q27).

The reference joins receipts to the segment table on ``client_id`` only, while
the segment grain is (client, shop): every receipt is counted once per shop row
the client has in a segment.  The same numbers come from client-level
aggregates, with no row expansion:

    segment weight  k(c, g) = number of (client, shop) rows of client c in segment g
    revenue(c, g)           = k(c, g) * sum of c's amounts

so receipts are aggregated once (hot clients split by the partial aggregate)
and only client-grain tables are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmenta.operators.filters import apply_filters, in_predicate
from segmenta.operators.rfm import as_receipts

HIGH_VALUE = "High M + Good R/F"
OTHER = "Other"


def segment_weights(segments: DataFrame, rfm_group=None) -> DataFrame:
    """(client_id, rfm_group, k): how many (client, shop) rows a client has in a segment."""
    seg = apply_filters(segments.select("client_id", "rfm_group"), in_predicate("rfm_group", rfm_group))
    return seg.groupBy("client_id", "rfm_group").agg(F.count(F.lit(1)).alias("k"))


# ---------------------------------------------------------------------------
# Q07 ltv
# ---------------------------------------------------------------------------


def ltv(tx: DataFrame, segments: DataFrame, *, rfm_group=None) -> DataFrame:
    """client_id, revenue, active_month, revenue_per_active_month.

    One row per (client, segment) the client belongs to (the segment itself is
    not output, as in the reference).  ``active_month`` counts distinct month
    *numbers* (1..12, years merged); revenue is weighted by the client's shop
    rows in that segment; the segment filter is ``IN``.
    """
    per_client = as_receipts(tx).groupBy("client_id").agg(
        F.sum("purchase_amount").alias("amount"),
        F.countDistinct(F.month("transaction_date")).alias("active_month"),
    )
    weights = segment_weights(segments, rfm_group)
    joined = weights.join(per_client, "client_id")
    revenue = (F.col("amount") * F.col("k")).cast("double")
    return joined.select(
        "client_id",
        revenue.alias("revenue"),
        F.col("active_month").cast("bigint").alias("active_month"),
        (revenue / F.nullif(F.col("active_month"), F.lit(0))).alias("revenue_per_active_month"),
    )


# ---------------------------------------------------------------------------
# Q08 seasonality_index
# ---------------------------------------------------------------------------


def seasonality_index(tx: DataFrame, segments: DataFrame, *, rfm_group=None) -> DataFrame:
    """month (1..12), seasonality_index = mean monthly revenue of that calendar
    month (over the (year, segment) combinations present) / mean of those
    monthly means, rounded to 2 decimals; sorted by month."""
    per_client_month = as_receipts(tx).groupBy(
        "client_id",
        F.year("transaction_date").alias("year"),
        F.month("transaction_date").alias("month"),
    ).agg(F.sum("purchase_amount").alias("amount"))
    weights = segment_weights(segments, rfm_group)
    monthly = (
        per_client_month.join(weights, "client_id")
        .groupBy("year", "month", "rfm_group")
        .agg(F.sum(F.col("amount") * F.col("k")).alias("total_amount"))
    )
    by_month = monthly.groupBy("month").agg(F.avg("total_amount").alias("avg_amount"))
    # At most 12 rows: the mean of the monthly means is a window over all of
    # them (one tiny partition), so the monthly branch is computed once.
    overall = F.avg("avg_amount").over(Window.partitionBy())
    index = F.round(F.col("avg_amount") / overall, 2).cast("double")
    return by_month.select(F.col("month").cast("int").alias("month"), index.alias("seasonality_index")).orderBy(
        "month"
    )


# ---------------------------------------------------------------------------
# Q09 segment_revenue_share, Q27 kpi_cards
# ---------------------------------------------------------------------------


def segment_revenue_share(segments: DataFrame, *, rfm_group=None) -> DataFrame:
    """segment, rfm_group, clients_count, total_revenue, total_purchases, avg_check,
    revenue_share_percent — sorted by share, descending.

    ``segment`` is 'High M + Good R/F' when all three ranks are 0 or 1.  The
    printed card reads ranks and measures from a relation that lacks them; this
    carries them on the same (client, shop) row instead (no join).  Counts are
    (client, shop) rows; the share's denominator is the total after the filter.
    """
    good = lambda c: F.col(c).isin(0, 1)
    flagged = segments.withColumn(
        "segment",
        F.when(good("m_rank") & good("r_rank") & good("f_rank"), F.lit(HIGH_VALUE)).otherwise(F.lit(OTHER)),
    )
    flagged = apply_filters(flagged, in_predicate("rfm_group", rfm_group))
    grouped = flagged.groupBy("segment", "rfm_group").agg(
        F.count(F.lit(1)).alias("clients_count"),
        F.sum("monetary").alias("total_revenue"),
        F.sum("frequency").alias("total_purchases"),
    )
    # At most 2 x 13 grouped rows: the grand total is a window over all of them
    # (one tiny partition), so the grouped branch is computed once.
    all_revenue = F.sum("total_revenue").over(Window.partitionBy())
    revenue = F.col("total_revenue").cast("double")
    # 100 * revenue is exact in decimal; the quotient of two money sums is taken in double.
    share = F.round((F.expr("100.0") * F.col("total_revenue")).cast("double") / all_revenue.cast("double"), 2)
    return (
        grouped.select(
            "segment",
            "rfm_group",
            F.col("clients_count").cast("bigint").alias("clients_count"),
            revenue.alias("total_revenue"),
            F.col("total_purchases").cast("bigint").alias("total_purchases"),
            (revenue / F.col("clients_count")).alias("avg_check"),
            share.alias("revenue_share_percent"),
        )
        .orderBy(F.col("revenue_share_percent").desc_nulls_first())
    )


def kpi_cards(segments: DataFrame, *, rfm_group=None) -> DataFrame:
    """One row of dashboard totals behind :func:`segment_revenue_share`:
    high_value_share_percent, total_purchases, clients_count, total_revenue, avg_check.

    A single global aggregate over the (client, shop) rows (partial per task,
    one row out); money is summed in exact decimal and cast once at the end.
    """
    good = lambda c: F.col(c).isin(0, 1)
    high = good("m_rank") & good("r_rank") & good("f_rank")
    rows = apply_filters(segments, in_predicate("rfm_group", rfm_group))
    totals = rows.agg(
        F.sum(F.when(high, F.col("monetary"))).alias("_high"),
        F.sum("monetary").alias("_revenue"),
        F.sum("frequency").cast("bigint").alias("total_purchases"),
        F.count(F.lit(1)).cast("bigint").alias("clients_count"),
    )
    revenue = F.col("_revenue").cast("double")
    high_share = (F.expr("100.0") * F.coalesce(F.col("_high"), F.lit(0))).cast("double") / revenue
    return totals.select(
        F.round(high_share, 2).alias("high_value_share_percent"),
        "total_purchases",
        "clients_count",
        revenue.alias("total_revenue"),
        (revenue / F.col("clients_count")).alias("avg_check"),
    )
