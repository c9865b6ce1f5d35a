"""Campaign audiences from the report's recommendations (narrative, no SQL in
the reference): which segments get SMS offers and which in-store offers (N1),
and clients with repeated recent purchases (N2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.functions.joins import literal, one_row

# ---------------------------------------------------------------------------
# Fixed values (from the report's conclusion): segment -> recommended channel.
# ---------------------------------------------------------------------------
CHANNEL_SMS = "sms"
CHANNEL_IN_STORE = "in_store"
SEGMENT_CHANNELS: dict[str, str] = {
    "Чемпионы": CHANNEL_SMS,
    "Потенциальные лидеры": CHANNEL_SMS,
    "Перспективные": CHANNEL_SMS,
    "Лояльные": CHANNEL_SMS,
    "Низкоактивные крупные покупатели": CHANNEL_SMS,
    "Требуют внимания": CHANNEL_SMS,
    "Растущие": CHANNEL_IN_STORE,
    "Новички": CHANNEL_IN_STORE,
}


def campaign_audience(segments: DataFrame, *, channels: dict[str, str] | None = None) -> DataFrame:
    """client_id, rfm_group, channel — distinct clients of the segments that have a
    recommended channel.  The segment -> channel table is a constant map (narrow)."""
    table = channels or SEGMENT_CHANNELS
    lookup = F.create_map(*[x for g, ch in table.items() for x in (F.lit(g), F.lit(ch))])
    return (
        segments.select("client_id", "rfm_group", F.try_element_at(lookup, F.col("rfm_group")).alias("channel"))
        .where(F.col("channel").isNotNull())
        .distinct()
    )


def repeat_buyers(tx: DataFrame, *, months: int = 6, min_purchases: int = 3, today=None) -> DataFrame:
    """client_id, purchases — clients with at least ``min_purchases`` distinct
    receipts in the last ``months`` months before the newest receipt date
    (window ``(newest - months, newest]``; ``today`` when already known)."""
    if today is None:
        today = one_row(tx.agg(F.max("transaction_date").alias("d")))["d"]
    today = literal(today, "date")
    recent = tx.where(F.col("transaction_date") > F.add_months(today, -months))
    return (
        recent.groupBy("client_id")
        .agg(F.countDistinct("doc_id").alias("purchases"))
        .where(F.col("purchases") >= min_purchases)
    )
