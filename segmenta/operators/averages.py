"""Mean recency / spend / frequency per segment (Q13-Q15).

The reference joins segments to measures on client only and then to segments
again, so for a client c with n (client, shop) rows, S = sum of its non-NULL
measure values, m = their number and k(g) rows in segment g:

    mean(g) = sum_c k(g) * n * S  /  sum_c k(g) * n * m

computed from two client-grain aggregates; nothing is expanded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.functions.columns import mean
from segmenta.operators.value import segment_weights

MEASURE_OUTPUT = {
    "recency": "avg_interval_days",
    "monetary": "avg_spend",
    "frequency": "avg_frequency",
}


def segment_average(segments: DataFrame, measure: str, *, rfm_group=None, digits: int = 1) -> DataFrame:
    """rfm_group, <avg column> (1 decimal), sorted by the mean, descending."""
    if measure not in MEASURE_OUTPUT:
        raise ValueError(f"measure must be one of {sorted(MEASURE_OUTPUT)}")
    out_name = MEASURE_OUTPUT[measure]
    per_client = segments.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(measure).alias("s"),
        F.count(measure).alias("m"),
    )
    weights = segment_weights(segments, rfm_group)
    totals = (
        weights.join(per_client, "client_id")
        .groupBy("rfm_group")
        .agg(
            F.sum(F.col("s") * F.col("k") * F.col("n")).alias("total"),
            F.sum(F.col("m") * F.col("k") * F.col("n")).alias("cnt"),
        )
        .where(F.col("cnt") > 0)
    )
    return totals.select("rfm_group", mean("total", "cnt", digits).alias(out_name)).orderBy(
        F.col(out_name).desc_nulls_first()
    )


def avg_recency_by_segment(segments: DataFrame, *, rfm_group=None) -> DataFrame:
    return segment_average(segments, "recency", rfm_group=rfm_group)


def avg_spend_by_segment(segments: DataFrame, *, rfm_group=None) -> DataFrame:
    return segment_average(segments, "monetary", rfm_group=rfm_group)


def avg_frequency_by_segment(segments: DataFrame, *, rfm_group=None) -> DataFrame:
    return segment_average(segments, "frequency", rfm_group=rfm_group)
