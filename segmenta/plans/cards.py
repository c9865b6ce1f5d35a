"""Dashboard cards: each registered query reads the driver's tables for one scale
factor, builds the fixture views and runs one operator with fixed parameters.

Every card returns a lazy DataFrame over the *whole* input tables; the
parameters below (clock values, filter values) are the ones the DuckDB oracle
in :mod:`segmenta.plans.oracle` uses as well.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.operators import attribution, audience, averages, funnel, lifecycle, registrations, rfm, value
from segmenta import sinks
from segmenta.session import scratch_path
from segmenta.sources import contracts, tables

# Fixed clocks for reproducible results (the reference uses NOW / CURRENT_DATE).
CHURN_AS_OF = "2001-08-15"
REGISTRATIONS_AS_OF = "2001-06-15"

# Filter values used by the filtered cards (Q26).
FILTER_DATE_RANGE = ("1996-01-01", "2000-12-31")
FILTER_SHOPS = ("1-URGENT", "2-HIGH", "3-MEDIUM")
FILTER_GROUP = "Потенциальные лидеры"
FILTER_GROUPS = ("Чемпионы", "Лояльные", "Спящие")
FILTER_PARAM = "UTM_SOURCE=%"
FILTER_STAT_PERIOD = ("2024-01-10", "2024-01-20")

# Click-stream rows of one instant follow each other by the log's own id.
EVENT_ID = ("event_id",)
# Rows of a piece in the cards over the irregular click-stream, whose anonymous
# rows are cut into many pieces at every scale.
FEW_ROWS = 200

# The dashboard's export cap, and one that cuts the test data.
EXPORT_CAP = 1_048_575
SMALL_CAP = 500

Card = Callable[[SparkSession, str], DataFrame]


def _on_scoring(*, receipts: bool = False, **filters):
    """A card over the scoring of all receipts (under dashboard filters).  The cached
    tables belong to the card's result and go with it."""

    def wrap(operator: Callable[[rfm.Scoring], DataFrame]) -> Card:
        @functools.wraps(operator)
        def card(spark: SparkSession, sf_dir: str) -> DataFrame:
            cheques, shops = tables.bonuscheques(spark, sf_dir), tables.shops(spark, sf_dir)
            scoring = rfm.score(cheques, shops, keep_receipts=receipts, **filters)
            return scoring.lend(operator(scoring))

        return card

    return wrap


def _money(df: DataFrame, *cols: str) -> DataFrame:
    """Cast decimal money columns to double for output."""
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


# --- RFM core (Q01-Q06) -----------------------------------------------------


def q_transactions(spark, sf_dir):
    tx = rfm.transactions(tables.bonuscheques(spark, sf_dir), tables.shops(spark, sf_dir), with_current_dt=True)
    return _money(
        tx.select("client_id", "doc_id", "shop", "transaction_date", "current_dt", "purchase_amount"),
        "purchase_amount",
    )


@_on_scoring()
def q_rfm_base(sc):
    return _money(sc.base.select("client_id", "shop", "recency", "frequency", "monetary"), "monetary")


@_on_scoring()
def q_rfm_thresholds(sc):
    return sc.thresholds


@_on_scoring()
def q_rfm_ranks(sc):
    return sc.segments.select("client_id", "shop", "r_rank", "f_rank", "m_rank")


@_on_scoring()
def q_rfm_segments(sc):
    return sc.segments.select("client_id", "rfm_code", "shop", "rfm_group")


@_on_scoring()
def q_rfm_report(sc):
    return rfm.rfm_report(sc.base, sc.segments)


@_on_scoring()
def q_rfm_report_by_shop(sc):
    return rfm.rfm_report(sc.base, sc.segments, join_on=("client_id", "shop"))


# --- value (Q07-Q09, Q27) ---------------------------------------------------


@_on_scoring(receipts=True)
def q_ltv(sc):
    return value.ltv(sc.receipts, sc.segments)


@_on_scoring(receipts=True)
def q_seasonality_index(sc):
    return value.seasonality_index(sc.receipts, sc.segments)


@_on_scoring()
def q_segment_revenue_share(sc):
    return value.segment_revenue_share(sc.segments)


@_on_scoring()
def q_kpi_cards(sc):
    return value.kpi_cards(sc.segments)


# --- lifecycle (Q10-Q12, Q18) -----------------------------------------------


@_on_scoring(receipts=True)
def q_cohort_retention(sc):
    return lifecycle.cohort_retention(sc.receipts, sc.segments)


@_on_scoring(receipts=True)
def q_churn_rate(sc):
    return lifecycle.churn_rate(sc.receipts, sc.segments, as_of=CHURN_AS_OF)


@_on_scoring(receipts=True)
def q_churn_risk_segment(sc):
    return lifecycle.churn_risk_segment(sc.receipts, sc.segments, today=sc.today)


def q_weekly_retention(spark, sf_dir):
    return lifecycle.weekly_retention(tables.userentry(spark, sf_dir))


def q_weekly_retention_cohorts(spark, sf_dir):
    return lifecycle.weekly_retention(tables.userentry_months(spark, sf_dir))


def q_weekly_retention_exported(spark, sf_dir):
    """With the dashboard's export cap."""
    return lifecycle.weekly_retention(tables.userentry_months(spark, sf_dir), row_cap=EXPORT_CAP)


def q_weekly_retention_capped(spark, sf_dir):
    """With a cap below the number of rows."""
    return lifecycle.weekly_retention(tables.userentry_months(spark, sf_dir), row_cap=SMALL_CAP)


@_on_scoring(receipts=True)
def q_avg_interval_by_churn_risk(sc):
    return lifecycle.avg_interval_by_churn_risk(sc.receipts, today=sc.today)


# --- segment averages (Q13-Q15) ---------------------------------------------


@_on_scoring()
def q_avg_recency_by_segment(sc):
    return averages.avg_recency_by_segment(sc.segments)


@_on_scoring()
def q_avg_spend_by_segment(sc):
    return averages.avg_spend_by_segment(sc.segments)


@_on_scoring()
def q_avg_frequency_by_segment(sc):
    return averages.avg_frequency_by_segment(sc.segments)


# --- registrations (Q16, Q17) -----------------------------------------------


def q_registrations_daily(spark, sf_dir):
    return registrations.registrations_daily(tables.users(spark, sf_dir), as_of=REGISTRATIONS_AS_OF)


def q_registrations_monthly(spark, sf_dir):
    return registrations.registrations_monthly(tables.users(spark, sf_dir))


# --- attribution and funnel (Q19-Q25) ---------------------------------------


def _parsed(spark, sf_dir, **kw):
    return attribution.url_params(tables.stat(spark, sf_dir), **kw)


def _filled(spark, sf_dir, **kw):
    return attribution.attribution_fill(_parsed(spark, sf_dir, keep=EVENT_ID, **kw), tiebreak=EVENT_ID)


def _param_rows(spark, sf_dir):
    return attribution.param_rows(_filled(spark, sf_dir))


def q_url_params(spark, sf_dir):
    return _parsed(spark, sf_dir)


def q_url_params_exact_key(spark, sf_dir):
    return _parsed(spark, sf_dir, exact_key=True)


def q_attribution_fill(spark, sf_dir):
    return _filled(spark, sf_dir).drop(*EVENT_ID)


def q_attribution_carry_forward(spark, sf_dir):
    parsed = _parsed(spark, sf_dir, keep=EVENT_ID)
    return attribution.attribution_fill(parsed, tiebreak=EVENT_ID, carry_forward=True).drop(*EVENT_ID)


def _irregular(spark, sf_dir, **kw):
    parsed = attribution.url_params(tables.stat_irregular(spark, sf_dir), keep=EVENT_ID)
    return attribution.attribution_fill(parsed, tiebreak=EVENT_ID, piece_rows=FEW_ROWS, **kw)


def q_attribution_fill_irregular(spark, sf_dir):
    """Tied and missing times, a third of the rows anonymous; pieces of few rows."""
    return _irregular(spark, sf_dir)


def q_attribution_carry_forward_irregular(spark, sf_dir):
    return _irregular(spark, sf_dir, carry_forward=True)


def q_param_event_counts_irregular(spark, sf_dir):
    return attribution.param_event_counts(attribution.param_rows(_irregular(spark, sf_dir)))


def q_param_rows(spark, sf_dir):
    return _param_rows(spark, sf_dir)


def q_param_event_counts(spark, sf_dir):
    return attribution.param_event_counts(_param_rows(spark, sf_dir))


def q_param_funnel_flags(spark, sf_dir):
    return funnel.param_funnel_flags(_param_rows(spark, sf_dir))


def q_param_funnel_steps(spark, sf_dir):
    return funnel.param_funnel_steps(funnel.param_funnel_flags(_param_rows(spark, sf_dir)))


def q_param_funnel(spark, sf_dir):
    steps = funnel.param_funnel_steps(funnel.param_funnel_flags(_param_rows(spark, sf_dir)))
    return funnel.param_funnel(steps)


def q_param_funnel_filtered(spark, sf_dir):
    steps = funnel.param_funnel_steps(funnel.param_funnel_flags(_param_rows(spark, sf_dir)))
    return funnel.param_funnel(steps, param=FILTER_PARAM)


def q_param_funnel_published(spark, sf_dir):
    """The printed card's three columns."""
    steps = funnel.param_funnel_steps(funnel.param_funnel_flags(_param_rows(spark, sf_dir)))
    return funnel.param_funnel(steps, published_columns=True)


# --- dashboard filters (Q26) ------------------------------------------------


@_on_scoring(date_range=FILTER_DATE_RANGE, shop_in=FILTER_SHOPS)
def q_dashboard_filters(sc):
    """RFM report with all three dashboard filters: period, shops, segment."""
    return rfm.rfm_report(sc.base, sc.segments, rfm_group=FILTER_GROUP)


@_on_scoring(receipts=True, date_range=FILTER_DATE_RANGE)
def q_ltv_filtered(sc):
    return value.ltv(sc.receipts, sc.segments, rfm_group=FILTER_GROUPS)


@_on_scoring(receipts=True, shop_in=FILTER_SHOPS)
def q_churn_rate_filtered(sc):
    return lifecycle.churn_rate(sc.receipts, sc.segments, as_of=CHURN_AS_OF, rfm_group=FILTER_GROUP)


@_on_scoring(date_range=FILTER_DATE_RANGE)
def q_segment_revenue_share_filtered(sc):
    return value.segment_revenue_share(sc.segments, rfm_group=FILTER_GROUP)


@_on_scoring(receipts=True)
def q_seasonality_index_filtered(sc):
    """Segment filter inside the monthly sums (before both averages)."""
    return value.seasonality_index(sc.receipts, sc.segments, rfm_group=FILTER_GROUP)


@_on_scoring(receipts=True, shop_in=FILTER_SHOPS)
def q_cohort_retention_filtered(sc):
    """Segment filter after the join, published five columns."""
    return lifecycle.cohort_retention(sc.receipts, sc.segments, rfm_group=FILTER_GROUP, published_columns=True)


@_on_scoring(receipts=True)
def q_churn_risk_segment_filtered(sc):
    """Segment filter as an IN list."""
    return lifecycle.churn_risk_segment(sc.receipts, sc.segments, rfm_group=FILTER_GROUPS, today=sc.today)


@_on_scoring(date_range=FILTER_DATE_RANGE)
def q_avg_recency_filtered(sc):
    return averages.avg_recency_by_segment(sc.segments, rfm_group=FILTER_GROUP)


def q_param_event_counts_period(spark, sf_dir):
    """Period filter on the click-stream, applied before the fill."""
    filled = _filled(spark, sf_dir, date_range=FILTER_STAT_PERIOD)
    return attribution.param_event_counts(attribution.param_rows(filled))


@_on_scoring(date_range=FILTER_DATE_RANGE)
def q_avg_spend_filtered(sc):
    return averages.avg_spend_by_segment(sc.segments, rfm_group=FILTER_GROUPS)


@_on_scoring(shop_in=FILTER_SHOPS)
def q_avg_frequency_filtered(sc):
    return averages.avg_frequency_by_segment(sc.segments, rfm_group=FILTER_GROUP)


@_on_scoring(date_range=FILTER_DATE_RANGE, shop_in=FILTER_SHOPS)
def q_kpi_cards_filtered(sc):
    return value.kpi_cards(sc.segments, rfm_group=FILTER_GROUPS)


def q_param_funnel_period(spark, sf_dir):
    """Period filter on the click-stream, applied before the fill."""
    rows = attribution.param_rows(_filled(spark, sf_dir, date_range=FILTER_STAT_PERIOD))
    return funnel.param_funnel(funnel.param_funnel_steps(funnel.param_funnel_flags(rows)))


# --- sources and sinks (§2.4) -----------------------------------------------


def _checked(spark, sf_dir, table: str) -> contracts.Checked:
    return contracts.check(tables.FIXTURE_VIEWS[table](spark, sf_dir), table)


def q_read_bonuscheques(spark, sf_dir):
    return _money(_checked(spark, sf_dir, "bonuscheques").rows, "summ_with_disc")


def q_read_shops(spark, sf_dir):
    return _checked(spark, sf_dir, "shops").rows


def q_read_users(spark, sf_dir):
    return _checked(spark, sf_dir, "users").rows


def q_read_userentry(spark, sf_dir):
    return _checked(spark, sf_dir, "userentry").rows


def q_read_stat(spark, sf_dir):
    return _checked(spark, sf_dir, "stat").rows


def q_rejected_stat(spark, sf_dir):
    """problem, rows — of the irregular click-stream, whose times are partly missing."""
    return contracts.check(tables.stat_irregular(spark, sf_dir), "stat").report()


def q_cheques_of_a_period(spark, sf_dir):
    """Receipt lines kept by month; the period's folders are read again."""
    path = scratch_path(spark, "cheques")
    contracts.write_cheques(tables.bonuscheques(spark, sf_dir), path, grain="month")
    cheques = contracts.read_cheques(spark, path, grain="month", date_range=FILTER_DATE_RANGE).rows
    return _money(rfm.transactions(cheques, tables.shops(spark, sf_dir)), "purchase_amount")


def q_published_rfm_segments(spark, sf_dir):
    """Written twice, a folder per segment, and read back."""
    root, segments = scratch_path(spark, "published"), q_rfm_segments(spark, sf_dir)
    for _ in range(2):
        sinks.publish(segments, root, "rfm_segments", partition_by=("rfm_group",))
    return sinks.published(spark, root, "rfm_segments", segments.schema)


def q_published_registrations(spark, sf_dir):
    """Written as sorted files and read back in order."""
    root, order = scratch_path(spark, "published"), ["date_joined"]
    result = q_registrations_daily(spark, sf_dir)
    sinks.publish(result, root, "registrations_daily", order_by=order, files=4)
    return sinks.published(spark, root, "registrations_daily", result.schema, order)


# --- audiences (narrative N1, N2) -------------------------------------------


@_on_scoring()
def q_campaign_audience(sc):
    return audience.campaign_audience(sc.segments)


@_on_scoring(receipts=True)
def q_repeat_buyers(sc):
    return audience.repeat_buyers(sc.receipts, today=sc.today)


CARDS: dict[str, Card] = {
    "transactions": q_transactions,
    "rfm_base": q_rfm_base,
    "rfm_thresholds": q_rfm_thresholds,
    "rfm_ranks": q_rfm_ranks,
    "rfm_segments": q_rfm_segments,
    "rfm_report": q_rfm_report,
    "rfm_report_by_shop": q_rfm_report_by_shop,
    "ltv": q_ltv,
    "seasonality_index": q_seasonality_index,
    "segment_revenue_share": q_segment_revenue_share,
    "kpi_cards": q_kpi_cards,
    "cohort_retention": q_cohort_retention,
    "churn_rate": q_churn_rate,
    "churn_risk_segment": q_churn_risk_segment,
    "avg_recency_by_segment": q_avg_recency_by_segment,
    "avg_spend_by_segment": q_avg_spend_by_segment,
    "avg_frequency_by_segment": q_avg_frequency_by_segment,
    "registrations_daily": q_registrations_daily,
    "registrations_monthly": q_registrations_monthly,
    "weekly_retention": q_weekly_retention,
    "weekly_retention_cohorts": q_weekly_retention_cohorts,
    "url_params": q_url_params,
    "url_params_exact_key": q_url_params_exact_key,
    "attribution_fill": q_attribution_fill,
    "attribution_carry_forward": q_attribution_carry_forward,
    "attribution_fill_irregular": q_attribution_fill_irregular,
    "attribution_carry_forward_irregular": q_attribution_carry_forward_irregular,
    "param_event_counts_irregular": q_param_event_counts_irregular,
    "param_rows": q_param_rows,
    "param_event_counts": q_param_event_counts,
    "param_funnel_flags": q_param_funnel_flags,
    "param_funnel_steps": q_param_funnel_steps,
    "param_funnel": q_param_funnel,
    "param_funnel_filtered": q_param_funnel_filtered,
    "dashboard_filters": q_dashboard_filters,
    "ltv_filtered": q_ltv_filtered,
    "churn_rate_filtered": q_churn_rate_filtered,
    "segment_revenue_share_filtered": q_segment_revenue_share_filtered,
    "seasonality_index_filtered": q_seasonality_index_filtered,
    "cohort_retention_filtered": q_cohort_retention_filtered,
    "churn_risk_segment_filtered": q_churn_risk_segment_filtered,
    "avg_recency_filtered": q_avg_recency_filtered,
    "param_event_counts_period": q_param_event_counts_period,
    "avg_spend_filtered": q_avg_spend_filtered,
    "avg_frequency_filtered": q_avg_frequency_filtered,
    "kpi_cards_filtered": q_kpi_cards_filtered,
    "param_funnel_period": q_param_funnel_period,
    "param_funnel_published": q_param_funnel_published,
    "weekly_retention_exported": q_weekly_retention_exported,
    "weekly_retention_capped": q_weekly_retention_capped,
    "avg_interval_by_churn_risk": q_avg_interval_by_churn_risk,
    "read_bonuscheques": q_read_bonuscheques,
    "read_shops": q_read_shops,
    "read_users": q_read_users,
    "read_userentry": q_read_userentry,
    "read_stat": q_read_stat,
    "rejected_stat": q_rejected_stat,
    "cheques_of_a_period": q_cheques_of_a_period,
    "published_rfm_segments": q_published_rfm_segments,
    "published_registrations": q_published_registrations,
    "campaign_audience": q_campaign_audience,
    "repeat_buyers": q_repeat_buyers,
}
