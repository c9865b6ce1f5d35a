"""Optional reference column titles for card outputs.

The operators return English snake_case columns; dashboards built on the
reference show the titles below.  ``with_reference_titles(df, card)`` renames
the columns of a card's result (columns without a title keep their name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's): output titles per card.
# ---------------------------------------------------------------------------
REFERENCE_TITLES: dict[str, dict[str, str]] = {
    "ltv": {
        "revenue": "выручка",
        "active_month": "месяц",
        "revenue_per_active_month": "среднегодовая выручка",
    },
    "seasonality_index": {
        "month": "месяц",
        "seasonality_index": "индекс сезонности",
    },
    "cohort_retention": {
        "cohort_month": "месяц",
        "rfm_group": "группы",
        "retained_users": "вернулось",
        "cohort_users": "всего покупателей",
        "retention_rate": "коэффициент удержания",
    },
    "churn_risk_segment": {
        "transaction_date": "дата",
        "recency_days": "давность",
    },
    "avg_recency_by_segment": {
        "rfm_group": "группа",
        "avg_interval_days": "средний интервал (дней)",
    },
    "avg_spend_by_segment": {
        "rfm_group": "группа",
        "avg_spend": "средняя сумма затрат",
    },
    "avg_frequency_by_segment": {
        "rfm_group": "группа",
        "avg_frequency": "средняя частота покупок",
    },
    "weekly_retention": {
        "cohort_month": "Дата",
        "weeks_since_first": "Прошло нед. после первого захода",
        "retention_percent": "Retention в процентах",
    },
}
REFERENCE_TITLES["ltv_filtered"] = REFERENCE_TITLES["ltv"]
REFERENCE_TITLES["weekly_retention_cohorts"] = REFERENCE_TITLES["weekly_retention"]


def with_reference_titles(df: DataFrame, card: str) -> DataFrame:
    """Rename a card's output columns to the reference's titles."""
    titles = REFERENCE_TITLES.get(card, {})
    return df.withColumnsRenamed({c: titles[c] for c in df.columns if c in titles}) if titles else df
