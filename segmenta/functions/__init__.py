"""Column expressions and DataFrame building blocks used by the operators."""

from segmenta.functions.columns import (
    as_list,
    days_between,
    mean,
    month_start,
    months_between_starts,
    percent,
    ratio,
    url_values,
    whole_weeks_between,
)
from segmenta.functions.joins import broadcast_if_small, literal, one_row
from segmenta.functions.quantiles import exact_percentiles
from segmenta.functions.sequence import lag_by_key, replicate

__all__ = [
    "as_list",
    "broadcast_if_small",
    "days_between",
    "exact_percentiles",
    "lag_by_key",
    "mean",
    "month_start",
    "months_between_starts",
    "percent",
    "ratio",
    "replicate",
    "url_values",
    "whole_weeks_between",
    "literal",
    "one_row",
]
