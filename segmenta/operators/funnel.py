"""Six-step funnel per URL parameter: per-user step flags (Q23), users per step
(Q24) and conversion against the previous present step (Q25).

Steps are independent flags (no order is required between them), so
conversion can exceed 100%.  The flags are a boolean pivot — one hash aggregate
keyed by (uid, param), partial-aggregated so a hot uid is combined map-side —
and the step counts are one more aggregate per param followed by a one-pass
unpivot; only the tiny per-param table meets the LAG window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmenta.functions.columns import percent
from segmenta.operators.filters import apply_filters, ilike_predicate

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's): funnel steps in order —
# (flag column, event name, step title).
# ---------------------------------------------------------------------------
FUNNEL_STEPS: tuple[tuple[str, str, str], ...] = (
    ("step1_visit", "enter_site", "1. Зашел на сайт"),
    ("step2_page", "open_page", "2. Открыл страницу"),
    ("step3_consult", "request_consultation", "3. Оставил заявку на консультацию"),
    ("step4_demo", "request_demo", "4. Запросил демо"),
    ("step5_payment", "go_to__payment", "5. Перешел к оплате"),
    ("step6_results", "get_test_results", "6. Запросил результаты теста"),
)


def param_funnel_flags(rows: DataFrame, steps=FUNNEL_STEPS) -> DataFrame:
    """uid, param, one 0/1 column per step (did the user fire that event under the param).
    NULL uid is one group, as in SQL GROUP BY."""
    return rows.groupBy("uid", "param").agg(
        *[F.max(F.when(F.col("event") == event, 1).otherwise(0)).alias(flag) for flag, event, _ in steps]
    )


def param_funnel_steps(flags: DataFrame, steps=FUNNEL_STEPS) -> DataFrame:
    """param, step, users_count — users with the flag set; a step nobody reached has no row."""
    sums = flags.groupBy("param").agg(*[F.sum(flag).alias(flag) for flag, _, _ in steps])
    long = sums.select(
        "param",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(title).alias("step"), F.col(flag).cast("bigint").alias("users_count"))
                    for flag, _, title in steps
                ]
            )
        ).alias("s"),
    ).select("param", "s.step", "s.users_count")
    return long.where(F.col("users_count") > 0)


def param_funnel(counts: DataFrame, *, param: str | None = None, published_columns: bool = False) -> DataFrame:
    """step, users_count, conversion_percent, param — sorted by step.
    ``published_columns=True`` drops the param (the printed card's three columns).

    Conversion is against the previous *present* step of the same param (the
    first present step is 100.0).  The optional case-insensitive ``param``
    pattern is applied after the conversion, so it only selects rows.
    """
    w = Window.partitionBy("param").orderBy(F.col("step").asc_nulls_last())
    prev = F.lag("users_count").over(w)
    conv = F.when(prev.isNull(), F.lit(100.0)).otherwise(percent("users_count", prev, 2))
    out = counts.select("param", "step", "users_count", conv.alias("conversion_percent"))
    out = apply_filters(out, ilike_predicate("param", param))
    columns = ["step", "users_count", "conversion_percent"] + ([] if published_columns else ["param"])
    return out.select(*columns).orderBy(F.col("step").asc_nulls_last())
