"""Churn, churn risk, cohort and weekly retention, registrations: micro cases."""

from __future__ import annotations

from frames import ENTRIES, SEGMENTS, TX, USERS, d, money, ts
from segmenta.operators import lifecycle, registrations, value


def _tx(spark, rows):
    return spark.createDataFrame([(c, doc, s, d(t), money(a)) for c, doc, s, t, a in rows], TX)


def _seg(spark, rows, today="2001-07-31"):
    return spark.createDataFrame([(c, s, g, d(today)) for c, s, g in rows], SEGMENTS)


CHURN_TX = [
    ("c1", 1, "A", "2001-01-01", 1),
    ("c1", 2, "A", "2001-01-01", 1),  # same day: successor is the same day
    ("c1", 3, "A", "2001-04-01", 1),  # exactly 90 days later: not churn
    ("c1", 4, "A", "2001-07-01", 1),  # 91 days later: churn; last row: churn
]


def test_churn_rate_gap_and_buckets(spark):
    tx = _tx(spark, CHURN_TX)
    seg = _seg(spark, [("c1", "A", "G")])
    got = {(r.recency_group, r.rfm_group): r for r in lifecycle.churn_rate(tx, seg, as_of="2001-07-31").collect()}
    recent = got[(lifecycle.RECENCY_UP_TO_30, "G")]
    old = got[(lifecycle.RECENCY_OVER_90, "G")]
    assert (recent.total_clients, recent.churn_clients, recent.churn_percent) == (1, 1, 100.0)
    assert (old.total_clients, old.churn_clients, old.churn_percent) == (3, 1, 33.33)
    assert len(got) == 2  # middle bucket dropped


def test_churn_rate_weights_by_shop_rows(spark):
    tx = _tx(spark, CHURN_TX)
    seg = _seg(spark, [("c1", "A", "G"), ("c1", "B", "G"), ("c1", "C", "H")])
    got = {(r.recency_group, r.rfm_group): r for r in lifecycle.churn_rate(tx, seg, as_of="2001-07-31").collect()}
    assert got[(lifecycle.RECENCY_OVER_90, "G")].total_clients == 6
    assert got[(lifecycle.RECENCY_OVER_90, "H")].total_clients == 3


def test_churn_risk_labels_at_30_31_90_91(spark):
    rows = [
        ("c1", 1, "A", "2001-07-01", 1),  # 30 days
        ("c1", 2, "A", "2001-06-30", 1),  # 31
        ("c1", 3, "A", "2001-05-02", 1),  # 90
        ("c1", 4, "A", "2001-05-01", 1),  # 91
    ]
    seg = _seg(spark, [("c1", "A", "G"), ("c1", "B", "G")])
    got = lifecycle.churn_risk_segment(_tx(spark, rows), seg).collect()
    assert len(got) == 8  # every receipt row once per shop row
    labels = {r.recency_days: r.churn_risk_segment for r in got}
    assert labels == {
        30: lifecycle.RISK_LOW,
        31: lifecycle.RISK_MEDIUM,
        90: lifecycle.RISK_MEDIUM,
        91: lifecycle.RISK_HIGH,
    }
    assert [r.recency_days for r in got] == sorted((r.recency_days for r in got), reverse=True)


def test_cohort_retention(spark):
    rows = [
        ("c1", 1, "A", "2001-01-05", 1),
        ("c1", 2, "A", "2001-02-05", 1),
        ("c1", 3, "A", "2001-02-06", 1),
        ("c2", 4, "A", "2001-01-20", 1),
        ("c3", 5, "A", "2001-02-01", 1),
    ]
    seg = _seg(spark, [("c1", "A", "G"), ("c1", "B", "G"), ("c2", "A", "G"), ("c3", "A", "G")])
    got = {(str(r.cohort_month), r.months_after_first): r for r in lifecycle.cohort_retention(_tx(spark, rows), seg).collect()}
    assert (got[("2001-01-01", 0)].retained_users, got[("2001-01-01", 0)].cohort_users) == (2, 2)
    assert got[("2001-01-01", 0)].retention_rate == 1.0
    assert (got[("2001-01-01", 1)].retained_users, got[("2001-01-01", 1)].retention_rate) == (1, 0.5)
    assert got[("2001-02-01", 0)].cohort_users == 1


def test_ltv_weights_and_months(spark):
    rows = [
        ("c1", 1, "A", "2001-01-05", 10),
        ("c1", 2, "B", "2002-01-07", 20),  # same month number, another year
        ("c1", 3, "A", "2001-03-05", None),
    ]
    seg = _seg(spark, [("c1", "A", "G"), ("c1", "B", "G")])
    (r,) = value.ltv(_tx(spark, rows), seg).collect()
    assert (r.revenue, r.active_month, r.revenue_per_active_month) == (60.0, 2, 30.0)


def test_weekly_retention_week_boundary(spark):
    rows = [
        (1, "2024-01-01 00:00:00"),
        (1, "2024-01-07 23:59:59.200"),  # 6 d 23:59:59.2 -> week 0
        (1, "2024-01-08 00:00:00"),  # exactly 7 days -> week 1
        (1, "2024-01-15 00:00:00.500"),  # week 2
        (2, "2024-01-10 12:00:00"),
        (2, "2024-01-17 12:00:00"),  # week 1
    ]
    entries = spark.createDataFrame([(u, ts(t)) for u, t in rows], ENTRIES)
    got = [(str(r.cohort_month), r.weeks_since_first, r.retention_percent) for r in lifecycle.weekly_retention(entries).collect()]
    assert got == [("2024-01-01", 1, 100.0), ("2024-01-01", 2, 50.0)]


def test_registrations_bounds(spark):
    rows = [
        (1, "1970-12-31 23:59:59"),  # before the lower bound
        (2, "1971-01-01 00:00:00"),  # first day in range
        (None, "1980-05-05 00:00:00"),  # NULL id dropped
        (3, "2000-12-31 23:00:00"),  # last day in range
        (4, "2001-01-01 00:00:00"),  # current year excluded
    ]
    users = spark.createDataFrame([(i, ts(t)) for i, t in rows], USERS)
    daily = [(str(r.date_joined), r["count"]) for r in registrations.registrations_daily(users, as_of="2001-06-15").collect()]
    assert daily == [("1971-01-01", 1), ("2000-12-31", 1)]
    monthly = [(str(r.date_joined), r["count"]) for r in registrations.registrations_monthly(users).collect()]
    assert monthly == [("1970-12-01", 1), ("1971-01-01", 1), ("2000-12-01", 1), ("2001-01-01", 1)]


def test_reference_titles(spark):
    from segmenta.plans.titles import with_reference_titles

    rows = [("c1", 1, "A", "2001-01-05", 10)]
    seg = _seg(spark, [("c1", "A", "G")])
    df = with_reference_titles(value.ltv(_tx(spark, rows), seg), "ltv")
    assert df.columns == ["client_id", "выручка", "месяц", "среднегодовая выручка"]


def test_week_index_ignores_daylight_saving(spark):
    # 7 days across the US spring-forward switch: week 1 in any session zone
    from segmenta.functions.columns import whole_weeks_between

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(ts("2024-03-03 12:00:00"), ts("2024-03-10 12:00:00"))], "a timestamp_ntz, b timestamp_ntz")
        assert df.select(whole_weeks_between("b", "a").alias("w")).first().w == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_weekly_retention_ignores_entries_without_user(spark):
    from segmenta.operators.lifecycle import weekly_retention

    rows = [(1, "2024-01-01 10:00:00"), (1, "2024-01-08 11:00:00"), (2, "2024-01-02 10:00:00")]
    rows += [(None, "2024-01-01 00:00:00"), (None, "2024-01-22 10:00:00"), (1, None)]
    entries = spark.createDataFrame(rows, "user_id int, entry_at string").selectExpr("user_id", "cast(entry_at AS timestamp_ntz) entry_at")
    out = weekly_retention(entries).collect()
    assert [(r.weeks_since_first, float(r.retention_percent)) for r in out] == [(1, 50.0)]
