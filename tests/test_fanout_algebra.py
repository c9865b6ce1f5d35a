"""Closed forms (client aggregates x segment weights) against the literal
client-only joins, written in Spark SQL, on seeded random receipts with NULL
amounts and clients in several shops."""

from __future__ import annotations

import random

import pytest

from frames import CHEQUES, SHOPS, money, ts
from segmenta.operators import averages, lifecycle, rfm, value


@pytest.fixture(scope="module", params=[11, 23])
def scored(spark, request):
    rnd = random.Random(request.param)
    rows = []
    for doc in range(400):
        client = f"200{rnd.randint(1, 25):03d}"
        shop = rnd.choice("ABCD")
        day = f"20{rnd.randint(19, 20)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d} 10:00:00"
        for _ in range(rnd.randint(1, 3)):
            amount = None if rnd.random() < 0.05 else round(rnd.uniform(1, 500), 2)
            rows.append((client, doc, shop, day, amount))
    cheques = spark.createDataFrame([(c, d, s, ts(t), money(a)) for c, d, s, t, a in rows], CHEQUES)
    shops = spark.createDataFrame([(s,) for s in "ABCD"], SHOPS)
    sc = rfm.score(cheques, shops)
    rfm.transactions(cheques, shops).createOrReplaceTempView("fx_tx")
    sc.segments.createOrReplaceTempView("fx_sg")
    sc.base.createOrReplaceTempView("fx_rb")
    yield sc
    sc.unpersist()


def _rows(df, digits=6):
    return sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_ltv_equals_literal_join(spark, scored):
    literal = spark.sql(
        """SELECT client_id, CAST(revenue AS DOUBLE) AS revenue, active_month,
                  CAST(revenue AS DOUBLE) / NULLIF(active_month, 0) AS revenue_per_active_month
           FROM (SELECT t.client_id, r.rfm_group, SUM(t.purchase_amount) AS revenue,
                        COUNT(DISTINCT month(t.transaction_date)) AS active_month
                 FROM fx_tx t JOIN fx_sg r ON r.client_id = t.client_id
                 GROUP BY t.client_id, r.rfm_group)"""
    )
    assert _rows(value.ltv(scored.receipts, scored.segments)) == _rows(literal)


@pytest.mark.parametrize("measure,out", [("recency", "avg_interval_days"), ("monetary", "avg_spend"), ("frequency", "avg_frequency")])
def test_segment_average_equals_double_join(spark, scored, measure, out):
    literal = spark.sql(
        f"""SELECT s2.rfm_group, CAST(ROUND(AVG(CAST(b.{measure} AS DECIMAL(28,4))), 1) AS DOUBLE) AS {out}
            FROM fx_sg s JOIN fx_rb b ON b.client_id = s.client_id
                         JOIN fx_sg s2 ON s2.client_id = s.client_id
            WHERE b.{measure} IS NOT NULL
            GROUP BY s2.rfm_group"""
    )
    assert _rows(averages.segment_average(scored.segments, measure)) == _rows(literal)


def test_churn_rate_equals_literal_lead(spark, scored):
    literal = spark.sql(
        """WITH nxt AS (
             SELECT client_id, transaction_date,
                    LEAD(transaction_date) OVER (PARTITION BY client_id ORDER BY transaction_date) AS next_date
             FROM fx_tx),
           flags AS (
             SELECT client_id,
                    CASE WHEN datediff(DATE'2021-03-01', transaction_date) <= 30 THEN 'До 30 дней'
                         WHEN datediff(DATE'2021-03-01', transaction_date) > 90 THEN 'Более 90 дней'
                         ELSE '31-90 дней' END AS recency_group,
                    CASE WHEN next_date IS NULL OR next_date > date_add(transaction_date, 90) THEN 1 ELSE 0 END AS churn
             FROM nxt)
           SELECT f.recency_group, r.rfm_group, COUNT(*) AS total_clients, SUM(f.churn) AS churn_clients
           FROM flags f JOIN fx_sg r ON r.client_id = f.client_id
           WHERE f.recency_group IN ('До 30 дней', 'Более 90 дней')
           GROUP BY f.recency_group, r.rfm_group"""
    )
    got = lifecycle.churn_rate(scored.receipts, scored.segments, as_of="2021-03-01").select(
        "recency_group", "rfm_group", "total_clients", "churn_clients"
    )
    assert _rows(got) == _rows(literal)
