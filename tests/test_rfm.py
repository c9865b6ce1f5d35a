"""RFM scoring micro cases and properties (transactions -> report)."""

from __future__ import annotations

from pyspark.sql import functions as F

from frames import CHEQUES, SHOPS, d, money, ts
from segmenta.operators import rfm


def _cheques(spark, rows):
    return spark.createDataFrame(
        [(c, doc, shop, ts(t), money(a)) for c, doc, shop, t, a in rows], CHEQUES
    )


def _shops(spark, names=("A", "B")):
    return spark.createDataFrame([(n,) for n in names], SHOPS)


ROWS = [
    # card, doc, shop, datetime, amount
    ("2001", 1, "A", "2020-01-01 10:00:00", 10),
    ("2001", 1, "A", "2020-01-01 10:00:00", 5),  # second line, same receipt
    ("2001", 2, "B", "2020-03-01 09:00:00", 100),
    ("2002", 3, "A", "2020-02-01 12:00:00", None),  # NULL amount
    ("2003", 4, "A", "2020-03-10 08:00:00", 40),
    ("2003", 5, "A", "2020-03-11 08:00:00", 60),
    ("1004", 6, "A", "2020-03-20 08:00:00", 999),  # rejected card prefix
    ("2005", 7, "Z", "2020-03-25 08:00:00", 999),  # unknown shop
]


def test_segment_table_is_a_function_over_all_64_codes():
    mapping = rfm.segment_of_code()
    codes = {f"{r}{f}{m}" for r in range(4) for f in range(4) for m in range(4)}
    assert set(mapping) == codes
    assert len(set(mapping.values())) == 12


def test_transactions_filters_prefix_and_shop_and_current_dt(spark):
    tx = rfm.transactions(_cheques(spark, ROWS), _shops(spark), with_current_dt=True)
    got = tx.collect()
    assert {r.client_id for r in got} == {"2001", "2002", "2003"}
    assert {r.current_dt for r in got} == {d("2020-03-11")}
    # a date filter moves "today"
    tx2 = rfm.transactions(
        _cheques(spark, ROWS), _shops(spark), date_range=("2020-01-01", "2020-02-15"), with_current_dt=True
    )
    assert {r.current_dt for r in tx2.collect()} == {d("2020-02-01")}
    # a shop filter applies to both sides
    tx3 = rfm.transactions(_cheques(spark, ROWS), _shops(spark), shop_in=["B"])
    assert {r.client_id for r in tx3.collect()} == {"2001"}


def test_base_measures(spark):
    tx = rfm.transactions(_cheques(spark, ROWS), _shops(spark))
    base = {(r.client_id, r.shop): r for r in rfm.rfm_base(rfm.receipts(tx)).collect()}
    a = base[("2001", "A")]
    assert (a.recency, a.frequency, a.monetary) == (70, 1, money(15))
    assert base[("2001", "B")].recency == 10
    assert base[("2002", "A")].monetary is None  # all amounts NULL -> NULL
    c = base[("2003", "A")]
    assert (c.recency, c.frequency, c.monetary) == (0, 2, money(100))
    # raw lines and pre-aggregated receipts give the same base
    raw = {(r.client_id, r.shop): tuple(r) for r in rfm.rfm_base(tx).collect()}
    assert raw == {k: tuple(v) for k, v in base.items()}


def test_null_monetary_ranks_best_and_ties_collapse(spark):
    tx = rfm.transactions(_cheques(spark, ROWS), _shops(spark))
    base = rfm.rfm_base(rfm.receipts(tx))
    th = rfm.rfm_thresholds(base).collect()[0]
    # frequency is 1,1,1,2: quartiles 1, 1, 1.25
    assert (th.f25, th.frequency_median, th.f75) == (1.0, 1.0, 1.25)
    ranks = {(r.client_id, r.shop): r for r in rfm.rfm_ranks(base, rfm.rfm_thresholds(base)).collect()}
    assert ranks[("2002", "A")].m_rank == 0  # NULL falls through to ELSE = best
    assert ranks[("2003", "A")].f_rank == 0  # frequency 2 > f75
    assert {r.f_rank for k, r in ranks.items() if k[0] != "2003"} == {3}
    assert all(0 <= r[x] <= 3 for r in ranks.values() for x in ("r_rank", "f_rank", "m_rank"))


def test_report_client_only_join_multiplies_rows(spark):
    sc = rfm.score(_cheques(spark, ROWS), _shops(spark))
    report = rfm.rfm_report(sc.base, sc.segments)
    rows = [r for r in report.collect() if r.client_id == "2001"]
    assert len(rows) == 4  # 2 shops x 2 shops
    assert {(r.shop, r.monetary) for r in rows} == {("A", 15.0), ("A", 100.0), ("B", 15.0), ("B", 100.0)}
    clean = rfm.rfm_report(sc.base, sc.segments, join_on=("client_id", "shop"))
    assert clean.where(F.col("client_id") == "2001").count() == 2
    sc.unpersist()


def test_segment_filter_does_not_move_thresholds(spark):
    sc = rfm.score(_cheques(spark, ROWS), _shops(spark))
    full = {tuple(r) for r in rfm.rfm_report(sc.base, sc.segments).collect()}
    group = next(iter(full))[0]
    filtered = {tuple(r) for r in rfm.rfm_report(sc.base, sc.segments, rfm_group=group).collect()}
    assert filtered == {r for r in full if r[0] == group}
    sc.unpersist()


def test_empty_input(spark):
    sc = rfm.score(spark.createDataFrame([], CHEQUES), _shops(spark))
    assert sc.segments.count() == 0
    th = sc.thresholds.collect()
    assert len(th) == 1 and all(v is None for v in th[0])
    sc.unpersist()


def test_duplicate_shop_names_duplicate_receipts(spark):
    tx = rfm.transactions(_cheques(spark, ROWS[:1]), _shops(spark, ("A", "A", "B")))
    assert tx.count() == 2  # inner join, as in the reference


def test_hot_client_with_a_third_of_all_receipts(spark):
    # one client holds a third of the receipt lines, spread over many days
    rows = []
    for i in range(300):
        rows.append(("2009999", 10_000 + i, "A" if i % 3 else "B", f"2020-{1 + i % 12:02d}-{1 + i % 28:02d} 10:00:00", i % 7 + 1))
    for i in range(600):
        rows.append((f"200{i % 50:03d}", i, "A", f"2020-{1 + i % 12:02d}-{1 + i % 28:02d} 09:00:00", i % 5 + 1))
    sc = rfm.score(_cheques(spark, rows), _shops(spark))
    base = {(r.client_id, r.shop): r for r in sc.base.collect()}
    hot_a, hot_b = base[("2009999", "A")], base[("2009999", "B")]
    assert hot_a.frequency == 200 and hot_b.frequency == 100
    assert hot_a.monetary + hot_b.monetary == money(sum(i % 7 + 1 for i in range(300)))
    from segmenta.operators import value

    # one row per segment the client is in; revenues sum to (shop rows) x total
    ltv_rows = value.ltv(sc.receipts, sc.segments).where(F.col("client_id") == "2009999").collect()
    assert ltv_rows and all(r.active_month == 12 for r in ltv_rows)
    assert sum(r.revenue for r in ltv_rows) == 2 * float(hot_a.monetary + hot_b.monetary)
    sc.unpersist()


def test_approx_thresholds_stay_within_a_rank_band(spark):
    import random

    rnd = random.Random(5)
    rows = [(f"200{i:04d}", i, "A", f"2020-{1 + i % 12:02d}-{1 + i % 28:02d} 10:00:00", round(rnd.uniform(1, 900), 2)) for i in range(2000)]
    sc = rfm.score(_cheques(spark, rows), _shops(spark))
    approx = rfm.rfm_thresholds(sc.base, method="approx").collect()[0]
    values = sorted(float(r.monetary) for r in sc.base.select("monetary").collect())
    n = len(values)
    for name, p in (("m25", 0.25), ("monetary_median", 0.5), ("m75", 0.75)):
        lo, hi = values[int((p - 0.02) * (n - 1))], values[int((p + 0.02) * (n - 1))]
        assert lo <= approx[name] <= hi, (name, approx[name], lo, hi)
    sc.unpersist()
