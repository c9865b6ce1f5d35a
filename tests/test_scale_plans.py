"""Front half, report join, sorted copies and weekly counts: one exchange of the receipt lines,
caches that are freed, heavy clients over many tasks, output in order."""

from __future__ import annotations

import gc
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frames import CHEQUES, ENTRIES, SHOPS, money, ts
from segmenta.functions import sequence
from segmenta.operators import lifecycle, rfm
from segmenta.plans import cards
from segmenta.sources import tables

SF_DIR = "/root/testdata/sf0.001"


def _cheques(spark, rows):
    return spark.createDataFrame([(c, doc, shop, ts(t), money(a)) for c, doc, shop, t, a in rows], CHEQUES)


def _executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _cached(spark) -> bool:
    return not spark._jsparkSession.sharedState().cacheManager().isEmpty()


@pytest.fixture(scope="module")
def shops(spark):
    return spark.createDataFrame([(s,) for s in "ABC"], SHOPS)


def _random_rows(seed, split):
    """Receipts with several lines; if ``split``, some lie on several days."""
    rnd = random.Random(seed)
    rows = []
    for doc in range(300):
        client, shop, day = f"200{rnd.randint(1, 9)}", rnd.choice("ABC"), rnd.randint(1, 25)
        for _ in range(rnd.randint(1, 4)):
            late = rnd.randint(0, 3) if split and doc % 7 == 0 else 0
            rows.append((client, doc % 250 if split else doc, shop, f"2020-0{rnd.randint(1, 9) if split else 1 + doc % 9}-{day + late:02d} 10:00:00", rnd.choice([None, 1, 2.5])))
    return rows


@pytest.mark.parametrize("split", [False, True])
def test_receipts_and_measures_from_the_totals(spark, shops, split):
    cheques = _cheques(spark, _random_rows(3, split))
    tx = rfm.transactions(cheques, shops)
    tx.createOrReplaceTempView("fh_tx")
    with rfm.score(cheques, shops) as sc:
        assert sc.any_split == split
        wanted = spark.sql(
            """SELECT client_id, shop, doc_id, transaction_date, count(*), sum(purchase_amount)
               FROM fh_tx GROUP BY ALL"""
        )
        names = ("client_id", "shop", "doc_id", "transaction_date", "lines", "purchase_amount")
        assert sorted(sc.receipts.select(*names).collect(), key=str) == sorted(wanted.collect(), key=str)
        wanted = spark.sql(
            """SELECT client_id, shop, datediff((SELECT max(transaction_date) FROM fh_tx), max(transaction_date)),
                      count(DISTINCT doc_id), sum(purchase_amount) FROM fh_tx GROUP BY client_id, shop"""
        )
        found = sc.base.select("client_id", "shop", "recency", "frequency", "monetary")
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)


def test_receipts_without_dates_or_ids(spark, shops):
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in CHEQUES])
    rows = [("2001", 1, "A", None, money(1)), ("2001", 1, "A", ts("2020-01-01 10:00:00"), money(2)),
            ("2001", None, "A", ts("2020-01-02 10:00:00"), money(4)), ("2002", 2, "B", None, money(8))]
    with rfm.score(spark.createDataFrame(rows, schema), shops) as sc:
        got = {(r.doc_id, str(r.transaction_date)): r.purchase_amount for r in sc.receipts.collect()}
        assert got == {(1, "None"): 1, (1, "2020-01-01"): 2, (None, "2020-01-02"): 4, (2, "None"): 8}
        base = {r.client_id: (r.recency, r.frequency) for r in sc.base.collect()}
        assert base == {"2001": (0, 1), "2002": (None, 1)}


def test_one_exchange_of_the_receipt_lines(spark, shops):
    cheques = _cheques(spark, _random_rows(5, False))
    with rfm.score(cheques, shops, persist=False) as sc:
        sc.grouped.collect()
        plan = _executed(sc.grouped)
        exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
        named = [re.sub(r"#\d+L?", "", e) for e in exchanges]
        # Lines to receipts; receipts, combined per task, to (client, shop); that to client.
        assert [e for e in named if "doc_id" in e] == ["client_id, shop, doc_id, 8"]
        assert len(named) == 3 and not re.search(r"Exchange .*transaction_date", plan)


@pytest.mark.parametrize("card", ["rfm_report", "ltv", "rfm_thresholds", "churn_risk_segment"])
def test_cards_free_their_caches(spark, card):
    spark.catalog.clearCache()
    result = cards.CARDS[card](spark, SF_DIR)
    assert _cached(spark)
    rows = result.count()
    derived = result.where(F.lit(True))
    del result
    gc.collect()
    for _ in range(100):  # freed by a thread of its own
        if not _cached(spark):
            break
        time.sleep(0.1)
    assert not _cached(spark)
    assert derived.count() == rows


def test_only_cards_that_read_receipts_again_cache_them(spark, shops):
    cheques = _cheques(spark, _random_rows(7, False))
    with rfm.score(cheques, shops, keep_receipts=False) as sc:
        assert not sc.totals.is_cached and sc.grouped.is_cached
    with rfm.score(cheques, shops) as sc:
        assert sc.totals.is_cached
    assert not sc.totals.is_cached and not sc.grouped.is_cached


def _segments(spark, shops_of):
    """A scored (client, shop) table: so many shops per client."""
    rows = [(c, f"s{i:04d}", i, i + 1, money(i), f"g{i % 3}", f"00{i % 3}") for c, n in shops_of.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "client_id string, shop string, recency long, frequency long, monetary decimal(18,4), rfm_group string, rfm_code string")
    return frame.repartition("client_id")


@pytest.mark.parametrize("block", [1, 7, 64])
@pytest.mark.parametrize("group", [None, "g1"])
def test_report_of_heavy_clients(spark, block, group):
    seg = _segments(spark, {"a": 1, "b": 6, "c": 7, "d": 8, "e": 130})
    base = seg.select("client_id", "shop", "recency", "frequency", "monetary")
    found = rfm.rfm_report(base, seg, rfm_group=group, block=block)
    seg.createOrReplaceTempView("hv_seg")
    wanted = spark.sql(
        f"""SELECT s.rfm_group, s.shop, CAST(m.monetary AS DOUBLE), m.recency, m.frequency, s.client_id, s.rfm_code
            FROM hv_seg s JOIN hv_seg m ON m.client_id = s.client_id WHERE {f"s.rfm_group = '{group}'" if group else 'true'}"""
    )
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_a_client_in_2000_shops_is_spread_over_tasks(spark):
    seg = _segments(spark, {"hot": 2_000, **{f"c{i}": 2 for i in range(50)}})
    found = rfm.rfm_report(seg, seg, join_on=("client_id",))
    tasks = found.where(F.col("client_id") == "hot").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 4_000_000
    assert len(tasks) == 8 and max(r["count"] for r in tasks) < 1_200_000


def test_report_by_shop_has_no_join(spark):
    seg = _segments(spark, {"a": 3, "b": 1})
    plan = rfm.rfm_report(seg, seg, join_on=("client_id", "shop"))
    assert "Join" not in _executed(plan) and plan.count() == 4


def test_copies_are_emitted_in_order(spark):
    rnd = random.Random(9)
    rows = [(f"c{i}", None if i % 17 == 0 else rnd.randint(0, 12), rnd.choice([0, 1, 3, 700])) for i in range(300)]
    rows.append(("hot", 5, 200_000))
    frame = spark.createDataFrame(rows, "client_id string, age int, n long").repartition(5)
    out = sequence.replicate_in_order(frame, "n", "age", then=("client_id",), block=64)
    assert out.columns == ["client_id", "age"]
    got = out.collect()
    wanted = [(c, a) for c, a, n in rows for _ in range(n)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))
    ages = [float("inf") if r.age is None else r.age for r in got]
    assert ages == sorted(ages, reverse=True)
    # The copies are shared out evenly, though one row has nearly all of them.
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.3 * len(wanted) / 8
    # Only the counted blocks move.
    plan = _executed(out)
    assert plan.index("Generate") < plan.index("Exchange")


def test_copies_of_nothing(spark):
    frame = spark.createDataFrame([("a", 1, 0)], "client_id string, age int, n long")
    assert sequence.replicate_in_order(frame, "n", "age").collect() == []
    assert sequence.replicate_in_order(frame.limit(0), "n", "age").collect() == []


def test_weekly_counts_exchange_users_once(spark):
    rows = [(u, ts(f"2024-01-{d:02d} 10:00:00")) for u in range(20) for d in range(1 + u % 3, 28, 1 + u % 5)]
    out = lifecycle.weekly_retention(spark.createDataFrame(rows, ENTRIES))
    assert out.count() > 0
    out.collect()
    keys = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", _executed(out))]
    assert sum("user_id" in k for k in keys) <= 4 and not any("user_id" in k and "weeks" in k for k in keys)


def test_receipt_lines_are_joined_in_tasks_of_bounded_rows(spark, tmp_path):
    """The number of tasks follows the number of lines, and the rows stay the same."""
    n = 4_000
    spark.range(n).selectExpr(
        "id % 1000 as l_orderkey", "cast(id % 90 + 0.25 as double) as l_extendedprice", "cast(id % 3 / 10 as double) as l_discount"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1_000).selectExpr(
        "if(id = 7, null, id) as o_orderkey", "id % 50 as o_custkey", "concat('shop', id % 5) as o_orderpriority",
        "timestamp_ntz'2000-01-01 00:00:00' + make_dt_interval(id % 300) as o_orderdate",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(40).selectExpr("id as c_custkey", "if(id % 4 = 0, 'MACHINERY', 'BUILDING') as c_mktsegment").write.parquet(
        f"{tmp_path}/customer.parquet"
    )
    small = tables.bonuscheques(spark, str(tmp_path))
    dealt = tables.bonuscheques(spark, str(tmp_path), join_rows=200)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, small.collect())) and small.count() == 3_196
    per_task = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 15 and max(r["count"] for r in per_task) < 600
