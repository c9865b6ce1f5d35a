"""Contracts with bad files, receipts by period, published results, ordered limits."""

from __future__ import annotations

import datetime as dt
import os
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from frames import CHEQUES, money, ts
from segmenta import sinks
from segmenta.functions.limits import ordered_limit
from segmenta.operators import lifecycle
from segmenta.sources import contracts


def _problems(checked):
    return {r.problem: r.rows for r in checked.report().collect()}


def _write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


GOOD = {
    "bonuscheques": ("card,doc_id,shop,datetime,summ_with_disc", "2001,7,A,2020-01-02 10:00:00.5,12.3400"),
    "shops": ("name", "A"),
    "users": ("id,date_joined", "5,2020-01-02 00:00:00"),
    "userentry": ("user_id,entry_at", "5,2020-01-02 00:00:00"),
    "stat": ("uid,event,created_at,url_params", "5,enter_site,2020-01-02 00:00:00,?a=1"),
}
BAD = {
    "bonuscheques": (",7,A,2020-01-02,1\n2001,x,A,2020-01-02,1\n2001,7,A,yesterday,1\n2001,7,A,2020-01-02,1O\n2001,,,2020-01-02,",
                     {"card: missing": 1, "doc_id: not a bigint": 1, "datetime: not a timestamp_ntz": 1,
                      "summ_with_disc: not a decimal(18,4)": 1, "doc_id: missing": 1, "shop: missing": 1}),
    "shops": ('""\n', {"name: missing": 1}),
    "users": ("x,2020-01-02\n,2020-99-02", {"id: not a bigint": 1, "date_joined: not a timestamp_ntz": 1}),
    "userentry": (",2020-01-02\n5,\n5,noon", {"user_id: missing": 1, "entry_at: missing": 1, "entry_at: not a timestamp_ntz": 1}),
    "stat": ("5,,2020-01-02,?a\nu5,enter_site,,", {"event: missing": 1, "uid: not a bigint": 1, "created_at: missing": 1}),
}


@pytest.mark.parametrize("table", list(contracts.CONTRACTS))
def test_bad_text_files(spark, tmp_path, table):
    header, good = GOOD[table]
    bad, problems = BAD[table]
    path = _write(tmp_path / "in.csv", f"{header}\n{good}\n{bad}\n")
    checked = contracts.read(spark, table, path, format="csv", ignoreLeadingWhiteSpace=False)
    assert [(f.name, f.dataType) for f in checked.rows.schema] == [(f.name, f.dataType) for f in contracts.CONTRACTS[table]]
    assert checked.rows.count() == 1 and _problems(checked) == problems
    rejected = checked.rejected.collect()
    assert len(rejected) + 1 == sum(1 for line in f"{good}\n{bad}".splitlines() if line)
    assert checked.rejected.columns == [*contracts.CONTRACTS[table].names, "problems"]


def test_values_of_good_rows(spark, tmp_path):
    header, good = GOOD["bonuscheques"]
    row = contracts.read(spark, "bonuscheques", _write(tmp_path / "in.csv", f"{header}\n{good}\n"), format="csv").rows.first()
    assert tuple(row) == ("2001", 7, "A", dt.datetime(2020, 1, 2, 10, 0, 0, 500_000), Decimal("12.3400"))


@pytest.mark.parametrize("table", list(contracts.CONTRACTS))
def test_missing_columns_are_named(spark, tmp_path, table):
    path = _write(tmp_path / "in.csv", "other\n1\n")
    with pytest.raises(ValueError, match=contracts.CONTRACTS[table].names[0]):
        contracts.read(spark, table, path, format="csv")


def test_typed_files_must_keep_their_values(spark, tmp_path):
    frame = spark.createDataFrame(
        [("2001", 7.0, "A", "2020-01-02", Decimal("1.23456"), 1), ("2001", 7.5, "A", "2020-01-02", Decimal("1.5"), 2),
         ("2001", 8.0, "A", "2020-01-03", Decimal("2.5"), 3)],
        "card string, doc_id double, shop string, datetime string, summ_with_disc decimal(20,5), extra int",
    )
    frame.write.parquet(f"{tmp_path}/in")
    checked = contracts.read(spark, "bonuscheques", f"{tmp_path}/in")
    assert _problems(checked) == {"doc_id: not a bigint": 1, "summ_with_disc: not a decimal(18,4)": 1}
    assert [r.doc_id for r in checked.rows.collect()] == [8]
    assert "extra" in checked.rejected.columns and "extra" not in checked.rows.columns
    assert contracts.check(frame, "bonuscheques", keep=("extra",)).rows.columns[-1] == "extra"
    assert contracts.check(frame.limit(0), "bonuscheques").report().collect() == []


# --- receipts by period -------------------------------------------------------------------


def _cheques(spark, months):
    rows = [("2001", m * 100 + i, "A", ts(f"2020-{m:02d}-{1 + i:02d} 23:59:59"), money(i)) for m in months for i in range(5)]
    return spark.createDataFrame(rows, CHEQUES)


@pytest.mark.parametrize("grain, folders", [("day", 15), ("month", 3)])
def test_periods_are_pruned(spark, tmp_path, grain, folders):
    path = f"{tmp_path}/cheques"
    cheques = _cheques(spark, (1, 2, 3))
    contracts.write_cheques(cheques, path, grain=grain)
    assert sum(name.startswith(f"{grain}=") for name in os.listdir(path)) == folders
    for period in (("2020-01-03", "2020-02-02"), ("2020-02-01", None), (None, "2020-01-31"), ("2021-01-01", "2021-02-01"), None):
        rows = contracts.read_cheques(spark, path, grain=grain, date_range=period).rows
        low, high = period or (None, None)
        wanted = [r for r in cheques.collect() if (not low or str(r.datetime)[:10] >= low) and (not high or str(r.datetime)[:10] <= high)]
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, wanted))
    rows = contracts.read_cheques(spark, path, grain=grain, date_range=("2020-01-03", "2020-01-04")).rows
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*{grain}", plan)


def test_writing_a_period_again_leaves_the_others(spark, tmp_path):
    path = f"{tmp_path}/cheques"
    contracts.write_cheques(_cheques(spark, (1, 2)), path, grain="month")
    for _ in range(2):
        contracts.write_cheques(_cheques(spark, (2, 3)).where("doc_id % 2 = 0"), path, grain="month")
    got = sorted(r.doc_id for r in contracts.read_cheques(spark, path, grain="month").rows.collect())
    assert got == [100, 101, 102, 103, 104, 200, 202, 204, 300, 302, 304]


def test_receipts_without_a_time_are_kept_apart(spark, tmp_path):
    frame = _cheques(spark, (1,)).withColumn("datetime", F.when(F.col("doc_id") != 102, F.col("datetime")))
    contracts.write_cheques(frame, f"{tmp_path}/cheques", grain="month")
    checked = contracts.read_cheques(spark, f"{tmp_path}/cheques", grain="month")
    assert checked.rows.count() == 4 and _problems(checked) == {"datetime: missing": 1}
    later = contracts.read_cheques(spark, f"{tmp_path}/cheques", grain="month", date_range=("2020-01-01", None))
    assert later.rows.count() == 4 and _problems(later) == {}


# --- published results ----------------------------------------------------------------------


def _content(spark, root, card):
    """File by file, in name order, without the part of a name that differs per run."""
    folder = f"{root}/card={card}"
    files = sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))
    return [[tuple(r) for r in spark.read.parquet(f).collect()] for f in files]


def test_a_rerun_gives_the_same_files(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, *range(50)]), f"v{rnd.randint(0, 9)}", float(i % 7)) for i in range(2_000)]
    frame = spark.createDataFrame(rows, "a int, b string, c double")
    order = [("a", False), "b"]
    sinks.publish(frame, str(tmp_path), "one", order_by=order, files=4)
    first = _content(spark, tmp_path, "one")
    sinks.publish(frame.repartition(13), str(tmp_path), "one", order_by=order, files=4)
    assert _content(spark, tmp_path, "one") == first
    flat = [r for file in first for r in file]
    key = lambda r: (r[0] is not None, -(r[0] or 0), r[1])
    assert [len(file) for file in first] == [500] * 4 and [key(r) for r in flat] == sorted(key(r) for r in flat)
    back = sinks.published(spark, str(tmp_path), "one", frame.schema, order)
    assert back.schema == frame.schema and [key(r) for r in back.collect()] == [key(r) for r in flat]


def test_partitions_and_other_cards_are_left_alone(spark, tmp_path):
    root = str(tmp_path)
    frame = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), (None, 4)], "g string, n int")
    sinks.publish(frame, root, "one", partition_by=("g",))
    sinks.publish(frame, root, "two")
    sinks.publish(spark.createDataFrame([("x", 9)], "g string, n int"), root, "one", partition_by=("g",))
    got = sinks.published(spark, root, "one", frame.schema)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("x", 9), ("y", 3), (None, 4)], key=str)
    assert sinks.published(spark, root, "two", frame.schema).count() == 4
    sinks.publish(frame.where("n = 1"), root, "two", files=1)
    assert [tuple(r) for r in sinks.published(spark, root, "two", frame.schema).collect()] == [("x", 1)]
    with pytest.raises(ValueError):
        sinks.publish(frame.withColumn("card", F.lit(1)), root, "three")


def test_a_failing_run_keeps_the_old_result(spark, tmp_path):
    root, frame = str(tmp_path), spark.range(10)
    sinks.publish(frame, root, "one")
    with pytest.raises(Exception):
        sinks.publish(frame.select(F.raise_error(F.lit("no")).cast("long").alias("id")), root, "one")
    assert sinks.published(spark, root, "one", frame.schema).count() == 10


# --- ordered limits ---------------------------------------------------------------------------


@pytest.mark.parametrize("order", [["a", "b"], [("a", False), "b"], [("c", False)], ["b"]])
@pytest.mark.parametrize("n", [0, 1, 49, 250, 499, 500, 10_000])
def test_ordered_limit(spark, order, n):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, *range(8)]), f"v{rnd.randint(0, 30)}", rnd.choice([None, 0.5, 1.5])) for _ in range(500)]
    frame = spark.createDataFrame(rows, "a int, b string, c double").repartition(3)
    found = [tuple(r) for r in ordered_limit(frame, n, order, ranges=5).collect()]
    named = [(o, True) if isinstance(o, str) else o for o in order]
    named += [(c, True) for c in "abc" if c not in dict(named)]
    sorting = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_first() for c, up in named]
    assert found == [tuple(r) for r in frame.orderBy(*sorting).limit(n).collect()]


def test_ordered_limit_of_an_empty_table(spark):
    assert ordered_limit(spark.range(0), 5, ["id"]).collect() == []


# --- intervals of clients at risk ---------------------------------------------------------------


def test_intervals_by_churn_risk(spark):
    days = {"new": ["2020-06-30", "2020-06-20", "2020-06-20"], "mid": ["2020-05-20", "2020-05-01", "2020-01-01"], "old": ["2020-01-05"]}
    rows = [(c, dt.date.fromisoformat(d)) for c, ds in days.items() for d in ds] + [("old", None)]
    tx = spark.createDataFrame(rows, "client_id string, transaction_date date")
    got = {r.churn_risk_segment: (r.clients_count, r.avg_interval_days) for r in lifecycle.avg_interval_by_churn_risk(tx).collect()}
    assert got == {lifecycle.RISK_LOW: (1, 10.0), lifecycle.RISK_MEDIUM: (1, 70.0), lifecycle.RISK_HIGH: (1, None)}
    assert lifecycle.avg_interval_by_churn_risk(tx.limit(0), today=dt.date(2020, 1, 1)).collect() == []
