"""The per-key lag in pieces: total order, bounded pieces, one scan of the table."""

from __future__ import annotations

import datetime as dt
import os
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from segmenta.functions import sequence
from segmenta.plans import cards

SF_DIR = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    """A hot NULL key, many equal times, missing times and ids."""
    rnd = random.Random(11)
    rows = []
    for i in range(6_000):
        key = None if i % 3 == 0 else rnd.randint(1, 4)
        time = None if rnd.random() < 0.2 else START + dt.timedelta(seconds=rnd.choice([0, 0, 7, rnd.randint(0, 9_000)]))
        rows.append((key, time, None if i == 17 else i, None if rnd.random() < 0.4 else f"v{i}", float(i % 5)))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "k long, t timestamp_ntz, id long, x string, y double")


def plain(log, ignore_nulls):
    w = Window.partitionBy("k").orderBy(F.col("t").asc_nulls_last(), F.col("id").asc_nulls_last())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    prior = [F.last(c, ignorenulls=True).over(before) if ignore_nulls else F.lag(c).over(w) for c in ("x", "y")]
    return {r.id: (r.a, r.b) for r in log.select("id", prior[0].alias("a"), prior[1].alias("b")).collect()}


@pytest.mark.parametrize("ignore_nulls", [False, True])
@pytest.mark.parametrize("piece_rows", [1, 40, 1_000_000])
def test_equals_a_plain_lag_over_a_total_order(log, piece_rows, ignore_nulls):
    found = sequence.lag_by_key(
        log, "k", "t", ["x", "y"], tiebreak=("id",), piece_rows=piece_rows, ignore_nulls=ignore_nulls
    )
    assert found.columns == [*log.columns, "prev_x", "prev_y"]
    assert {r.id: (r.prev_x, r.prev_y) for r in found.collect()} == plain(log, ignore_nulls)


@pytest.mark.parametrize("piece_rows", [1, 25, 300])
def test_pieces_are_bounded(log, piece_rows):
    """No piece holds more than twice the wanted rows, although a third of the rows share one key
    and one instant or none."""
    rows = log.select(
        F.coalesce("k", F.lit(0)).alias("_kv"), F.col("k").isNull().alias("_kn"),
        F.when(F.col("t").isNull(), sequence.LAST).otherwise(0).alias("_chunk"),
        F.coalesce(sequence._micros("t", log.schema["t"].dataType), F.lit(sequence.LAST)).alias("_m"),
        F.coalesce("id", F.lit(sequence.LAST)).alias("_t"),
    )
    starts = sequence._cut_points(rows, piece_rows)
    at = F.struct(F.col("_m").alias("_m0"), F.col("_t").alias("_t0"))
    parts = ["_kv", "_kn", "_chunk"]
    sizes = (
        rows.join(starts, parts, "left")
        .withColumn("_piece", F.coalesce(F.size(F.filter("_starts", lambda s: s <= at)), F.lit(0)))
        .groupBy(*parts, "_piece").count().agg(F.max("count"), F.count(F.lit(1))).first()
    )
    assert sizes[0] <= 2 * piece_rows and sizes[1] >= 6_000 / (2 * piece_rows)


def test_no_pieces_without_a_hot_chunk(log):
    rows = log.select(F.lit(0).alias("_kv"), F.lit(False).alias("_kn"), F.lit(0).alias("_chunk"), F.col("id").alias("_m"), F.lit(0).alias("_t"))
    assert sequence._cut_points(rows, 6_000) is None


def test_without_a_tiebreak_every_value_is_carried_once(spark):
    """Rows of one instant follow each other in one order: no value is used twice."""
    rows = [(1, START, f"v{i}") for i in range(500)] + [(1, None, f"n{i}") for i in range(500)]
    frame = spark.createDataFrame(rows, "k long, t timestamp_ntz, x string").repartition(16)
    before = [r.prev_x for r in sequence.lag_by_key(frame, "k", "t", ["x"]).collect()]
    assert len(set(before)) == 1000 and before.count(None) == 1


def test_rows_without_a_time_lend_nothing_to_dated_rows(spark):
    rows = [(1, None, "late", 3), (1, START, None, 1), (1, START + dt.timedelta(hours=5), None, 2)]
    frame = spark.createDataFrame(rows, "k long, t timestamp_ntz, x string, id long")
    got = {r.id: r.prev_x for r in sequence.lag_by_key(frame, "k", "t", ["x"], tiebreak=("id",)).collect()}
    assert got == {1: None, 2: None, 3: None}


def test_empty_table_and_one_row(spark):
    frame = spark.createDataFrame([(1, START, "a")], "k long, t timestamp_ntz, x string")
    assert [r.prev_x for r in sequence.lag_by_key(frame, "k", "t", ["x"], piece_rows=1).collect()] == [None]
    assert sequence.lag_by_key(frame.limit(0), "k", "t", ["x"]).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")
@pytest.mark.parametrize("card", [cards.q_attribution_fill, cards.q_attribution_carry_forward])
def test_the_log_is_scanned_once(spark, card):
    df = card(spark, SF_DIR)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall("FileScan", plan)) == 1 and "ReusedExchange" in plan
