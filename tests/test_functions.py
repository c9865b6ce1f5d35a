"""Distributed helpers against brute force: exact percentiles, chunked lag,
row replication, rounding rule."""

from __future__ import annotations

import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmenta.functions import columns, quantiles, sequence


def _cont(values, p):
    xs = sorted(values)
    h = p * (len(xs) - 1)
    lo, hi = math.floor(h), math.ceil(h)
    return xs[lo] + (h - lo) * (xs[hi] - xs[lo])


def test_exact_percentiles_with_a_hot_value(spark):
    rnd = random.Random(7)
    a = [rnd.choice([5.0, rnd.uniform(0, 100)]) for _ in range(3000)]  # one value ~ half the rows
    b = [float(rnd.randint(0, 20)) for _ in range(3000)]
    b[::11] = [None] * len(b[::11])
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    probs = (0.1, 0.25, 0.5, 0.75, 0.9)
    want = {(m, p): _cont([x for x in vals if x is not None], p) for m, vals in (("a", a), ("b", b)) for p in probs}
    for kwargs in ({}, {"window_values": 0}, {"window_values": 0, "accuracy": 20}):
        got = quantiles.exact_percentiles(df, {"a": "a", "b": "b"}, probs, **kwargs).collect()[0]
        for (m, p), v in want.items():
            assert got[f"{m}_p{p}"] == v, (kwargs, m, p)


def test_exact_percentiles_of_infinite_equal_and_missing_values(spark):
    rows = [(float("inf"), 4.0, None), (1.0, 4.0, None), (float("inf"), 4.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = quantiles.exact_percentiles(df, {"a": "a", "b": "b", "c": "c"}, (0.0, 0.75)).collect()[0]
    assert list(got) == [1.0, float("inf"), 4.0, 4.0, None, None]


def test_lag_by_key_equals_plain_lag(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(2000):
        key = None if rnd.random() < 0.4 else rnd.randint(1, 5)  # hot NULL key
        val = None if rnd.random() < 0.3 else f"v{i}"
        rows.append((key, i * 17 + rnd.randint(0, 16), val))
    df = spark.createDataFrame(rows, "k long, t long, x string").withColumn(
        "ts", F.timestamp_seconds(F.col("t"))
    )
    w = Window.partitionBy("k").orderBy("ts")
    plain = {(r.k, r.t): r.p for r in df.select("k", "t", F.lag("x").over(w).alias("p")).collect()}
    chunked = sequence.lag_by_key(df, "k", "ts", ["x"], chunk_seconds=300)
    assert {(r.k, r.t): r.prev_x for r in chunked.collect()} == plain
    ffill = {
        (r.k, r.t): r.p
        for r in df.select(
            "k", "t", F.last("x", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("p")
        ).collect()
    }
    chunked_ff = sequence.lag_by_key(df, "k", "ts", ["x"], chunk_seconds=300, ignore_nulls=True)
    assert {(r.k, r.t): r.prev_x for r in chunked_ff.collect()} == ffill


def test_replicate_emits_exact_copies(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 7), ("d", 50)], "k string, n long")
    got = sequence.replicate(df.withColumn("m", F.col("n")), "m", block=4).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in got} == {"b": 1, "c": 7, "d": 50}


def test_percent_rounds_half_up_exactly(spark):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType())])
    df = spark.createDataFrame([(23, 160), (1, 3), (1, 8), (2, 3)], schema)
    got = [r.p for r in df.select(columns.percent("k", "n", 2).alias("p")).collect()]
    assert got == [14.38, 33.33, 12.5, 66.67]
    got = [r.q for r in df.select(columns.ratio("k", "n", 2).alias("q")).collect()]
    assert got == [0.14, 0.33, 0.13, 0.67]


def test_moments_count_as_their_days():
    import datetime as dt

    from segmenta.operators.filters import _as_date

    assert _as_date(dt.datetime(2024, 1, 2, 10)) == dt.date(2024, 1, 2) == _as_date("2024-01-02 10:00:00")


def test_settings_fixed_at_the_start_are_left_alone(spark):
    from segmenta.session import get_spark

    again = get_spark(extra_conf={"spark.sql.warehouse.dir": "/tmp/other", "spark.sql.shuffle.partitions": "8"})
    assert again.conf.get("spark.sql.warehouse.dir") != "/tmp/other"


def test_wide_brackets_read_the_measures_twice(spark):
    """Whatever their number, the measures are read by one sketch and one count of brackets."""
    reads = []
    frame = spark.range(0, 50_000, 1, 4).select((F.col("id") * 7919 % 50_021).cast("double").alias("a"))
    narrowed = quantiles._tagged

    def counted(long, spans):
        reads.append(len(spans))
        return narrowed(long, spans)

    quantiles._tagged = counted
    try:
        got = quantiles.exact_percentiles(frame, {"a": "a"}, (0.25, 0.5, 0.999), window_values=10, counts={"a": 50_000})
        assert list(got.collect()[0]) == [_cont([i * 7919 % 50_021 for i in range(50_000)], p) for p in (0.25, 0.5, 0.999)]
    finally:
        quantiles._tagged = narrowed
    assert reads == [1, 3]


def test_url_values_equal_the_regular_expression(spark):
    """The fold against ``last key= followed by a value``, on random strings."""
    keys = ("discount", "utm_source", "funnel", "source")
    rnd = random.Random(4)
    parts = ["source=", "utm_source=", "discount=", "funnel=", "&", "?", "a", "=", "&source=&", "x=1", "\n", "é"]
    rows = [("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))),) for _ in range(5_000)] + [(None,), ("",)]
    frame = spark.createDataFrame(rows, "u string")
    for exact, anchor in ((False, ""), (True, "(?:^|[?&])")):
        regex = [F.nullif(F.regexp_extract("u", f"(?s).*{anchor}{k}=([^&]+)", 1), F.lit("")).alias(k) for k in keys]
        wanted = frame.select("u", *regex).collect()
        assert frame.select("u", columns.url_values("u", keys, exact).alias("v")).select("u", "v.*").collect() == wanted


def test_small_dimensions_are_read_once(spark):
    from segmenta.functions.joins import broadcast_if_small

    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    frame = spark.range(5).mapInPandas(note, "id long")
    joined = spark.range(100).join(broadcast_if_small(frame, 5), "id")
    assert joined.count() == 5 and joined.count() == 5 and seen.value == 5
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    large = broadcast_if_small(frame, 4)
    assert large is frame
