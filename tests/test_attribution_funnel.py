"""URL parameters, attribution fill, long form and the step funnel: micro cases."""

from __future__ import annotations

from frames import STAT, ts
from segmenta.operators import attribution, funnel


def _stat(spark, rows):
    return spark.createDataFrame([(u, e, ts(t), url) for u, e, t, url in rows], STAT)


def test_url_param_semantics(spark):
    rows = [
        (1, "enter_site", "2024-01-01 00:00:00", "?source=a&utm_source=b"),
        (1, "enter_site", "2024-01-01 00:00:01", "?discount=&funnel=f9"),
        (1, "enter_site", "2024-01-01 00:00:02", "?discount=5&discount=7#top"),
        (1, "enter_site", "2024-01-01 00:00:03", None),
        (1, "enter_site", "2024-01-01 00:00:04", "?page=1\n&source=z"),
    ]
    got = [r.asDict() for r in attribution.url_params(_stat(spark, rows)).orderBy("created_at").collect()]
    assert (got[0]["source"], got[0]["utm_source"]) == ("b", "b")  # last match, inside utm_source
    assert (got[1]["discount"], got[1]["funnel"]) == (None, "f9")  # empty value -> NULL
    assert got[2]["discount"] == "7#top"  # last occurrence wins, fragment kept
    assert all(got[3][k] is None for k in attribution.PARAM_KEYS)
    assert got[4]["source"] == "z"  # line break crossed
    exact = attribution.url_params(_stat(spark, rows[:1]), exact_key=True).collect()[0]
    assert (exact.source, exact.utm_source) == ("a", "b")


def test_fill_reaches_one_row_back_only(spark):
    rows = [
        (1, "enter_site", "2024-01-01 00:59:00", "?utm_source=a"),
        (1, "open_page", "2024-01-01 01:00:00", None),  # next hour chunk: still filled
        (1, "open_page", "2024-01-01 03:00:00", None),  # two blanks in a row: stays NULL
        (None, "enter_site", "2024-01-01 00:00:00", "?utm_source=x"),
        (None, "open_page", "2024-01-01 00:00:01", None),  # NULL uid is one group
        (2, "open_page", "2024-01-01 00:00:02", None),
    ]
    parsed = attribution.url_params(_stat(spark, rows))
    got = {(r.uid, str(r.created_at)): r.utm_source_filled for r in attribution.attribution_fill(parsed).collect()}
    assert got[(1, "2024-01-01 01:00:00")] == "a"
    assert got[(1, "2024-01-01 03:00:00")] is None
    assert got[(None, "2024-01-01 00:00:01")] == "x"
    assert got[(2, "2024-01-01 00:00:02")] is None
    carry = {
        (r.uid, str(r.created_at)): r.utm_source_filled
        for r in attribution.attribution_fill(parsed, carry_forward=True).collect()
    }
    assert carry[(1, "2024-01-01 03:00:00")] == "a"


def test_long_form_and_counts(spark):
    rows = [
        (1, "enter_site", "2024-01-01 00:00:00", "?utm_source=a&funnel=f"),
        (1, "open_page", "2024-01-01 00:00:01", "?utm_source=a"),
    ]
    filled = attribution.attribution_fill(attribution.url_params(_stat(spark, rows)))
    long = attribution.param_rows(filled)
    # 'source=' also matches inside 'utm_source=' (faithful key matching)
    assert sorted((r.event, r.param) for r in long.collect()) == [
        ("enter_site", "funnel=f"),
        ("enter_site", "source=a"),
        ("enter_site", "utm_source=a"),
        ("open_page", "funnel=f"),  # filled from the previous row
        ("open_page", "source=a"),
        ("open_page", "utm_source=a"),
    ]
    counts = {(r.params, r.event): r.cnt for r in attribution.param_event_counts(long).collect()}
    assert counts[("utm_source=a", "enter_site")] == 1


def test_funnel_missing_step_and_conversion_above_100(spark):
    rows = []
    t = 0
    for uid, event in [(1, "enter_site"), (2, "enter_site"), (1, "request_consultation"),
                       (2, "request_consultation"), (3, "request_consultation")]:
        rows.append((uid, event, f"2024-01-01 00:00:{t:02d}", "?utm_source=a"))
        t += 1
    filled = attribution.attribution_fill(attribution.url_params(_stat(spark, rows)))
    steps = funnel.param_funnel_steps(funnel.param_funnel_flags(attribution.param_rows(filled)))
    only_utm = funnel.param_funnel(steps, param="utm_source=a")  # 'source=a' rows exist too
    got = [(r.step, r.users_count, r.conversion_percent) for r in only_utm.collect()]
    assert got == [
        (funnel.FUNNEL_STEPS[0][2], 2, 100.0),
        (funnel.FUNNEL_STEPS[2][2], 3, 150.0),  # against the previous *present* step
    ]
    assert funnel.param_funnel(steps, param="UTM_SOURCE=%").count() == 2
    assert funnel.param_funnel(steps, param="funnel=%").count() == 0


def test_equal_timestamps_resolved_by_tiebreak(spark):
    from pyspark.sql import functions as F

    rows = [
        (1, "enter_site", "2024-01-01 00:00:00", "?utm_source=a"),
        (1, "open_page", "2024-01-01 00:00:00", None),  # same instant as the row above
    ]
    parsed = attribution.url_params(_stat(spark, rows)).withColumn(
        "seq", F.when(F.col("event") == "enter_site", 0).otherwise(1)
    )
    filled = attribution.attribution_fill(parsed, tiebreak=("seq",)).collect()
    assert {r.event: r.utm_source_filled for r in filled} == {"enter_site": "a", "open_page": "a"}
