"""Plan shape: no card funnels a large input into one task.

Every ``Exchange SinglePartition`` must sit directly on an aggregate (a global
aggregate of per-task partials, or a window over an already aggregated table
of bounded size).  Filters of the card prefix / period must reach the scan.
"""

from __future__ import annotations

import os
import re

import pytest

from segmenta.plans.cards import CARDS

SF_DIR = "/root/testdata/sf0.001"


def _physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")
def test_single_partition_exchanges_only_over_aggregates(spark):
    offenders = {}
    for key, card in CARDS.items():
        plan = _physical(card(spark, SF_DIR)).splitlines()
        for i, line in enumerate(plan):
            if "Exchange SinglePartition" in line:
                j = i + 1
                # look through projections / filters to the producing operator
                while j < len(plan) and re.match(r"^[\s:+-]*(Project|Filter) ", plan[j]):
                    j += 1
                child = plan[j] if j < len(plan) else ""
                if "HashAggregate" not in child:
                    offenders.setdefault(key, []).append(child.strip()[:120])
    assert not offenders, offenders


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")
def test_filters_reach_the_scan(spark):
    from segmenta.plans import cards

    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # pushed filters are shown whole
    plan = cards.q_registrations_daily(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", plan)
    report = cards.q_dashboard_filters(spark, SF_DIR)
    plan = report._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PushedFilters: \[[^\n]*In\(o_orderpriority", plan)
