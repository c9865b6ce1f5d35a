"""Every registered card against its DuckDB oracle (literal joins), exact doubles.

sf0.001 runs all cards; SEGMENTA_ORACLE_SF=0.01 (or a path) widens the check."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as se
import oracle_compare
from segmenta.plans.cards import CARDS

SF_DIR = os.environ.get("SEGMENTA_ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")
def test_all_cards_match_oracle(spark):
    oracle_compare.STRICT = True
    results = oracle_compare.compare(spark, SF_DIR, keys=list(CARDS), verbose=False)
    assert set(results) == set(CARDS)
    bad = {k: v for k, v in results.items() if not v.get("match")}
    assert not bad, bad


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.columns == ["rfm_group", "shop", "monetary", "recency", "frequency", "client_id", "rfm_code"]
    assert df.count() > 0
