"""Source-level rules for the library (not the tests or the oracle SQL):
no RDD code, no Python UDFs, no cross joins, no local checkpoints, and
driver-side reads only of results bounded by construction."""

from __future__ import annotations

import pathlib
import re

PKG = pathlib.Path(__file__).resolve().parents[1] / "segmenta"

# Files allowed to bring results to the driver, and why the result is bounded.
BOUNDED_COLLECTS = {
    "functions/joins.py": "one_row(): a global aggregate, exactly one row; any_row(): at most one",
    "functions/sequence.py": "replicate_in_order(): one count per day of the calendar",
    "functions/limits.py": "with_positions(): one count per range",
    "functions/quantiles.py": "per-measure counts / sketches and at most two values per probability",
}


def _library_sources():
    for path in sorted(PKG.rglob("*.py")):
        rel = path.relative_to(PKG).as_posix()
        if rel.startswith(("plans/oracle.py", "llm/")):
            continue  # DuckDB SQL text; a subpackage with rules of its own
        yield rel, path.read_text()


def test_no_forbidden_constructs():
    forbidden = {
        r"\.rdd\b": "RDD code",
        r"\budf\b|pandas_udf": "Python UDF",
        r"crossJoin": "cross join",
        r"localCheckpoint": "local checkpoint",
        r"toPandas": "whole result to the driver",
    }
    hits = [
        (rel, why)
        for rel, src in _library_sources()
        for pat, why in forbidden.items()
        if re.search(pat, src)
    ]
    assert not hits, hits


def test_driver_reads_only_bounded_results():
    hits = [
        rel
        for rel, src in _library_sources()
        if re.search(r"\.collect\(\)|\.take\(|\.first\(\)", src) and rel not in BOUNDED_COLLECTS
    ]
    assert not hits, hits
