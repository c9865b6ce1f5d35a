"""Whitening against dense linear algebra on the same integers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from segmenta.llm import queries, whitening
from segmenta.llm.common import read_table

SCHEMA = "vec_id long, embedding array<float>, n string, component int"
SF_DIR = "/root/testdata/sf0.001"


def dense(rows, components=4):
    """Per (id, component): n, deviation, whitened, explained."""
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for _, v in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = fit - sums / n
    values, directions = np.linalg.eigh(y.T @ y / n)
    values, directions = values[::-1], directions[:, ::-1]
    k = min(components, int((values > values[0] * 1e-10).sum()))
    white = (x - sums / n) @ (directions[:, :k] / np.sqrt(values[:k]))
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    return n, deviation, white, values[:k] / values.sum()


def check(found, rows):
    n, deviation, white, explained = dense(rows)
    k = white.shape[1]
    assert len(found) == len(rows) * k
    at = {}
    for i, (vec_id, vector) in enumerate(rows):
        at.setdefault((vec_id, tuple(vector)), i)
    by_id = {vec_id: i for (vec_id, _), i in at.items()}
    got = np.full_like(white, np.nan)
    for r in found:
        i = by_id[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation[i])
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        assert r.identity_error < 1e-9
        got[i, r.component - 1] = r.whitened
    known = sorted(by_id.values(), key=str)
    for c in range(k):
        sign = 1 if got[known[0], c] * white[known[0], c] > 0 else -1
        assert np.allclose(got[known, c], sign * white[known, c], rtol=1e-8, atol=1e-8)


def test_query_on_given_vectors(spark):
    found = queries.op12_whitening(spark, SF_DIR)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = [(r.vec_id, r.embedding) for r in read_table(spark, SF_DIR, "embeddings").collect()]
    check(found.collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=6) * [5, 4, 3, 2, 1, 0.5]]) for i in range(50)]
    good += [(100 + i, good[0][1]) for i in range(30)] + [(None, good[1][1]), good[2]]
    bad = [(-1, None), (-2, [float("nan")] * 6), (-3, [0.0] * 5 + [float("-inf")]), (-4, [None] * 6), (-5, []), (999, [1.0] * 4)]
    rows = [(i, v, "x", None) for i, v in good + bad]
    check(whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), good)


def test_fewer_directions_than_components(spark):
    line = [(i, [float(i), 2.0 * i, 1.0, 0.0, 0.0]) for i in range(9)]
    found = whitening.whiten(spark.createDataFrame([(*r, "", 0) for r in line], SCHEMA)).collect()
    assert {r.component for r in found} == {1} and len(found) == 9
    check(found, line)
    same = spark.createDataFrame([(i, [1.0, 2.0], "", 0) for i in range(5)], SCHEMA)
    assert whitening.whiten(same).collect() == []


def test_components_beyond_the_range(spark):
    rows = [(0, [1e30, 0.0]), (1, [-1e30, 1.0]), (2, [0.0, 2.0]), (3, [5.0, 7.0])]
    found = whitening.whiten(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)).collect()
    assert len(found) == 8 and all(math.isfinite(r.whitened) for r in found)


def test_factors_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "FOLDED_ROWS", 7)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=8) * range(1, 9)]) for i in range(300)]
    frame = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    monkeypatch.setattr(whitening, "materialize", lambda df, label: df.repartition(9))
    check(whitening.whiten(frame).collect(), rows)


@pytest.mark.parametrize("size, grade", [(1, 0), (2, 0), (5, 0), (40, 0), (40, 3), (40, -3), (120, 2)])
def test_solver(size, grade):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(3 * size + 2, size)) * np.logspace(0, grade, size)
    x -= x.mean(axis=0)
    diagonal, above, q = whitening.bidiagonalise(np.linalg.qr(x, mode="r"))
    assert np.allclose(q.T @ q, np.eye(size), atol=1e-12)
    b = np.diag(diagonal) + np.diag(above, 1)
    values = whitening.squared_singular_values(diagonal, above)
    assert np.allclose(values, np.linalg.svd(x, compute_uv=False) ** 2, rtol=1e-7)
    k = min(4, size)
    z = whitening.right_vectors(diagonal, above, values[:k])
    assert np.allclose(z.T @ z, np.eye(k), atol=1e-11)
    assert np.abs(b.T @ (b @ z) - z * values[:k]).max() <= 1e-12 * values[0]


def test_solver_keeps_small_values_accurate():
    diagonal, above = np.array([1.0, 1e-8, 1e-4, 2.0]), np.array([0.5, 1e-9, 0.3])
    exact = [4.09, 1.25, 9.779951100244499e-09, 8e-17]
    assert np.allclose(whitening.squared_singular_values(diagonal, above), exact, rtol=1e-6)


def test_equal_values_have_orthonormal_vectors():
    for x in (np.vstack([np.eye(8), -np.eye(8)]), np.kron(np.eye(4), [[1.0, 1], [1, -1], [-1, 1], [-1, -1]])):
        variances, directions, explained = whitening.principal(np.linalg.qr(x, mode="r"), len(x), 4)
        assert np.allclose(directions.T @ directions, np.eye(4), atol=1e-12)
        assert np.allclose(x.T @ (x @ directions) / len(x), directions * variances, atol=1e-12)
        assert np.allclose(explained, 1 / 8)


def test_deviations_beyond_a_long():
    x = np.array([[1 << 30, 0], [1, 2]])
    assert whitening.deviations(x, 1 << 20, np.array([0, 5])) == [None, (1 << 20) ** 2 + ((2 << 20) - 5) ** 2]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op12_whitening(spark, str(tmp_path)).collect() == []
