"""Codes of vectors against brute force over all pairs of parts and entries."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from segmenta.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"
SF_DIR = "/root/testdata/sf0.001"


def brute(rows, parts, entries, rounds):
    """Codes, errors and codebooks of ``(vec_id, vector)``, the ids in order."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) for c in v] for _, v in rows], np.int64)
    length = x.shape[1]
    codes, errors, books = [], np.zeros(len(x), np.int64), []
    for p in range(parts):
        w = x[:, length * p // parts : length * (p + 1) // parts]
        book = w[:entries].copy()
        for r in range(rounds + 1):
            away = ((w[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
            chosen = away.argmin(axis=1)
            if r < rounds:
                for e in set(chosen.tolist()):
                    own = w[chosen == e]
                    book[e] = [math.floor(int(s) / len(own)) if abs(int(s)) < 1 << 40 else int(s) // len(own) for s in own.sum(axis=0)]
        codes.append(chosen)
        errors += away.min(axis=1)
        books.append(book)
    return ["".join(f"{c:02x}" for c in row) for row in zip(*codes)], errors.tolist(), books


def expected(rows, parts=4, entries=256, rounds=4):
    """Rows of :func:`vector_codes.compress` for ``(vec_id, vector, label)``."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [float(c) for c in r[1]]))
    codes, errors, books = brute([r[:2] for r in rows], parts, entries, rounds)
    of_label = {}
    for (_, _, label), error in zip(rows, errors):
        of_label[label] = of_label.get(label, 0) + error
    digest = vector_codes.digest(books)
    return [(r[0], c, e, of_label[r[2]], digest) for r, c, e in zip(rows, codes, errors)]


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def vectors(n, length, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, length))
    return [[float(c) for c in np.float32(centres[i % 8] + spread * rng.normal(size=length))] for i in range(n)]


def test_against_brute_force(spark):
    rows = [(i * 7 % 1000, v, None if i % 5 == 0 else i % 3) for i, v in enumerate(vectors(600, 16, 1))]
    found = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), entries=32)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert in_order(found.collect()) == in_order(expected(rows, entries=32))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [0.1 * i, -0.2, 0.3, 1.0, 0.001 * i, 0.0], i % 2) for i in range(20)]
    good += [(3, good[3][1], 1), (3, good[3][1], 1), (None, good[4][1], None), (40, [9e9, -9e9, 0.0, 0.0, 0.0, 0.0], None)]
    bad = [(-1, None), (-2, [nan] * 6), (-3, [0.0] * 5 + [inf]), (-4, [None] * 6), (-5, []), (50, [1.0] * 4)]
    rows = [(i, v, label, "x", None) for i, v, label in good] + [(i, v, 1, None, 2) for i, v in bad]
    found = in_order(vector_codes.compress(spark.createDataFrame(rows, SCHEMA)).collect())
    held = [(i, [min(max(c, -16384.0), 16384.0) for c in v], label) for i, v, label in good]
    assert found == in_order(expected(held))


def test_equal_entries_and_one_hot_vector(spark):
    rows = [(i, [0.5] * 8 if i % 3 else [0.25 * (i % 7)] * 8, 1) for i in range(5_000)]
    found = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), entries=16)
    assert in_order(found.collect()) == in_order(expected(rows, entries=16))


@pytest.mark.parametrize("spread", [0.0, 0.05, 2.0])
def test_trees(spread):
    values = vector_codes.scaled(np.array(vectors(3_000, 8, 2, spread)))
    tree = vector_codes.plant(values)
    assert sorted(tree.order.tolist()) == list(range(3_000))
    assert (tree.points == values[tree.order]).all()
    for i, (left, right) in enumerate(tree.child):
        own = tree.points[tree.first[i] : tree.last[i]].astype(np.int64)
        assert (own.sum(axis=0) == tree.sums[i]).all()
        assert np.sqrt(((own - tree.centres[i]) ** 2).sum(axis=1)).max() <= tree.radii[i] * (1 + 1e-12) + 1e-9
        if left >= 0:
            assert (tree.first[left], tree.last[left], tree.last[right]) == (tree.first[i], tree.first[right], tree.last[i])
    book = vector_codes.Codebook(values[:64])
    found = vector_codes.walk(tree, book, each_row=True)
    away = ((values[:, None, :] - book.entries) ** 2).sum(axis=2)
    assert (found.entry == away.argmin(axis=1)).all() and (found.error == away.min(axis=1)).all()
    assert (found.counts == np.bincount(found.entry, minlength=64)).all()
    assert all((found.sums[e] == values[found.entry == e].sum(axis=0)).all() for e in range(64))
    if spread < 1:  # lists shrink: most points meet few entries, or none
        assert found.compared < len(values) * 64 / 2


def test_large_components_stay_exact():
    values = np.random.default_rng(4).integers(-vector_codes.LIMIT, vector_codes.LIMIT, (200, 16))
    book = vector_codes.Codebook(values[:40])
    found = vector_codes.walk(vector_codes.plant(values), book, each_row=True)
    away = ((values[:, None, :] - book.entries) ** 2).sum(axis=2)
    assert (found.entry == away.argmin(axis=1)).all() and (found.error == away.min(axis=1)).all()


def test_totals_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "FAN", 2)
    monkeypatch.setattr(vector_codes, "BLOCK", 50)
    rows = [(i, v, i % 3) for i, v in enumerate(vectors(400, 8, 5))]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7)
    assert in_order(vector_codes.compress(docs, entries=16, rounds=2).collect()) == in_order(expected(rows, entries=16, rounds=2))


def test_query_and_its_sql(spark):
    found = queries.op11_vector_codes(spark, SF_DIR)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_DIR}/embeddings.parquet'")
    wanted = con.sql(queries.ORACLE_SQL["op11_vector_codes"])
    assert sorted(wanted.columns) == sorted(found.columns)
    columns = found.columns
    assert in_order(found.collect()) == in_order(wanted.project(", ".join(columns)).fetchall())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op11_vector_codes(spark, str(tmp_path)).collect() == []
