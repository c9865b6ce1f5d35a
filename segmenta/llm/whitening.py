"""Whitening of embeddings by a bidiagonal qd solver.

Components become integers, ``floor(SCALE * c)``; the fit list holds each distinct vector once.

1. Number and sums of the fit list are exact.
2. Its rows, centred by them, are reduced block by block to a triangular factor: every task folds
   its rows into one ``d x d`` factor by QR, and the tasks' factors are folded in groups of ``FAN``.
   No product of the data with itself is formed, so small variances keep their accuracy.
3. On the driver, which only ever sees ``d x d`` numbers: Householder reflections bring the factor
   to bidiagonal form, dqds finds the squared singular values to high relative accuracy, and the
   vector of each is read from the twisted factorisation that nearly vanishes, corrected by its
   Rayleigh quotient, and carried back through the reflections.
4. Every row of the table is projected where it lies.

Results for odd input: rows whose vector is null, or holds null or non-finite components, are
dropped; so are vectors without components and those of another length than the vector of the
smallest ``vec_id`` (null ids last).  Integers are held to ``+-LIMIT``.  Components without variance
(fewer distinct vectors or dimensions than components) are left out, so one distinct vector, like
an empty table, gives no rows.  Null ids and repeated rows are rows like any other.  A deviation
beyond a long is null.  Equal eigenvalues: some orthonormal vectors of their space.  Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import materialize
from segmenta.llm.vector_codes import finite

SCALE = 256
LIMIT = 1 << 30
#: Rows that are folded into a task's triangular factor at once.
FOLDED_ROWS = 4096
#: Factors that are folded in one task.
FAN = 64
EPS = float(np.finfo(np.float64).eps)
LONGEST = (1 << 63) - 1


# --- the solver ---------------------------------------------------------------------------


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """``v`` and ``value`` with ``(1 - 2 v v') x = (value, 0, 0, ...)``, ``v`` of length one or zero."""
    size = float(np.linalg.norm(x))
    v = x.copy()
    if size == 0:
        return v, 0.0
    value = -size if x[0] >= 0 else size
    v[0] -= value
    return v / np.linalg.norm(v), value


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor ``q`` (orthogonal) of ``r = u b q'``."""
    a = r.astype(np.float64).copy()
    n = a.shape[1]
    right = []
    for k in range(n):
        v, value = _reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        a[k, k] = value
        if k < n - 2:
            w, value = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            a[k, k + 1] = value
            right.append((k + 1, w))
    q = np.eye(n)
    for at, w in reversed(right):
        q[at:, :] -= 2 * np.outer(w, w @ q[at:, :])
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def _shifted(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """One differential qd step; None if the shift was too large."""
    n = len(q)
    new_q, new_e = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0:
            return None
        new_q[i] = d + e[i]
        if new_q[i] == 0:  # a zero value: the next ones start anew
            new_e[i], d = 0.0, q[i + 1] - shift
            continue
        factor = q[i + 1] / new_q[i]
        new_e[i] = e[i] * factor
        d = d * factor - shift
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Of an upper bidiagonal matrix, by dqds; falling."""
    found: list[float] = []
    work = [(diagonal**2, above**2, 0.0)]
    while work:
        q, e, total = work.pop()
        while len(q) > 1:
            cut = (10 * EPS) ** 2 * (total + q[1:])
            small = np.flatnonzero((e <= cut) | (e == 0))
            if len(small):
                k = int(small[-1])
                if k < len(q) - 2:  # falls apart
                    work.append((q[: k + 1], e[:k], total))
                    q, e = q[k + 1 :], e[k + 1 :]
                else:
                    found.append(total + q[-1])
                    q, e = q[:-1], e[:-1]
                continue
            if 1.5 * q[0] < q[-1]:  # the small ones belong at the end
                q, e = q[::-1].copy(), e[::-1].copy()
            # The smaller value of the last two rows guides the shift.
            x, y, z = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
            half = (x - y) / 2
            root = np.hypot(half, np.sqrt(z))
            shift = max(0.0, y - z / (half + root) if half >= 0 and half + root > 0 else y + half - root)
            shift = min(shift, q[-1])
            step = None
            for factor in (1 - 1e-12, 0.75, 0.25, 0.0):
                step = _shifted(q, e, shift * factor)
                if step is not None:
                    total += shift * factor
                    break
            q, e = step
        found.append(total + q[0])
    return np.sort(np.maximum(found, 0.0))[::-1]


def _twisted(d: np.ndarray, l: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The twisted factorisations of ``L D L' - value``: multipliers from above and from below, and
    all twists."""
    n = len(d)
    tiny = EPS * EPS * max(float(np.abs(d).max()), 1e-300)
    down, up = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    s, p = np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + d[i]
        pivot = pivot if abs(pivot) > tiny else tiny
        down[i] = d[i] * l[i] / pivot
        s[i + 1] = down[i] * l[i] * s[i] - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = d[i] * l[i] * l[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        factor = d[i] / pivot
        up[i] = l[i] * factor
        p[i] = p[i + 1] * factor - value
    return down, up, s + (p + value)


def _vector(down: np.ndarray, up: np.ndarray, at: int, n: int) -> np.ndarray:
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z


def right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors (columns) of an upper bidiagonal matrix for its largest squared
    singular values, falling."""
    n = len(diagonal)
    scale = max(float(np.abs(diagonal).max(initial=0)), float(np.abs(above).max(initial=0)), 1e-200)
    whole = np.where(np.abs(diagonal) > EPS * EPS * scale, diagonal, EPS * EPS * scale)
    d, l = whole**2, above / whole[:-1]

    def times(z: np.ndarray) -> np.ndarray:  # the matrix, its transpose times itself
        y = diagonal * z
        y[:-1] += above * z[1:]
        out = diagonal * y
        out[1:] += above * y[:-1]
        return out

    out = np.zeros((n, len(values)))
    for k, wanted in enumerate(values):
        value = float(wanted)
        close = [j for j in range(k) if values[j] - value <= 1e-3 * values[0]]
        best, best_residual = None, np.inf
        down, up, twists = _twisted(d, l, value)
        # Equal values share their best twists: a vector that the earlier ones hold is passed over.
        for at in np.argsort(np.abs(twists), kind="stable")[: 8 + 4 * len(close)]:
            z = _vector(down, up, int(at), n)
            z /= np.linalg.norm(z)
            mu = value
            for _ in range(3):
                for j in close + close:
                    z -= (out[:, j] @ z) * out[:, j]
                size = np.linalg.norm(z)
                if size < 1e-3:
                    break
                z /= size
                mu = float(z @ times(z))
                residual = float(np.linalg.norm(times(z) - mu * z))
                if residual < best_residual:
                    best, best_residual = z.copy(), residual
                if residual <= 4 * EPS * values[0]:
                    break
                again_down, again_up, again = _twisted(d, l, mu)
                z = _vector(again_down, again_up, int(np.abs(again).argmin()), n)
                z /= np.linalg.norm(z)
            if best is not None and best_residual <= 64 * EPS * values[0]:
                break
        out[:, k] = best if best is not None else _any_other(out[:, :k])
    return out


def _any_other(known: np.ndarray) -> np.ndarray:
    """A unit vector orthogonal to the known ones (for values that fill a whole space)."""
    rest = np.eye(len(known)) - known @ known.T
    z = rest[:, int(np.linalg.norm(rest, axis=0).argmax())]
    return z / np.linalg.norm(z)


def principal(r: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the triangular factor of ``n`` centred rows: the largest variances above rounding,
    their directions (columns), and each one's share of all variance."""
    width = r.shape[1]
    diagonal, above, q = bidiagonalise(np.vstack([r, np.zeros((max(0, width - len(r)), width))]))
    values = squared_singular_values(diagonal, above)
    real = values[:components]
    real = real[real > values[0] * (EPS * width) ** 2] if len(real) else real
    return real / n, q @ right_vectors(diagonal, above, real), real / values.sum()


# --- Spark ----------------------------------------------------------------------------------


def integers(vector: str) -> Column:
    def held(c: Column) -> Column:
        return F.least(F.greatest(F.floor(F.least(F.greatest(c * SCALE, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))), F.lit(-LIMIT)), F.lit(LIMIT))

    return F.transform(vector, lambda c: held(c).cast("int"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _stack(found: list[np.ndarray]) -> np.ndarray:
    """One triangular factor for several."""
    return np.linalg.qr(np.vstack(found), mode="r")


def _summed(partials: DataFrame) -> list[float]:
    """The sums, place by place, of one short array per task."""
    places = partials.select(F.posexplode("part").alias("place", "value"))
    rows = places.groupBy("place").agg(F.sum("value").alias("value")).collect()
    return [r.value for r in sorted(rows, key=lambda r: r.place)]


def moments(fit: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Number of rows and their sums: exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1, np.int64)
        for batch in batches:
            total[0] += batch.num_rows
            total[1:] += _matrix(batch.column("x"), width).sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], ["part"])

    n, *sums = _summed(fit.select("x").mapInArrow(run, "part array<long>")) or [0] * (width + 1)
    return int(n), np.array(sums, np.int64)


def triangular_factor(fit: DataFrame, centre: np.ndarray) -> np.ndarray:
    """``r`` with ``r' r`` = the centred rows' products, by QR of blocks and of factors."""
    width = len(centre)

    def one(task: int, r: np.ndarray) -> dict[str, pa.Array]:
        return {"task": pa.array([task], pa.int64()), "r": pa.array([r.astype("<f8").tobytes()], pa.binary())}

    def read(rows: pa.ChunkedArray) -> list[np.ndarray]:
        return [np.frombuffer(r.as_py(), "<f8").reshape(-1, width) for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, width))
        for batch in batches:
            rows = _matrix(batch.column("x"), width) - centre
            for start in range(0, len(rows), FOLDED_ROWS):
                r = _stack([r, rows[start : start + FOLDED_ROWS]])
        yield pa.RecordBatch.from_pydict(one(TaskContext.get().partitionId(), r))

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table(one(key[0].as_py(), _stack(read(table.column("r")))))

    rows = fit.select("x")
    found, tasks = rows.mapInArrow(run, "task long, r binary"), rows.rdd.getNumPartitions()
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        found = found.withColumn("task", F.pmod("task", F.lit(tasks))).groupBy("task").applyInArrow(fold, "task long, r binary")
    return _stack([np.frombuffer(bytes(row.r), "<f8").reshape(-1, width) for row in found.select("r").collect()])


def identity_error(fit: DataFrame, centre: np.ndarray, whiten: np.ndarray, n: int) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    width, k = whiten.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = (_matrix(batch.column("x"), width) - centre) @ whiten
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1)], pa.list_(pa.float64()))], ["part"])

    sums = _summed(fit.select("x").mapInArrow(run, "part array<double>"))
    return float(np.abs(np.array(sums).reshape(k, k) / n - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Of every row the sum of ``(n * x - sums) ** 2``: exact."""
    most = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if most * most * x.shape[1] <= LONGEST:
        away = n * x.astype(np.int64) - sums
        return (away * away).sum(axis=1).tolist()
    found = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist())) for row in x.tolist()]
    return [f if f <= LONGEST else None for f in found]


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = 4) -> DataFrame:
    """One row per usable vector and component: see ``RESULT``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(finite("vector"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector").alias("width")).limit(1).collect()
    width = first[0].width if first else 1
    rows = rows.where(F.size("vector") == width).select("vec_id", integers("vector").alias("x"))
    fit = materialize(rows.select("x").distinct(), "fit")
    n, sums = moments(fit, width)
    centre = sums / max(n, 1)
    variances, directions, explained = principal(triangular_factor(fit, centre), max(n, 1), components) if n else (np.zeros(0),) * 3
    k = len(variances)
    if not k:
        return vectors.sparkSession.createDataFrame([], RESULT)
    projected = directions / np.sqrt(variances)
    error = identity_error(fit, centre, projected, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            x = _matrix(batch.column("x"), width)
            each = np.repeat(np.arange(m), k)
            deviation = pa.array(deviations(x, n, sums), pa.int64())
            arrays = [
                batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, np.int64)), deviation.take(pa.array(each)),
                pa.array(((x - centre) @ projected).reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [c.split(" ")[0] for c in RESULT.split(", ")])

    return rows.mapInArrow(run, RESULT)
