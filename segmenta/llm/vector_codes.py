"""Compression of vectors to short codes: k-means over parts, on anchors-hierarchy metric trees.

Vectors become integers, ``floor(SCALE * x)``, and are cut into consecutive parts; each part has a
codebook of its own.  All decisions are made on integers, so results do not depend on order,
partitioning or rounding.

Rows are gathered into blocks of ``BLOCK`` wherever they lie.  For every part of a block a metric
tree is built once, middle-out: about ``sqrt(n)`` anchors are set, each the point farthest from the
anchor that owns it, and each steals the points that are nearer to it (points nearer to their owner
than half the distance of the two anchors need no look).  The points of an anchor get a tree of
their own in the same way; upwards, the two balls whose union is smallest are merged until one is
left.  Every ball caches number, sum, centre and radius of its points.

In a round each tree is walked from its root, with the list of all codebook entries.  In a ball,
an entry goes from the list when the entry nearest to the centre is nearer to *every* point of the
ball; children inherit the shortened list.  A ball whose list holds one entry is wholly owned: its
cached sum and count are added without looking at a point.  Only at leaves points are compared, and
only with the entries that are left.

Trees are written once and read in every round; codebooks (``parts * entries`` rows) travel with
the tasks, and sums come back as one small row per task, added up in groups of ``FAN`` tasks.

Results for odd input: rows whose vector is null, or holds null or non-finite components, are
dropped; so are vectors without components and those of another length than the vector of the
smallest ``vec_id``; lengths that ``parts`` does not divide are cut into parts as equal as possible
(empty ones for fewer components than parts).  Components beyond ``+-LIMIT`` after scaling count as
that limit.  Null ids sort last, rows with one id by their vectors; repeated rows are rows like any
other.  Fewer rows than entries make a smaller codebook; an empty table gives no rows.  Equal
entries: the lower index takes the points.  Sums of errors beyond a long are null.  Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import materialize

SCALE = 1024
#: Scaled components are held to this, so that squared distances of any part fit a long.
LIMIT = 1 << 24
BLOCK = 4096
#: A ball of at most this many points is a leaf.
LEAF = 32
#: Rows of sums that are added in one task.
FAN = 64
#: Up to here sums of products are exact as doubles.
EXACT = float(1 << 53)


# --- metric trees -----------------------------------------------------------------------


@dataclass
class Ball:
    """A node while its tree is built: its points, their centre and the greatest distance from it."""

    points: np.ndarray
    centre: np.ndarray
    radius: float
    children: tuple[Ball, Ball] | None = None


def _ball(values: np.ndarray, points: np.ndarray, children: tuple[Ball, Ball] | None = None) -> Ball:
    own = values[points]
    centre = own.mean(axis=0)
    away = own - centre
    return Ball(points, centre, float(np.sqrt(np.einsum("ij,ij->i", away, away).max())), children)


def anchors(values: np.ndarray, points: np.ndarray) -> list[np.ndarray]:
    """The points of each of about ``sqrt(n)`` anchors; one list if all points are equal."""

    def distances(chosen: np.ndarray, anchor: int) -> np.ndarray:
        away = values[chosen] - values[anchor]
        return np.sqrt(np.einsum("ij,ij->i", away, away))

    wanted = int(np.ceil(np.sqrt(len(points))))
    set_at = [int(points[0])]
    owner = np.zeros(len(points), np.int64)
    far = distances(points, set_at[0])
    while len(set_at) < wanted:
        farthest = int(far.argmax())
        if far[farthest] == 0:  # every point is an anchor's equal
            break
        new = int(points[farthest])
        between = distances(np.array(set_at), new)
        asked = np.flatnonzero(far > between[owner] / 2)
        near = distances(points[asked], new)
        stolen = near < far[asked]
        taken = asked[stolen]
        owner[taken], far[taken] = len(set_at), near[stolen]
        set_at.append(new)
    ordered = np.argsort(owner, kind="stable")
    found = np.split(points[ordered], np.cumsum(np.bincount(owner, minlength=len(set_at)))[:-1])
    return [own for own in found if len(own)]


def grow(values: np.ndarray, points: np.ndarray) -> Ball:
    """The tree of some points."""
    if len(points) <= LEAF:
        return _ball(values, points)
    owned = anchors(values, points)
    if len(owned) == 1:
        return _ball(values, points)
    balls = [grow(values, own) for own in owned]
    centres = np.array([b.centre for b in balls])
    radii = np.array([b.radius for b in balls])
    sizes = np.array([float(len(b.points)) for b in balls])

    def joint(i: int) -> np.ndarray:
        """Bounds of the radii of ball ``i`` united with every other one."""
        total = sizes + sizes[i]
        away = np.sqrt(((centres - centres[i]) ** 2).sum(axis=1))
        out = np.maximum(away * sizes / total + radii[i], away * sizes[i] / total + radii)
        out[i] = np.inf
        return out

    cost = np.array([joint(i) for i in range(len(balls))])
    for _ in range(len(balls) - 1):
        i, j = divmod(int(cost.argmin()), len(balls))
        ball = _ball(values, np.concatenate([balls[i].points, balls[j].points]), (balls[i], balls[j]))
        balls[i] = ball
        centres[i], radii[i], sizes[i] = ball.centre, ball.radius, len(ball.points)
        sizes[j], radii[j] = 1.0, np.inf  # gone
        cost[j, :] = cost[:, j] = np.inf
        new = joint(i)
        new[~np.isfinite(radii)] = np.inf
        cost[i, :] = cost[:, i] = new
    return ball


@dataclass
class Tree:
    """A finished tree: balls level by level, each a range of ``points``."""

    order: np.ndarray  # the block's row of every point
    points: np.ndarray  # the points' integers
    first: np.ndarray
    last: np.ndarray
    child: np.ndarray  # of two columns; -1 for leaves
    sums: np.ndarray
    centres: np.ndarray
    radii: np.ndarray


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same integers, in two bytes each where they fit."""
    small = not values.size or (values.min() >= -(1 << 15) and values.max() < 1 << 15)
    return values.astype(np.int16 if small else np.int32)


def plant(values: np.ndarray) -> Tree:
    """The tree of all rows of a block's part (integers)."""
    root = grow(values.astype(np.float64), np.arange(len(values)))
    balls, children = [root], []
    for ball in balls:  # grows while it is read
        if ball.children:
            children.append((len(balls), len(balls) + 1))
            balls.extend(ball.children)
        else:
            children.append((-1, -1))
    sizes = np.array([len(b.points) for b in balls])
    first = np.zeros(len(balls), np.int64)
    for i, (left, right) in enumerate(children):  # parents come before their children
        if left >= 0:
            first[left], first[right] = first[i], first[i] + sizes[left]
    ordered = values[root.points]
    before = np.concatenate([np.zeros((1, values.shape[1]), np.int64), np.cumsum(ordered, axis=0, dtype=np.int64)])
    return Tree(
        root.points.astype(np.int32), _narrow(ordered), first, first + sizes, np.array(children),
        before[first + sizes] - before[first], np.array([b.centre for b in balls]), np.array([b.radius for b in balls]),
    )


# --- walking them -------------------------------------------------------------------------


class Codebook:
    """The entries of one part (integers), and what a walk needs of them."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.real = entries.astype(np.float64)
        self.squares = (entries * entries).sum(axis=1)
        away = self.real[:, None, :] - self.real[None, :, :]
        self.between = np.sqrt((away * away).sum(axis=2))
        #: Of equal entries only the first can take a point.
        self.listed = np.sort(np.unique(entries, axis=0, return_index=True)[1])


def _nearest(points: np.ndarray, book: Codebook, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each point the nearest listed entry (ascending, so the lowest of equally near ones) and
    its squared distance: exact."""
    points = points.astype(np.int64)
    entries, squares = book.entries[listed], book.squares[listed]
    own = (points * points).sum(axis=1)
    if 2.0 * max(own.max(initial=0), squares.max(initial=0)) < EXACT / 2:
        products = (points.astype(np.float64) @ book.real[listed].T).astype(np.int64)
    else:
        products = points @ entries.T
    scores = squares - 2 * products
    at = scores.argmin(axis=1)
    return listed[at], own + scores[np.arange(len(points)), at]


@dataclass
class Assigned:
    """What a walk found: per entry the sum and number of its points, and, if asked, the entry and
    the squared distance of every row of the block."""

    sums: np.ndarray
    counts: np.ndarray
    entry: np.ndarray
    error: np.ndarray
    compared: int  # distances computed at leaves


def walk(tree: Tree, book: Codebook, each_row: bool = False) -> Assigned:
    m, n = len(book.entries), len(tree.points)
    out = Assigned(np.zeros_like(book.entries), np.zeros(m, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), 0)
    at = np.zeros(1, np.int64)
    columns = book.listed
    lists = np.ones((1, len(columns)), bool)  # of each ball the entries that may own a point of it
    while len(at):
        used = np.flatnonzero(lists.any(axis=0))
        columns, lists = columns[used], lists[:, used]
        centres, real = tree.centres[at], book.real[columns]
        own, squares = (centres * centres).sum(axis=1), (real * real).sum(axis=1)
        away = own[:, None] + squares - 2 * centres @ real.T
        away[~lists] = np.inf
        best = away.argmin(axis=1)
        least = away[np.arange(len(at)), best]
        # A difference of squared distances changes by at most twice the radius times the entries'
        # distance within the ball; the slack covers rounding.
        slack = 1e-9 * (own[:, None] + squares + 1)
        reach = 2 * (1 + 1e-9) * tree.radii[at][:, None] * book.between[columns[best]][:, columns]
        lists &= away - least[:, None] <= reach + slack
        owned = lists.sum(axis=1) == 1
        mine, entries = at[owned], columns[best[owned]]
        np.add.at(out.sums, entries, tree.sums[mine])
        np.add.at(out.counts, entries, tree.last[mine] - tree.first[mine])
        if each_row:
            for ball, entry in zip(mine, entries):
                first, last = tree.first[ball], tree.last[ball]
                out.entry[first:last] = entry
                away_from = tree.points[first:last].astype(np.int64) - book.entries[entry]
                out.error[first:last] = (away_from * away_from).sum(axis=1)
        leaf = ~owned & (tree.child[at, 0] < 0)
        for k in np.flatnonzero(leaf):
            first, last = tree.first[at[k]], tree.last[at[k]]
            listed = columns[lists[k]]
            points = tree.points[first:last]
            entry, error = _nearest(points, book, listed)
            out.compared += len(points) * len(listed)
            np.add.at(out.sums, entry, points)
            np.add.at(out.counts, entry, 1)
            if each_row:
                out.entry[first:last], out.error[first:last] = entry, error
        inner = ~owned & ~leaf
        at = tree.child[at[inner]].reshape(-1)
        lists = np.repeat(lists[inner], 2, axis=0)
    if each_row:
        back = np.argsort(tree.order)
        out.entry, out.error = out.entry[back], out.error[back]
    return out


# --- Spark ----------------------------------------------------------------------------------


def finite(vector: str) -> Column:
    """Whether a vector is there and has only finite components, at least one."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad


def scaled(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(vectors * SCALE), -LIMIT, LIMIT).astype(np.int64)


def usable(vectors: DataFrame, vector: str, label: str) -> DataFrame:
    """``vec_id, label, vector``: the rows that count, labels as text."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    return rows.where(finite("vector"))


def first_rows(rows: DataFrame, n: int) -> list[list[float]]:
    """The vectors of the ``n`` smallest ids (a bounded top-k)."""
    top = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(n).select("vec_id", "vector")
    return [r.vector for r in top.collect()]


def part_bounds(length: int, parts: int) -> list[int]:
    return [length * i // parts for i in range(parts + 1)]


FOREST = "ids array<long>, labels array<string>, trees binary"


def plant_forest(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """One row per block of rows: ids, labels, and the trees of all parts."""
    bounds = part_bounds(length, parts)

    def made(ids: pa.Array, labels: pa.Array, values: np.ndarray) -> pa.RecordBatch:
        trees = [plant(values[:, a:b]) for a, b in zip(bounds, bounds[1:])]
        arrays = [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([labels.to_pylist()], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([pickle.dumps(trees)], pa.binary())], ["ids", "labels", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            vectors = table.column("vector").combine_chunks()
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            return made(
                table.column("vec_id").combine_chunks(), table.column("label").combine_chunks(),
                scaled(flat.reshape(len(vectors), length)),
            )

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == BLOCK:
                    yield block()
                    held, n = [], 0
        if n:
            yield block()

    return rows.select("vec_id", "label", "vector").mapInArrow(run, FOREST)


def _totals(forest: DataFrame, books: list[Codebook]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per part the sums and counts of all entries, over the whole forest."""
    shapes = [book.entries.shape for book in books]

    def packed(found: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
        return np.concatenate([a.reshape(-1) for pair in found for a in pair]).astype("<i8").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = [(np.zeros(s, np.int64), np.zeros(s[0], np.int64)) for s in shapes]
        for batch in batches:
            for trees in batch.column("trees"):
                for (sums, counts), tree, book in zip(total, pickle.loads(trees.as_py()), books):
                    found = walk(tree, book)
                    sums += found.sums
                    counts += found.counts
        names = ["task", "sums"]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([packed(total)], pa.binary())], names)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(row.as_py(), "<i8") for row in table.column("sums"))
        return pa.table({"task": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    read = forest.select("trees")
    found, tasks = read.mapInArrow(run, "task long, sums binary"), read.rdd.getNumPartitions()
    while tasks > FAN:  # in groups, so that neither a task nor the driver adds them all
        tasks = -(-tasks // FAN)
        found = found.withColumn("task", F.pmod("task", F.lit(tasks))).groupBy("task").applyInArrow(add, "task long, sums binary")
    total = sum(np.frombuffer(bytes(row.sums), "<i8") for row in found.select("sums").collect())
    out, at = [], 0
    for m, k in shapes:
        out.append((total[at : at + m * k].reshape(m, k), total[at + m * k : at + m * k + m]))
        at += m * k + m
    return out


def fit(forest: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The codebooks after some rounds; entries that own no part stay."""
    for _ in range(rounds):
        totals = _totals(forest, [Codebook(b) for b in books])
        books = [
            np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], book)
            for book, (sums, counts) in zip(books, totals)
        ]
    return books


def digest(books: Iterable[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.reshape(-1).tolist()).encode()).hexdigest()


def encode(forest: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``vec_id, label, code, error`` of every row of the forest."""
    digits = max(2, *(len(f"{max(len(b) - 1, 0):x}") for b in books))
    made = [Codebook(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, trees in zip(*(batch.column(c) for c in ("ids", "labels", "trees"))):
                found = [walk(tree, book, each_row=True) for tree, book in zip(pickle.loads(trees.as_py()), made)]
                codes = ["".join(f"{e:0{digits}x}" for e in row) for row in zip(*(f.entry.tolist() for f in found))]
                error = sum(f.error for f in found)
                arrays = [ids.values, labels.values, pa.array(codes, pa.string()), pa.array(error, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "label", "code", "error"])

    return forest.mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(
    vectors: DataFrame, vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable row: codes after
    ``rounds`` rounds from the vectors of the smallest ids, squared errors, and their sum over the
    rows of the same label."""
    rows = usable(vectors, vector, label)
    seeds = first_rows(rows, entries)
    length = len(seeds[0]) if seeds else parts
    if any(len(s) != length for s in seeds):
        seeds = first_rows(rows.where(F.size("vector") == length), entries)
    start = scaled(np.array(seeds, np.float64).reshape(len(seeds), length))
    bounds = part_bounds(length, parts)
    books = [start[:, a:b] for a, b in zip(bounds, bounds[1:])]
    forest = materialize(plant_forest(rows.where(F.size("vector") == length), length, parts), "forest")
    if seeds:
        books = fit(forest, books, rounds)
    codes = materialize(encode(forest, books), "codes")
    # One narrow row per label, written, so that its true size decides between a broadcast and a
    # join whose hot labels can be split.
    key = F.coalesce("label", F.lit("")).alias("key"), F.col("label").isNull().alias("none")
    errors = materialize(codes.groupBy(*key).agg(F.try_sum("error").alias("label_error")), "label-errors")
    return codes.select("*", *key).join(errors, ["key", "none"]).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


def oracle_sql(parts: int = 4, entries: int = 256, rounds: int = 4, length: int = 64) -> str:
    """DuckDB SQL of :func:`compress` over vectors of ``length`` components: every part meets every
    entry in every round."""
    width = length // parts
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""taken{r} AS MATERIALIZED (
  SELECT row_id, p, min(CAST(list_inner_product(w, w) + list_inner_product(b, b) - 2 * list_inner_product(w, b) AS HUGEINT)
                        * {entries} + e) AS best
  FROM part JOIN book{r} USING (p) GROUP BY row_id, p)""")
        if r == rounds:
            break
        steps.append(f"""mean{r} AS (
  SELECT p, e, list(m ORDER BY i) AS b FROM (
    SELECT p, CAST(best % {entries} AS BIGINT) AS e, i, floor(sum(w[i]) / count(*)) AS m
    FROM taken{r} JOIN part USING (row_id, p), range(1, {width + 1}) AS positions(i) GROUP BY ALL) GROUP BY p, e),
book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{r}.b, book{r}.b) AS b FROM book{r} LEFT JOIN mean{r} USING (p, e))""")
    return f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row_id,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
  SELECT row_id, p, v[{width} * p + 1:{width} * (p + 1)] AS w FROM kept, range({parts}) AS parts(p)),
book0 AS (SELECT p, row_id - 1 AS e, w AS b FROM part WHERE row_id <= {entries}),
{', '.join(steps)},
coded AS (
  SELECT row_id, string_agg(printf('%02x', CAST(best % {entries} AS INTEGER)), '' ORDER BY p) AS code,
         CAST(sum(best // {entries}) AS BIGINT) AS error
  FROM taken{rounds} GROUP BY row_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(CAST(b[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i))
        FROM book{rounds}, range(1, {width + 1}) AS positions(i)) AS codebooks_sha256
FROM kept JOIN coded USING (row_id)"""
