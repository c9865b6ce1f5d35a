"""Exact continuous percentiles (``PERCENTILE_CONT``) without a task that holds a whole column.

Spark's built-in ``percentile`` is exact but merges a value->count map of the column in one final
task, and money amounts have an unbounded number of distinct values.  Here one path serves every
size: narrow, then rank.

1. Narrowing.  ``percentile_approx`` (a bounded, mergeable sketch) gives ``GRID`` steps over the
   values of a column; the steps around the wanted ranks, floor and ceil of p*(n-1), become the
   target's bracket, about a hundredth of the column.
2. Ranking.  Rows inside a bracket are grouped to (value, count), rows below it to one NULL-valued
   count that sorts first; a running sum gives every value's rank range.  Brackets that may hold
   more than ``window_values`` values are sorted by ranges, and only the ranges that hold a wanted
   rank get a running sum.  A bracket that misses its ranks starts anew with a wider margin, so the
   answer stays exact.

So the measures are read twice, whatever their number.

Only bounded results reach the driver: the steps of each bracket and at most two values per target.
The result is a one-row DataFrame; callers read its values back as literals, so downstream plans do
not carry the quantile computation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmenta.functions.joins import settled
from segmenta.session import ensure_checkpoint_dir

DEFAULT_ACCURACY = 10_000
GRID = 512
WINDOW_VALUES = 100_000  # values that one ranking window is expected to hold at most


def exact_percentiles(
    df: DataFrame,
    measures: dict[str, Column | str],
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    names: dict[tuple[str, float], str] | None = None,
    accuracy: int = DEFAULT_ACCURACY,
    window_values: int = WINDOW_VALUES,
    counts: dict[str, int] | None = None,
) -> DataFrame:
    """One row with ``PERCENTILE_CONT(p)`` of every measure, as doubles.

    ``measures`` maps a measure name to a column of ``df``; NULLs are ignored as
    in SQL.  Output columns are ``names[(measure, p)]`` or ``f"{measure}_p{p}"``.
    A measure without non-NULL values gives NULLs.  ``counts`` (non-NULL values
    per measure), when the caller already has them, saves the counting job.
    """
    spark = df.sparkSession
    names = names or {}
    measure_names = list(measures)
    probs = [float(p) for p in probs]

    long = (
        df.select(
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(i).alias("m"),
                            (F.col(c) if isinstance(c, str) else c).cast("double").alias("v"),
                        )
                        for i, c in enumerate(measures.values())
                    ]
                )
            ).alias("x")
        )
        .select("x.m", "x.v")
        .where(F.col("v").isNotNull())
    )

    def result(values: dict[tuple[int, int], float | None]) -> DataFrame:
        # An inline VALUES row is a local relation: reading it back needs no
        # Spark job.  repr() of a finite float round-trips exactly through the D suffix.
        cells, aliases = [], []
        for mi, mname in enumerate(measure_names):
            for pi, p in enumerate(probs):
                v = values.get((mi, pi))
                finite = v is not None and math.isfinite(v)
                cells.append(f"{float(v)!r}D" if finite else f"CAST({'NULL' if v is None else repr(str(v))} AS DOUBLE)")
                aliases.append("`" + names.get((mname, p), f"{mname}_p{p}").replace("`", "``") + "`")
        return spark.sql(f"SELECT * FROM VALUES ({', '.join(cells)}) AS t({', '.join(aliases)})")

    # Non-NULL values per measure (one partial count per task).
    if counts is not None:
        counts = {mi: counts[name] for mi, name in enumerate(measure_names)}
    else:
        counts = {r["m"]: r["n"] for r in long.groupBy("m").agg(F.count(F.lit(1)).alias("n")).collect()}

    # Spans (measure, lo, hi) with their targets: [margin, m, p index, r_lo, r_hi, frac].
    margin = 1 + 2 * GRID // accuracy
    spans: dict[tuple, list] = {}
    for mi in range(len(measure_names)):
        for pi, p in enumerate(probs if counts.get(mi, 0) else ()):
            h = p * (counts[mi] - 1)
            target = [margin, mi, pi, math.floor(h), math.ceil(h), h - math.floor(h)]
            spans.setdefault((mi, None, None), []).append(target)

    values: dict[tuple[int, int], float | None] = {}
    while spans:
        keys = list(spans)
        steps = _steps_in_spans(long, keys, accuracy)
        again: dict[tuple, list] = {}
        brackets, wide_brackets, missed = [], [], []
        for b, key in enumerate(keys):
            below, inside, grid = steps.get(b, (0, 0, None))
            for target in spans[key]:
                wide, mi, _pi, r_lo, r_hi, _frac = target
                if not below <= r_lo <= r_hi < below + inside:
                    missed.append(target)
                    continue
                scale = GRID / max(1, inside - 1)
                first = max(0, math.floor((r_lo - below) * scale) - wide)
                last = min(GRID, math.ceil((r_hi - below) * scale) + wide)
                span = (mi, grid[first], grid[last])
                small = (last - first + 1) / GRID * inside <= window_values
                (brackets if small else wide_brackets).append((*span, [target]))
        picks = _rank_in_brackets(long, brackets) if brackets else {}
        if wide_brackets:
            # Without a checkpoint folder ranges could not be kept from one job to the next.
            rank = _rank_in_ranges if ensure_checkpoint_dir(spark) else _rank_in_brackets
            picks |= rank(long, wide_brackets)
        for _mi, _lo, _hi, targets in brackets + wide_brackets:
            for target in targets:
                _wide, mi, pi, r_lo, r_hi, frac = target
                a, b = picks.get((mi, r_lo)), picks.get((mi, r_hi))
                if a is None or b is None:
                    missed.append(target)
                else:
                    values[(mi, pi)] = a if a == b or not frac else a + frac * (b - a)
        for target in missed:
            again.setdefault((target[1], None, None), []).append([4 * target[0], *target[1:]])
        spans = again
    return result(values)


def _tagged(long: DataFrame, spans: list) -> DataFrame:
    """``b, v`` for every span ``b`` that a value lies in; ``v`` is NULL below the span."""
    m, v = F.col("m"), F.col("v")
    tags = []
    for b, (mi, lo, hi) in enumerate(spans):
        inside = F.struct(F.lit(b).alias("b"), v.alias("v"))
        below = F.struct(F.lit(b).alias("b"), F.lit(None).cast("double").alias("v"))
        if lo is None:
            tags.append(F.when(m == mi, inside))
        else:
            tags.append(F.when((m == mi) & (v < lo), below).when((m == mi) & (v <= hi), inside))
    return long.select(F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())).alias("x")).select("x.b", "x.v")


def _steps_in_spans(long: DataFrame, spans: list, accuracy: int) -> dict[int, tuple]:
    """{span: (rows below, rows inside, GRID + 1 steps over the values inside)}."""
    grid = [k / GRID for k in range(GRID + 1)]
    rows = _tagged(long, spans).groupBy("b").agg(
        F.count_if(F.col("v").isNull()).alias("below"), F.count("v").alias("inside"),
        F.percentile_approx("v", grid, accuracy).alias("steps"),
    )
    return {r["b"]: (r["below"], r["inside"], r["steps"]) for r in rows.collect()}


def _rank_in_ranges(long: DataFrame, brackets: list) -> dict[tuple[int, int], float]:
    """:func:`_rank_in_brackets` for brackets of any number of values: the (value, count) pairs are
    sorted by ranges, one sum per bracket and range tells which ranges hold the wanted ranks."""
    hist = _tagged(long, [bracket[:3] for bracket in brackets]).groupBy("b", "v").agg(F.count(F.lit(1)).alias("c"))
    ranges = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("b").asc(), F.col("v").asc_nulls_first()]
    # Settled: the measures are not read again, and ranges, drawn by sampling, stay as they are.
    ranged = settled(hist.repartitionByRange(ranges, *order)).withColumn("r", F.spark_partition_id())
    sums = ranged.groupBy("b", "r").agg(F.sum("c").alias("c")).collect()
    out: dict[tuple[int, int], float] = {}
    starts: dict[tuple[int, int], int] = {}
    wanted: dict[tuple[int, int], list[int]] = {}
    for b, (_mi, _lo, _hi, targets) in enumerate(brackets):
        ranks = {rank for target in targets for rank in target[3:5]}
        before = 0
        for r, c in sorted((s["r"], s["c"]) for s in sums if s["b"] == b):
            here = [rank for rank in ranks if before <= rank < before + c]
            if here:
                starts[b, r], wanted[b, r] = before, here
            before += c
    if not wanted:
        return out
    at = F.struct("b", "r")
    cells = [(F.struct(F.lit(b).alias("b"), F.lit(r).alias("r")), F.lit(s).cast("bigint")) for (b, r), s in starts.items()]
    start = F.element_at(F.create_map(*[x for cell in cells for x in cell]), at)
    w = Window.partitionBy("b", "r").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    held = ranged.where(at.isin([cell[0] for cell in cells]))
    placed = held.select("b", "r", "v", (start + F.sum("c").over(w)).alias("end"), "c")
    lists = F.create_map(*[
        x for (key, _), ranks in zip(cells, wanted.values()) for x in (key, F.array(*[F.lit(k).cast("bigint") for k in ranks]))
    ])
    hit = F.exists(F.element_at(lists, at), lambda k: (F.col("end") - F.col("c") <= k) & (k < F.col("end")))
    for row in placed.where(F.col("v").isNotNull() & hit).collect():
        for rank in wanted[row["b"], row["r"]]:
            if row["end"] - row["c"] <= rank < row["end"]:
                out[brackets[row["b"]][0], rank] = row["v"]
    return out


def _rank_in_brackets(long: DataFrame, brackets: list) -> dict[tuple[int, int], float]:
    """{(measure, rank): value} for the ranks each bracket was asked for and holds.

    A bracket is (measure, lo, hi, targets).  Rows below a bracket collapse into one NULL-valued
    count that sorts first, so a running sum over the bracket's (value, count) rows gives true ranks.
    """
    hist = _tagged(long, [bracket[:3] for bracket in brackets]).groupBy("b", "v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("b").orderBy(F.col("v").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranks_of = {b: sorted({r for tg in tgts for r in (tg[3], tg[4])}) for b, (_m, _l, _h, tgts) in enumerate(brackets)}
    wanted = F.create_map(
        *[x for b, rs in ranks_of.items() for x in (F.lit(b), F.array(*[F.lit(r).cast("bigint") for r in rs]))]
    )
    ranked = hist.select("b", "v", (F.sum("c").over(w) - F.col("c")).alias("start"), F.sum("c").over(w).alias("end"))
    hit = F.exists(F.element_at(wanted, F.col("b")), lambda r: (F.col("start") <= r) & (r < F.col("end")))
    rows = ranked.where(F.col("v").isNotNull() & hit).collect()
    out: dict[tuple[int, int], float] = {}
    for r in rows:
        mi = brackets[r["b"]][0]
        for rank in ranks_of[r["b"]]:
            if r["start"] <= rank < r["end"]:
                out[(mi, rank)] = r["v"]
    return out
