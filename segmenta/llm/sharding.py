"""Histogram sort into shards of near equal bytes.

Rows are ordered by (hash of the text, row number), so equal texts lie side by side.  Splitters
are found by repeated histograms: each round counts, over all partitions, the exact bytes in the
candidate ranges around every open splitter (at most ``splitters * 2**PROBE_BITS`` sums reach the
driver), takes a range edge that meets the tolerance, or else opens the one range that holds the
target.  A group of equal texts is thus cut only if no edge of the group meets the tolerance;
then the row number splits it.  With the splitters fixed, rows move once, to be numbered.

Law: ``bytes``.  The slot of a row is its number within (shard, input partition) plus the rows of
that shard in earlier partitions: no task holds a whole shard.

Results for odd input: a null text has no bytes (size 1) and the checksum of the empty text; null
or repeated ids are rows like any other; repeated rows get slots of their own; an empty table gives
no rows; a table with fewer rows than shards leaves shards empty.  Columns other than ``doc_id`` and
``text`` pass through ``assign_shards`` unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmenta.llm.common import materialize

PROBE_BITS = 12
KEY_BITS = 64


def sized(docs: DataFrame) -> DataFrame:
    """The narrow rows that are sorted: id, size, checksum, order key and row number."""
    text = F.col("text")
    return materialize(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sized",
    )


def _range_bytes(rows: DataFrame, column: str, shift: int, inside: Column) -> dict[int, int]:
    """Exact bytes by candidate range: at most 2**PROBE_BITS ranges per open splitter."""
    prefix = F.shiftright(column, shift).alias("prefix")
    return {r.prefix: r.bytes for r in rows.where(inside).groupBy(prefix).agg(F.sum("size").alias("bytes")).collect()}


def _refine(rows: DataFrame, column: str, opened: dict[int, tuple], tolerance: float) -> tuple[dict, dict]:
    """``opened``: splitter -> (bytes wanted, bytes below, the rows to look at).  Returns the
    splitters whose edge on ``column`` meets the tolerance, and for the others the value of
    ``column`` that holds the wanted byte, with the bytes below it."""
    settled: dict[int, int] = {}
    state = {s: (want, below, None, rest) for s, (want, below, rest) in opened.items()}
    previous, shift = KEY_BITS, KEY_BITS
    while shift > 0 and state:
        previous, shift = shift, max(0, shift - PROBE_BITS)
        by_rest: dict = {}
        for s, (_, _, prefix, rest) in state.items():
            by_rest.setdefault(rest, {}).setdefault(prefix, []).append(s)
        nxt = {}
        for rest, by_prefix in by_rest.items():
            inside = F.lit(True) if rest is None else (F.col(rest[0]) == F.lit(rest[1]))
            if None not in by_prefix:
                inside = inside & F.shiftright(column, previous).isin(list(by_prefix))
            sums = _range_bytes(rows, column, shift, inside)
            for prefix, splitters in by_prefix.items():
                own = sorted(p for p in sums if prefix is None or p >> (previous - shift) == prefix)
                for s in splitters:
                    want, below = state[s][:2]
                    for p in own:
                        if below + sums[p] > want:
                            break
                        below += sums[p]
                    if want - below <= tolerance:
                        settled[s] = p << shift
                    elif below + sums[p] - want <= tolerance:
                        settled[s] = (p + 1) << shift
                    else:
                        nxt[s] = (want, below, p, rest)
        state = nxt
    return settled, {s: (want, below, p) for s, (want, below, p, _) in state.items()}


def find_splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """The first (key, row) of every shard but the first, as near to equal bytes as rows allow."""
    total = rows.agg(F.sum("size").alias("total")).collect()[0].total
    if not total:
        return []
    slack = tolerance * total / shards
    opened = {s: (total * s / shards, 0, None) for s in range(1, shards)}
    at_key, inside_key = _refine(rows, "key", opened, slack)
    found = {s: (key, 0) for s, key in at_key.items()}
    again = {s: (want, below, ("key", key)) for s, (want, below, key) in inside_key.items()}
    at_row, single = _refine(rows, "row", again, slack)
    for s, row in at_row.items():
        found[s] = (again[s][2][1], row)
    for s, (_, _, row) in single.items():  # one row is larger than the tolerance
        found[s] = (again[s][2][1], row)
    return [found[s] for s in sorted(found)]


def _past(splitter: tuple[int, int]) -> Column:
    key, row = splitter
    if key >= 1 << (KEY_BITS - 1):  # an edge above the largest key
        return F.lit(False)
    return (F.col("key") > F.lit(key)) | ((F.col("key") == F.lit(key)) & (F.col("row") >= F.lit(row)))


def assign_shards(docs: DataFrame, shards: int = 8, tolerance: float = 0.001) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    ``tolerance`` is the share of a shard by which a splitter may miss its byte target."""
    rows = sized(docs)
    splitters = find_splitters(rows, shards, tolerance)
    shard = F.lit(0)
    for splitter in splitters:
        shard = shard + F.when(_past(splitter), 1).otherwise(0)
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("part", F.shiftright("row", 33))

    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    return (
        placed.withColumn("nth", within)
        .join(before, ["shard", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
