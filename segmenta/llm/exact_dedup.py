"""Exact deduplication of an incoming batch against immutable snapshots.

A snapshot is built once and never changed: its distinct texts lie in hash buckets by
SHA-256 (a bucketed table), and every bucket has static binary-fuse filters over its digests,
as many as keep each of bounded size.  A batch is deduplicated in four steps:

1. Duplicates inside the batch are grouped on their own: one aggregate by digest, combined
   on the map side, so a text that holds a third of all rows moves once per task.
2. The distinct digests of the batch are screened by the snapshot's filters.  A negative is
   certainly new; no text of the snapshot is read for it.
3. Positives meet the exact buckets in hash joins (all tables have the same buckets: only the
   digests of the positives are exchanged, and no text is sorted but theirs) and the bytes are
   compared; false positives of the filter fall out here.
4. Rows get their group through a narrow join on the digest; AQE splits a hot digest.

Bytes are compared in step 1 as well: a digest whose smallest and largest text differ holds
several texts.  Such digests are grouped by digest and text.  A group is stored with one text
and with the outcome of that comparison, so that no later step reads a text twice.

Results for odd input: a null text counts as empty; a null ``doc_id`` loses against any
other (it stays only if its group has no id); repeated rows belong to the same group, and
all rows that carry the id that stays are marked as kept; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import materialize, new_path, remove, shuffle_partitions, text_or_empty

#: About how many digests one filter holds, and one filter task screens: buckets are salted beyond.
FILTER_ROWS = 200_000
SCREEN_ROWS = 200_000
U64 = np.uint64


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


# --- binary fuse filter ---------------------------------------------------------------


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of (key + seed)."""
    h = keys.astype(U64) + U64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> U64(shift))) * U64(factor)
    return h ^ (h >> U64(33))


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots per hash, in three consecutive segments."""
    first = ((h >> U64(32)) * U64(segments * segment)) >> U64(32)
    mask = U64(segment - 1)
    second = (first + U64(segment)) ^ ((h >> U64(18)) & mask)
    third = (first + U64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third], axis=1).astype(np.int64)


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> U64(29))) & U64(0xFF)).astype(np.uint8)


@dataclass(frozen=True)
class FuseFilter:
    """Static set of 64-bit keys: no false negatives, about 1 in 256 false positives."""

    seed: int
    segment: int
    segments: int
    cells: bytes

    @staticmethod
    def build(keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(U64))
        n = len(keys)
        segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
        for attempt in range(1, 101):
            segments = max(1, math.ceil(n * factor / segment) - 2)
            h = _mix(keys, attempt * 0x9E3779B97F4A7C15 % (1 << 64))
            slots = _slots(h, segment, segments)
            order = _peel(slots, (segments + 2) * segment)
            if order is not None:
                cells = _assign(order, slots, _fingerprint(h), (segments + 2) * segment)
                return FuseFilter(attempt, segment, segments, cells)
            factor *= 1.02
        raise RuntimeError("no binary-fuse filter found")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(keys, self.seed * 0x9E3779B97F4A7C15 % (1 << 64))
        cells = np.frombuffer(self.cells, np.uint8)
        found = cells[_slots(h, self.segment, self.segments)]
        return (found[:, 0] ^ found[:, 1] ^ found[:, 2]) == _fingerprint(h)


def _peel(slots: np.ndarray, size: int) -> list[tuple[int, int]] | None:
    """(key, its own slot) in an order in which each slot is free of later keys, or None."""
    degree = np.bincount(slots.ravel(), minlength=size)
    members = np.zeros(size, np.int64)  # XOR of the keys that touch a slot
    for column in range(3):
        np.bitwise_xor.at(members, slots[:, column], np.arange(len(slots)))
    degree, members, triples = degree.tolist(), members.tolist(), slots.tolist()
    alone = [s for s, d in enumerate(degree) if d == 1]
    order = []
    while alone:
        slot = alone.pop()
        if degree[slot] != 1:
            continue
        key = members[slot]
        order.append((key, slot))
        for other in triples[key]:
            degree[other] -= 1
            members[other] ^= key
            if degree[other] == 1:
                alone.append(other)
    return order if len(order) == len(triples) else None


def _assign(order: list[tuple[int, int]], slots: np.ndarray, prints: np.ndarray, size: int) -> bytes:
    cells, prints, triples = bytearray(size), prints.tolist(), slots.tolist()
    for key, slot in reversed(order):
        a, b, c = triples[key]
        cells[slot] = 0
        cells[slot] = prints[key] ^ cells[a] ^ cells[b] ^ cells[c]
    return bytes(cells)


# --- groups and snapshots -------------------------------------------------------------


@dataclass(frozen=True)
class Snapshot:
    """``groups``: one row per digest, bucketed; ``filters``: one row per bucket and salt, of about
    ``FILTER_ROWS`` digests whatever the size of the snapshot.  ``drop`` frees all of it."""

    groups: DataFrame
    filters: DataFrame
    buckets: int
    salts: int
    stored: tuple[Stored, ...] = ()

    def drop(self) -> None:
        for stored in self.stored:
            stored.drop()


@dataclass(frozen=True)
class Stored:
    """A table or folder in the shared folder, to be dropped by its maker."""

    spark: SparkSession
    path: str
    table: str | None = None

    def drop(self) -> None:
        if self.table:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove(self.spark, self.path)


def _stored(df: DataFrame, label: str) -> tuple[DataFrame, Stored]:
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), Stored(spark, path)


def _keyed(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = text_or_empty()
    return docs.select("doc_id", text.alias("text"), digest(text).alias("digest"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.hash("digest"), F.lit(buckets))  # the bucket of a bucketed table


def _salt(salts: int) -> Column:
    return F.pmod(F.shiftright("key", 40), F.lit(salts)).cast("int")


def text_groups(docs: DataFrame, digest: Callable[[Column], Column], buckets: int) -> tuple[DataFrame, Stored]:
    """One row per digest with its row count, largest id, smallest text and ``one_text``: whether
    the digest holds no other text.  Stored in buckets by digest."""
    grouped = (
        _keyed(docs, digest)
        .groupBy("digest")
        .agg(
            F.max("doc_id").alias("keep_id"),
            F.count(F.lit(1)).alias("group_size"),
            F.min("text").alias("low"),
            F.max("text").alias("high"),
        )
        .withColumn("one_text", F.col("low") == F.col("high"))
        .drop("high")
    )
    spark, name = docs.sparkSession, f"segmenta_groups_{uuid.uuid4().hex}"
    path = new_path(spark, "text-groups")
    grouped.write.option("path", path).bucketBy(buckets, "digest").saveAsTable(name)
    return spark.table(name), Stored(spark, path, name)


def build_snapshot(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> Snapshot:
    buckets = shuffle_partitions(docs.sparkSession)
    groups, table = text_groups(docs, digest, buckets)
    salts = max(1, math.ceil(groups.count() / (buckets * FILTER_ROWS)))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        made = FuseFilter.build(frame["key"].to_numpy())
        return pd.DataFrame(
            {"bucket": [frame["bucket"].iloc[0]], "salt": [frame["salt"].iloc[0]], "seed": [made.seed], "segment": [made.segment], "segments": [made.segments], "cells": [made.cells]}
        )

    filters = (
        groups.select(_bucket(buckets).alias("bucket"), F.xxhash64("digest").alias("key"))
        .withColumn("salt", _salt(salts))
        .groupBy("bucket", "salt")
        .applyInPandas(build, "bucket int, salt int, seed long, segment long, segments long, cells binary")
    )
    filters, made = _stored(filters, "fuse-filters")
    return Snapshot(groups, filters, buckets, salts, (table, made))


def screen(digests: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The digests that the snapshot may hold (a superset of those that it holds)."""
    parts = max(1, math.ceil(digests.count() / (snapshot.buckets * snapshot.salts * SCREEN_ROWS)))
    key = F.xxhash64("digest").alias("key")
    incoming = (
        digests.select("digest", key, _bucket(snapshot.buckets).alias("bucket"))
        .withColumn("salt", _salt(snapshot.salts))
        .withColumn("part", F.pmod(F.shiftright("key", 17), F.lit(parts)).cast("int"))
    )
    filters = snapshot.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def test(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or own.empty:
            return pd.DataFrame({"digest": pd.Series([], dtype=object)})
        f = own.iloc[0]
        made = FuseFilter(int(f["seed"]), int(f["segment"]), int(f["segments"]), f["cells"])
        return rows.loc[made.contains(rows["key"].to_numpy()), ["digest"]]

    return (
        incoming.groupBy("bucket", "salt", "part")
        .cogroup(filters.groupBy("bucket", "salt", "part"))
        .applyInPandas(test, "digest string")
    )


def _held(groups: DataFrame, positives: DataFrame) -> DataFrame:
    """The groups of the positives.  Their digests are built into the hash table, a bucket's at a
    time; the groups with their texts stream past it, neither sorted nor exchanged."""
    return groups.join(positives.hint("shuffle_hash"), "digest", "left_semi")


def exact_dedup(
    old: DataFrame, new: DataFrame, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """Groups of equal texts over a snapshot of ``old`` and the batch ``new``: one row per
    input row with ``doc_id, keep_id, group_size, kept, digest``."""
    with ExitStack() as made:  # tables and folders that go once the groups are written
        snapshot = build_snapshot(old, digest)
        made.callback(snapshot.drop)
        batch, table = text_groups(new, digest, snapshot.buckets)
        made.callback(table.drop)
        positives, screened = _stored(screen(batch.select("digest"), snapshot), "positives")
        made.callback(screened.drop)

        held = _held(snapshot.groups, positives).select(
            "digest", *(F.col(c).alias(f"old_{c}") for c in ("keep_id", "group_size", "low", "one_text"))
        )
        hits, both = _stored(
            _held(batch, positives).join(held.hint("merge"), "digest").select(
                "digest",
                F.greatest("keep_id", "old_keep_id").alias("keep_id"),
                (F.col("group_size") + F.col("old_group_size")).alias("group_size"),
                (F.col("one_text") & F.col("old_one_text") & (F.col("low") == F.col("old_low"))).alias("one_text"),
            ),
            "hits",
        )
        made.callback(both.drop)
        narrow = ("digest", "keep_id", "group_size", "one_text")
        alone = snapshot.groups.select(*narrow).unionByName(batch.select(*narrow)).join(hits, "digest", "left_anti")
        groups = materialize(alone.unionByName(hits), "groups")  # all that the result reads beside the rows

    rows = _keyed(old.select("doc_id", "text").unionByName(new.select("doc_id", "text")), digest)
    out = ["doc_id", "keep_id", "group_size", "digest"]
    single = rows.drop("text").join(groups.where("one_text"), "digest").select(*out)
    mixed = groups.where("not one_text").select("digest")
    if not mixed.isEmpty():
        by_text = rows.join(mixed, "digest", "left_semi")
        each = by_text.groupBy("digest", "text").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        )
        single = single.unionByName(by_text.join(each, ["digest", "text"]).select(*out))
    return single.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def op1_exact_dedup(docs: DataFrame) -> DataFrame:
    """The older half of the ids is the snapshot, the newer half the incoming batch; rows
    without id arrive last."""
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    old = F.col("doc_id") <= F.lit(middle) if middle is not None else F.lit(False)
    old = F.coalesce(old, F.lit(False))
    return (
        exact_dedup(docs.where(old), docs.where(~old))
        .withColumnRenamed("digest", "text_sha256")
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    )


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
