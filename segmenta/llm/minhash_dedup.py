"""Near-duplicates by an inverted join on signature coordinates.

1. A text's set of word shingles gives a signature: ``coordinates`` minima of independent hashes.
   Texts with the same set are one class, represented by one narrow row.
2. Two sets of the wanted similarity differ in at most ``misses`` coordinates, but for a chance of
   ``MISS``.  So they agree in one of any ``misses + 1`` blocks of coordinates: only that prefix of
   blocks is posted, each class under the (coordinate, value) pairs of every block, a block being
   as wide as the number of coordinates allows.
3. Merging skips what is settled.  In every posting list one leader meets the members of other
   components: first the class with the longest lists in all, which is the most central one of a
   group of near copies, then another one each round.  Of the leaders that a member matches, the
   best one is confirmed on the full sets, and the components are merged.  After ``LEADER_ROUNDS``
   rounds, or one that linked little, the members of a list that still lie in different components
   meet each other; pairs are left out only when both texts are known to be connected.
   Two bounds keep pairs from leaving a join: four bits of every coordinate give at least the
   number of its collisions, and the parity sketch (a bit flipped by every shingle) of two sets
   differs in at most as many bits as the sets differ in shingles.  The second one never
   rejects a link, and rejects nearly all other pairs of texts of up to some thousand words.
4. Components are contracted by alternating large and small stars over component labels.

Texts are read once for the signatures and once for the classes on shared posting lists.  Hot lists,
classes and leaders are split by AQE: all are plain equi-joins on narrow rows.

Results for odd input: null and empty texts, and texts of white space alone, have no shingles and
are linked with nothing; a null id never is a component's id unless all of its ids are null; of
repeated rows with the same id all count as kept by ``near_duplicates`` and one by
``drop_near_duplicates``; an empty table gives no rows; other columns, whatever their names, pass
through ``drop_near_duplicates`` unread.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import drop_kept, materialize, slices, text_in

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
COORDINATES = 48
MISS = 1e-5
LEADER_ROUNDS = 3  # at most
LEADER_GAIN = 100  # a leader round that links less than one class in so many is the last one
PARITY_WORDS = 16  # 1,024 bits
BLOCK = 1 << 12
PAIR = ["a", "b", "la", "lb"]  # two nodes and their labels, the latter in either order
U64 = np.uint64
FACTORS = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
OFFSETS = np.random.default_rng(20240602).integers(0, 2**63, 256, dtype=np.uint64)


def match_threshold(coordinates: int, similarity: float, miss: float = MISS) -> int:
    """The largest count that a pair of that similarity falls short of with chance <= ``miss``."""
    below, m = 0.0, 0
    while True:
        below += math.comb(coordinates, m) * similarity**m * (1 - similarity) ** (coordinates - m)
        if below > miss:
            return max(1, m)
        m += 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    return h ^ (h >> U64(33))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``words`` words."""
    found = WORD.findall((text or "").translate(LOWER))
    if not found:
        return np.zeros(0, U64)
    known: dict[str, int] = {}
    for word in found:
        if word not in known:
            known[word] = xxhash.xxh3_64_intdigest(word)
    hashes = np.fromiter(map(known.__getitem__, found), U64, len(found))
    width = min(words, len(hashes))
    mixed = np.full(len(hashes) - width + 1, width, U64)
    for k in range(width):
        mixed = _mixed(mixed * U64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - width + 1 + k])
    return np.unique(mixed)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    out = np.full(coordinates, np.iinfo(U64).max, U64)
    for start in range(0, len(shingles), BLOCK):
        part = shingles[start : start + BLOCK, None]
        out = np.minimum(out, _mixed(part * FACTORS[:coordinates] + OFFSETS[:coordinates]).min(axis=0))
    return out


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """``PARITY_WORDS`` longs; every shingle flips one bit."""
    flips = np.bincount((shingles % U64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def _key() -> Column:
    """Identifies a document by 128 bits of its content, whatever the order of a scan."""
    one, other = F.xxhash64(F.col("doc_id"), F.lit(0), F.col("text")), F.xxhash64(F.lit(1), F.col("text"), F.col("doc_id"))
    return F.struct(one.alias("h0"), other.alias("h1")).alias("key")


def _features(docs: DataFrame, words: int, coordinates: int, carried: list[str]) -> DataFrame:
    """``row``, the carried columns, ``n_shingles``, ``class``, ``sig`` and ``parity`` of every row."""
    added = "n_shingles long, class string, sig array<long>, parity array<long>"
    doc = "doc" if "doc" in carried else None  # the text goes to the tasks once
    names = docs.schema[doc].dataType.names if doc else []
    columns = carried if doc else [*carried, "text"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), _key(), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in slices(batches):
            sizes, classes, sigs, parities = [], [], [], []
            for text in text_in(batch, doc, names):
                shingles = shingle_set(text.as_py(), words)
                sizes.append(len(shingles))
                some = len(shingles) > 0
                classes.append(xxhash.xxh3_128_hexdigest(shingles.tobytes()) if some else None)
                sigs.append(signature(shingles, coordinates).view(np.int64) if some else None)
                parities.append(parity_sketch(shingles) if some else None)
            kept = [n for n in batch.schema.names if n != "text"]
            longs = pa.list_(pa.int64())
            made = [pa.array(sizes, pa.int64()), pa.array(classes, pa.string()), pa.array(sigs, longs), pa.array(parities, longs)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), *made], [*kept, "n_shingles", "class", "sig", "parity"]
            )

    from pyspark.sql.types import StructType

    schema = StructType([f for f in rows.schema.fields if f.name != "text"] + StructType.fromDDL(added).fields)
    return materialize(rows.mapInArrow(run, schema), "signatures")


def _matches(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x)")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``a, b, la, lb`` with ``linked``: whether their full sets reach the similarity;
    ``texts`` has ``row, text``."""
    both = (
        pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        held, last = {}, None  # the set of the side that repeats from row to row
        for batch in slices(batches):
            keep = []
            for text_a, text_b in zip(batch.column("text_a"), batch.column("text_b")):
                sets = []
                for text in (text_a.as_py(), text_b.as_py()):
                    if text not in held:
                        if len(held) >= 8:
                            held.clear()
                        held[text] = shingle_set(text, words)
                    sets.append(held[text])
                one, other = sets
                common = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(one) + len(other) - common))
            made = [*map(batch.column, PAIR), pa.array(keep, pa.bool_())]
            yield pa.RecordBatch.from_arrays(made, [*PAIR, "linked"])

    schema = "a long, b long, la long, lb long, linked boolean"
    return both.select(*PAIR, "text_a", "text_b").mapInArrow(run, schema)


def _settled(links: DataFrame) -> bool:
    """Whether every ``u`` has one ``v`` that is no ``u`` itself."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))
    nodes = links.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.count(F.lit(1)).alias("n"))
    return nodes.where("up > 1 or (up = 1 and n > 1)").agg(F.count(F.lit(1))).first()[0] == 0


def connected(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the undirected links ``a, b``; the root is the smallest
    node that it reaches.  Alternating large and small stars, until every link leads to a root."""
    links = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = materialize(links.distinct(), "links")
    while not _settled(links):
        ways = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        links = materialize(small, "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (``node, label, degree``) after the links between nodes of the labels ``la, lb``."""
    roots = connected(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    joined = labels.join(roots.withColumnRenamed("node", "label"), "label", "left")
    return materialize(joined.select("node", F.coalesce("root", "label").alias("label"), "degree"), "labels")


def _sketch(coordinates: int) -> Column:
    """The lowest four bits of every coordinate, sixteen coordinates to a long."""

    def packed(start: int) -> Column:
        part = F.slice("sig", start + 1, 16)
        return F.aggregate(part, F.lit(0).cast("long"), lambda word, v: F.shiftleft(word, 4).bitwiseOR(v.bitwiseAND(F.lit(15))))

    return F.struct(*(packed(k).alias(f"w{k}") for k in range(0, coordinates, 16)))


def _differing(a: str, b: str, coordinates: int) -> Column:
    """In how many coordinates two sketches differ: at most as many as the signatures."""
    total = F.lit(0)
    for k in range(0, coordinates, 16):
        x = F.col(f"{a}.w{k}").bitwiseXOR(F.col(f"{b}.w{k}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def _parity() -> Column:
    return F.struct(*(F.get("parity", F.lit(k)).alias(f"w{k}") for k in range(PARITY_WORDS)))


def _within(percent: int) -> Column:
    """Whether two sets may differ in as many shingles as their parity sketches prove."""
    differing = F.lit(0)
    for k in range(PARITY_WORDS):
        differing = differing + F.bit_count(F.col(f"parity_a.w{k}").bitwiseXOR(F.col(f"parity_b.w{k}")))
    return F.lit(100 + percent) * differing <= F.lit(100 - percent) * (F.col("n_a") + F.col("n_b"))


def _close(percent: int) -> Column:
    """Whether the sizes of two sets allow the similarity."""
    return F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")


def _components(features: DataFrame, docs: DataFrame, words: int, percent: int, coordinates: int) -> DataFrame:
    """``class, label``: the component of every class."""
    least = match_threshold(coordinates, percent / 100)
    misses = coordinates - least
    width = coordinates // (misses + 1)
    classes = features.where("class is not null").groupBy("class").agg(F.min("row").alias("row"))
    sigs = features.select("row", "key", "n_shingles", "sig", _parity().alias("parity"))
    classes = materialize(classes.join(sigs, "row"), "classes")

    block = F.transform(
        F.sequence(F.lit(0), F.lit(misses)), lambda k: F.xxhash64(k, F.slice("sig", k * width + 1, F.lit(width)))
    )
    posted = classes.select("row", F.explode(block).alias("list"))
    shared = posted.groupBy("list").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    postings = materialize(posted.join(shared, "list"), "postings")

    nodes = postings.groupBy(F.col("row").alias("node")).agg(F.sum("length").alias("degree"))
    labels = materialize(nodes.select("node", F.col("node").alias("label"), "degree"), "labels")
    wanted = classes.join(labels.select(F.col("node").alias("row")), "row").select("row", "key")
    # Repeated rows share a key: one text for each representative, or its pairs would multiply.
    texts = docs.select(_key(), "text").join(wanted, "key").dropDuplicates(["key", "row"])
    texts = materialize(texts.select("row", "text"), "texts")
    seen = None
    leading, turn = True, -1
    while True:
        turn += 1
        leading = leading and turn < LEADER_ROUNDS
        members = postings.drop("length").join(labels.withColumnRenamed("node", "row"), "row")
        order = F.struct(F.xxhash64("row", F.lit(turn)) if turn else -F.col("degree"), F.col("row"))
        mixed = members.groupBy("list").agg(
            F.min("label").alias("low"), F.max("label").alias("high"),
            F.min_by(F.struct("row", "label"), order).alias("leader"),
        ).where("low < high")
        if leading:
            pairs = members.join(mixed, "list").where("label != leader.label")
            pairs = pairs.select(F.col("leader.row").alias("x"), F.col("row").alias("y"), F.col("leader.label").alias("la"), F.col("label").alias("lb"))
        else:
            sketched = classes.select("row", "n_shingles", "parity", _sketch(coordinates).alias("sketch"))
            rest = materialize(members.join(mixed.select("list"), "list").join(sketched, "row"), "unsettled")
            left, right = (
                rest.select("list", *(F.col(c).alias(f"{c}_{side}") for c in ("row", "label", "sketch", "parity")), F.col("n_shingles").alias(f"n_{side}"))
                for side in "ab"
            )
            met = (
                (F.col("row_a") < F.col("row_b"))
                & (F.col("label_a") != F.col("label_b"))
                & _close(percent)
                & _within(percent)
                & (_differing("sketch_a", "sketch_b", coordinates) <= misses)
            )
            pairs = left.join(right, (left["list"] == right["list"]) & met)
            pairs = pairs.select(F.col("row_a").alias("x"), F.col("row_b").alias("y"), F.col("label_a").alias("la"), F.col("label_b").alias("lb"))
        # In leader rounds x goes before y by one order over all lists, in the last round by row.
        pairs = pairs.distinct().select("x", "y", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "la", "lb")
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        one, two = (
            classes.select(F.col("row").alias(end), F.col("n_shingles").alias(f"n_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in ("sig", "parity")))
            for end, side in ("xa", "yb")
        )
        near = pairs.join(one, "x").join(two, "y").where(_close(percent)).where(_within(percent))
        near = near.select(*PAIR, "x", "y", _matches("sig_a", "sig_b").alias("matches")).where(F.col("matches") >= least)
        if leading:  # of each member's leaders the best one; the others meet it again while unsettled
            near = near.groupBy("y").agg(F.max_by(F.struct(*PAIR), F.struct("matches", "x")).alias("best")).select("best.*")
        near = materialize(near.select(*PAIR), "candidates")
        if near.isEmpty():
            if not leading:
                break
            leading = False
            continue
        tested = materialize(_confirmed(near, texts, words, percent), "confirmed")
        labels = _merged(labels, tested.where("linked"))
        if not leading:
            break
        refused = tested.where("not linked").select("a", "b")  # linked ones share a label and do not meet again
        leading = LEADER_GAIN * tested.where("linked").count() >= labels.count()
        if not refused.isEmpty():
            seen = refused if seen is None else seen.union(refused)
    joined = classes.join(labels.withColumnRenamed("node", "row"), "row", "left")
    return joined.select("class", F.coalesce("label", "row").alias("label"))


def _grouped(docs: DataFrame, words: int, percent: int, coordinates: int, carried: list[str]) -> DataFrame:
    """The feature rows with ``label``: equal for all rows of a component, null without shingles."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = _features(rows, words, coordinates, carried)
    labels = _components(features, rows.select("doc_id", "text"), words, percent, coordinates)
    return features.drop("sig", "parity").join(labels, "class", "left")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, coordinates: int = COORDINATES) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row: components of texts whose shingle
    sets have a similarity of at least ``percent`` hundredths."""
    rows = _grouped(docs, words, percent, coordinates, ["doc_id"])
    ids = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return rows.join(ids, "label", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, coordinates: int = COORDINATES) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (then the first one)."""
    rows = _grouped(docs, words, percent, coordinates, ["doc", "doc_id"])
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")
    best = rows.where("label is not null").groupBy("label").agg(F.min(order).alias("best"))
    kept = rows.join(best, "label", "left").where("label is null or row = best.row")
    return kept.select("doc.*")
