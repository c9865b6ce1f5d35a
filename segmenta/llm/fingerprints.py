"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` keeps, for one text, the modular hashes of all its prefixes (two 31-bit primes).  It
answers the equality of any two spans in constant time, finds longest common extensions by binary
search, and hashes a text spliced from two others without building it.

A fingerprint is a short string: the length, a grid (a power of two), the hash of the whole text,
the hashes of at most ``CHECKPOINTS`` prefixes and suffixes whose lengths are multiples of the
grid, and hash and length of every span.  Spans end at content-defined cuts, where the hash of the
last ``WINDOW`` characters is divisible by ``DIVISOR``, and ``MOST`` characters after the last end
where no cut comes before.  The likeness of two fingerprints is the share of the longer text that
their common spans take, wherever they stand, or their common prefix and suffix, found by binary
search over the common grid, if these take more; it is 1 only for equal texts.

Bounds: the likeness exceeds the share of equal passages only if two 32-bit hashes collide.  An edit
changes the spans from the last cut before it to the first cut at least ``WINDOW`` characters after
it.  So where every ``MOST`` characters hold a cut, an edit, or an end of a common passage, loses at
most ``2 * MOST + WINDOW`` characters (on ordinary text about ``2 * DIVISOR + WINDOW``).  Text
without cuts, such as one repeated character, falls into spans of ``MOST`` from its start; there an
edit may lose all of it that follows up to the next cut.

The keys alone (id and a hash of the text) are cut into ranges first; with the first key of each
known, documents move once, sorted within their range, and the first document of a range is sent to
the end of the range before as well.  So every document meets the next one in the same task, in one
stream, and nothing is written but that exchange.  A task holds two documents, some 23 bytes a
character each (prefix tables of two primes, code points and cuts), and ``BATCH_ROWS`` results.

Results for odd input: a null text counts as empty; null ids come first, repeated ids are ordered by
a hash of their texts, then by the texts; repeated rows follow each other; the document after the last one is the first, so a single document follows itself; two
empty texts have likeness 1; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import shuffle_partitions, text_or_empty

PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (911_382_323, 972_663_749)
BLOCK = 1 << 15
CHECKPOINTS = 16
WINDOW = 16
DIVISOR = 64
MOST = 1024


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    known = 1
    while known < n:
        step = min(known, n - known)
        out[known : known + step] = out[:step] * pow(base, known, prime) % prime
        known += step
    return out


POWERS = [_powers(b, p, BLOCK) for b, p in zip(BASES, PRIMES)]
INVERSES = [pow(b, -1, p) for b, p in zip(BASES, PRIMES)]
INVERSE_POWERS = [_powers(i, p, BLOCK) for i, p in zip(INVERSES, PRIMES)]
SPAN = np.dtype([("hash", ">u4"), ("length", ">u2")])


class PrefixHash:
    """Hashes of all prefixes of a text, by code points."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        self.n = len(codes)
        self.prefix = [np.zeros(self.n + 1, np.int64) for _ in PRIMES]
        for table, powers, base, p in zip(self.prefix, POWERS, BASES, PRIMES):
            for start in range(0, self.n, BLOCK):
                part = codes[start : start + BLOCK]
                sums = np.cumsum(part * powers[: len(part)] % p) % p
                table[start + 1 : start + 1 + len(part)] = (
                    sums if start == 0 else (table[start] + sums * pow(base, start, p)) % p
                )

    def at(self, i: int) -> list[int]:
        return [int(t[i]) for t in self.prefix]

    def many(self, at: np.ndarray, k: int) -> np.ndarray:
        """The prefix hashes at many places, by the ``k``-th prime."""
        return self.prefix[k][at]

    @cached_property
    def cuts(self) -> np.ndarray:
        parts = [
            _cuts(self, np.arange(start, min(start + BLOCK, self.n - WINDOW + 1)))
            for start in range(0, self.n - WINDOW + 1, BLOCK)
        ]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """The hash of a span, the same wherever an equal span stands."""
        return _span(self.at(start), self.at(end), start)

    def common_extension(self, i: int, other: PrefixHash, j: int) -> int:
        """The length of the longest common prefix of ``self[i:]`` and ``other[j:]``."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(i, i + middle) == other.span(j, j + middle):
                low = middle
            else:
                high = middle - 1
        return low


def _span(before: list[int], after: list[int], start: int) -> tuple[int, ...]:
    return tuple(
        (b - a) * pow(inverse, start, p) % p for a, b, inverse, p in zip(before, after, INVERSES, PRIMES)
    )


def _hashes(source: PrefixHash | Spliced, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """The hashes of many spans, as by ``_span``."""
    p = PRIMES[k]
    blocks, within = np.divmod(starts, BLOCK)
    low = int(blocks[0]) if len(blocks) else 0
    high = int(blocks[-1]) if len(blocks) else 0  # starts ascend
    shifts = np.array([pow(INVERSES[k], b * BLOCK, p) for b in range(low, high + 1)], np.int64)
    inverse = INVERSE_POWERS[k][within] * shifts[blocks - low] % p
    return (source.many(ends, k) - source.many(starts, k)) % p * inverse % p


def _cuts(source: PrefixHash | Spliced, starts: np.ndarray) -> np.ndarray:
    """The ends of those of the windows from ``starts`` on that are cuts."""
    return starts[_hashes(source, starts, starts + WINDOW, 0) % DIVISOR == 0] + WINDOW


class Spliced:
    """The hashes of ``head[:cut] + tail[:length]``, from the two texts' own tables."""

    def __init__(self, head: PrefixHash, cut: int, tail: PrefixHash, length: int):
        self.head, self.cut, self.tail, self.n = head, cut, tail, cut + length
        self.shift = [pow(b, cut, p) for b, p in zip(BASES, PRIMES)]

    def at(self, i: int) -> list[int]:
        if i <= self.cut:
            return self.head.at(i)
        pairs = zip(self.head.at(self.cut), self.tail.at(i - self.cut), self.shift, PRIMES)
        return [(a + s * b) % p for a, b, s, p in pairs]

    def many(self, at: np.ndarray, k: int) -> np.ndarray:
        first = self.head.many(np.minimum(at, self.cut), k)
        rest = self.tail.many(np.maximum(at - self.cut, 0), k)
        return (first + self.shift[k] * rest) % PRIMES[k]

    @property
    def cuts(self) -> np.ndarray:
        """Those of the two texts, and those of the windows over the splice."""
        head, tail = self.head.cuts, self.tail.cuts
        over = _cuts(self, np.arange(max(0, self.cut - WINDOW + 1), min(self.cut, self.n - WINDOW + 1)))
        return np.concatenate([head[head <= self.cut], over, tail[tail <= self.n - self.cut] + self.cut])


def spans_of(source: PrefixHash | Spliced) -> np.ndarray:
    """Hash and length of every span of the text, in order."""
    n = source.n
    inner = source.cuts
    starts = np.concatenate([np.zeros(min(n, 1), np.int64), inner[inner < n]])
    lengths = np.diff(np.append(starts, n))
    pieces = -(-lengths // MOST)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begins = np.repeat(starts, pieces) + nth * MOST
    ends = np.append(begins[1:], n)[: len(begins)]
    out = np.zeros(len(begins), SPAN)
    one, two = (_hashes(source, begins, ends, k) for k in range(2))
    out["hash"] = one ^ (two * 2654435761 & 0xFFFFFFFF)
    out["length"] = ends - begins
    return out


def fingerprint(hashes: PrefixHash | Spliced) -> str:
    n, grid = hashes.n, 1
    while n // grid > CHECKPOINTS:
        grid *= 2
    whole = hashes.at(n)

    def short(span: tuple[int, ...]) -> str:
        return f"{(span[0] ^ span[1] * 2654435761) & 0xFFFFFFFF:08x}"

    lengths = range(grid, n + 1, grid)
    prefixes = "".join(short(tuple(hashes.at(k))) for k in lengths)
    suffixes = "".join(short(_span(hashes.at(n - k), whole, n - k)) for k in lengths)
    return f"{n}:{grid}:{whole[0]:08x}{whole[1]:08x}:{prefixes}:{suffixes}:{spans_of(hashes).tobytes().hex()}"


def _common_spans(one: str, other: str) -> int:
    """The characters in the spans that two texts share, each span as often as in both."""

    def counted(spans: str) -> tuple[np.ndarray, np.ndarray]:
        found = np.frombuffer(bytes.fromhex(spans), SPAN)
        return np.unique(found["hash"].astype(np.int64) << 16 | found["length"], return_counts=True)

    (a, n), (b, m) = counted(one), counted(other)
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return int(((both & 0xFFFF) * np.minimum(n[i], m[j])).sum())


def likeness(one: str, other: str) -> float:
    if one == other:
        return 1.0
    (n, g, _, *mine, spans), (m, h, _, *theirs, others) = one.split(":"), other.split(":")
    n, m, g, h = int(n), int(m), int(g), int(h)
    grid, longer = max(g, h), max(n, m)

    def common(a: str, b: str) -> int:
        low, high = 0, min(n, m) // grid
        while low < high:
            k = (low + high + 1) // 2
            i, j = 8 * (k * grid // g - 1), 8 * (k * grid // h - 1)
            low, high = (k, high) if a[i : i + 8] == b[j : j + 8] else (low, k - 1)
        return low * grid

    shared = max(sum(common(a, b) for a, b in zip(mine, theirs)), _common_spans(spans, others))
    return min(shared, longer - 1) / longer


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [PrefixHash(t.as_py()) for t in batch.column("text")]
            arrays = [batch.column("doc_id"), pa.array([h.n for h in made], pa.int64()), pa.array([fingerprint(h) for h in made], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_chars", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


class _Document:
    """A document in hand: its hashes and fingerprint are made once, for both of its neighbours."""

    __slots__ = ("doc_id", "text", "hashes", "print")

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.hashes = PrefixHash(text)
        self.print = fingerprint(self.hashes)


def _compared(doc: _Document, following: _Document) -> tuple:
    """A result row: the edit ends the document's first half with the following one's start."""
    n = len(doc.text)
    cut = n - n // 2
    taken = following.text[: n // 2]
    edited = fingerprint(Spliced(doc.hashes, cut, following.hashes, len(taken)))
    digest = hashlib.sha256((doc.text[:cut] + taken).encode()).hexdigest()
    return (doc.doc_id, n, digest, doc.print, edited, likeness(doc.print, edited), likeness(doc.print, following.print))


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
RESULT_DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
BATCH_ROWS = 512


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RESULT)], schema=RESULT)


def _compare_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result rows of one sorted range, whose last rows are copies of the document after it."""
    previous, out = None, []
    for batch in batches:
        for doc_id, text, after in zip(*(batch.column(c) for c in ("doc_id", "text", "after"))):
            if after.as_py() and previous is None:
                break  # a further copy: the document after the range has an equal row
            doc = _Document(doc_id.as_py(), text.as_py())
            if previous is not None:
                out.append(_compared(previous, doc))
            previous = None if after.as_py() else doc
            if len(out) >= BATCH_ROWS:
                yield _batch(out)
                out = []
    if out:
        yield _batch(out)


KEY = ["known", "id", "hash"]  # the order of documents: null ids first


def _first_keys(rows: DataFrame) -> list[tuple]:
    """The first key of every range, in order, when the keys alone are cut into as many ranges as
    there are shuffle partitions; a narrow exchange, and one row per range on the driver."""
    # A stated number of ranges: keys are few bytes, and would be gathered into one.
    ranged = rows.select(*KEY).repartitionByRange(shuffle_partitions(rows.sparkSession), *KEY)
    first = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*KEY)).alias("key"))
    return sorted(tuple(r.key) for r in first.collect())


def _range_of(firsts: list[tuple]) -> Column:
    """The number of the range that holds a row's key: a balanced tree of comparisons."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high + 1) // 2
        bound = F.struct(*(F.lit(v).cast(t).alias(c) for c, v, t in zip(KEY, firsts[middle], ("boolean", "long", "long"))))
        return F.when(F.struct(*KEY) < bound, among(low, middle - 1)).otherwise(among(middle, high))

    return among(0, len(firsts) - 1)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the
    next document."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), text_or_empty().alias("text")).select(
        "doc_id", "text", F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("hash")
    )
    firsts = _first_keys(rows)
    if not firsts:
        return rows.limit(0).select("doc_id", "text", F.lit(False).alias("after")).mapInArrow(_compare_range, RESULT_DDL)
    starts = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(KEY, key))) for key in firsts))
    ranged = rows.withColumn("range", _range_of(firsts))
    is_first = F.element_at(starts, F.col("range") + 1) == F.struct(*KEY)
    # The first document of a range goes to the end of the one before as well; the last range is
    # before the first.
    here = F.struct(F.col("range").alias("range"), F.lit(False).alias("after"))
    before = F.struct(F.pmod(F.col("range") - 1, F.lit(len(firsts))).alias("range"), F.lit(True).alias("after"))
    placed = ranged.withColumn("at", F.explode(F.when(is_first, F.array(here, before)).otherwise(F.array(here))))
    dealt = placed.select("doc_id", "text", *KEY, "at.range", "at.after").repartitionById(len(firsts), F.col("range"))
    ordered = dealt.sortWithinPartitions("after", *KEY, "text")
    return ordered.select("doc_id", "text", "after").mapInArrow(_compare_range, RESULT_DDL)
