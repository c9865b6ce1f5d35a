"""Packing of token sequences by non-negative least squares over length combinations.

A document's tokens are cut into whole windows and one tail.  Tails are packed by their lengths
alone, so the plan depends only on their histogram (at most one count per length below the window):

1. Combinations of one to three tail lengths that need no padding are enumerated.
2. Non-negative least squares fits their repeat counts to the histogram (coordinate descent).
3. Counts are rounded, and lowered where a length runs out; every length's tails are dealt to
   combinations by rank.
4. The tails left over are laid end to end and cut at window ends; what is left at the very end
   is cut into powers of two.

So sequences are full, or a power of two long.  A tail's rank among its length is its rank within
its input partition plus the count in earlier partitions: no task gathers a length, however common.
Token ids of tails are kept next to the row until the cuts are known; of whole windows only the
checksum leaves the tokenising task.

Results for odd input: a null or empty text is the end token alone; null ids and repeated rows are
documents like any other; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmenta.llm.common import kept_by_worker, materialize, slices, text_or_empty

END_TOKEN = 0
CACHED_WORDS = 400_000
CACHED_LENGTH = 64
#: Below this code point all libraries agree on letters, digits and spaces.
PLAIN_LIMIT = "ɐ"


class _Irregular(Exception):
    """The text does not fall into words at its spaces."""


class WordTokenizer(dict):
    """Byte-level BPE ids of whole texts, as little-endian 32-bit ids.

    A space that a visible character follows always starts a new word, so a text is encoded word by
    word through a cache of bounded size.  Texts with other white space after a space, or with a
    special token's name, are encoded whole by ``tokenizers``."""

    def __init__(self, tokenizer_file: str, ranks_file: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.exact = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode_exact(self, text: str) -> bytes:
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_plain(self, text: str) -> bytes:
        if text and max(text) >= PLAIN_LIMIT:
            return self.encode_exact(text)
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise _Irregular
        ids = self.encode_plain(" " + word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(name in text for name in self.special):
            return self.encode_exact(text)
        first, *words = text.split(" ")
        try:
            return b"".join([self.encode_plain(first), *map(self.__getitem__, words)])
        except _Irregular:
            return self.encode_exact(text)


@kept_by_worker
def load_tokenizer(tokenizer_file: str, ranks_file: str, pattern: str) -> WordTokenizer:
    return WordTokenizer(tokenizer_file, ranks_file, pattern)


# --- the plan -------------------------------------------------------------------------


def combinations(lengths: list[int], window: int) -> list[tuple[int, ...]]:
    """One to three of ``lengths`` that fill the window, or a power of two alone: ascending."""
    known = set(lengths)
    ordered = sorted(known)
    found = [(a, window - a) for a in ordered if 2 * a <= window and window - a in known]
    for i, a in enumerate(ordered):
        if 3 * a > window:
            break
        for b in ordered[i:]:
            c = window - a - b
            if c < b:
                break
            if c in known:
                found.append((a, b, c))
    return found + [(a,) for a in ordered if a & (a - 1) == 0]


def repeat_counts(patterns: list[tuple[int, ...]], histogram: dict[int, int], sweeps: int) -> list[float]:
    """Non-negative least squares by coordinate descent from zero: earlier patterns take what they
    can, later ones fill in, so few counts end up small and many at zero."""
    left = {length: float(n) for length, n in histogram.items()}
    uses = [{length: p.count(length) for length in p} for p in patterns]
    weight = [sum(k * k for k in u.values()) for u in uses]
    counts = [0.0] * len(patterns)
    for _ in range(sweeps):
        moved = 0.0
        for i, used in enumerate(uses):
            step = sum(k * left[length] for length, k in used.items()) / weight[i]
            step = max(step, -counts[i])
            if step:
                counts[i] += step
                moved = max(moved, abs(step))
                for length, k in used.items():
                    left[length] -= k * step
        if moved < 0.5:
            break
    return counts


@dataclass(frozen=True)
class PackingPlan:
    """Where the tail of a given length and rank goes.

    ``starts[l]``, ``sequence[l]``, ``offset[l]``: rank r of length l belongs to the last interval
    whose start is at most r, in sequence ``sequence + r - start`` at ``offset``.  From rank
    ``dealt[l]`` on, tails lie end to end from ``stream[l]``."""

    window: int
    starts: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    dealt: dict[int, int]
    stream: dict[int, int]
    stream_tokens: int
    stream_sequence: int
    sequences: int

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start within the tail, length, sequence, offset) of each piece."""
        if rank < self.dealt[length]:
            i = int(np.searchsorted(self.starts[length], rank, side="right")) - 1
            sequence = int(self.sequence[length][i]) + rank - int(self.starts[length][i])
            return [(0, length, sequence, int(self.offset[length][i]))]
        at = self.stream[length] + (rank - self.dealt[length]) * length
        whole = self.stream_tokens // self.window * self.window
        out, done = [], 0
        while done < length:
            position = at + done
            if position < whole:
                sequence, begin = position // self.window, position // self.window * self.window
                end = begin + self.window
            else:  # powers of two, the largest first
                sequence, begin, rest = whole // self.window, whole, self.stream_tokens - whole
                while True:
                    end = begin + (1 << (rest.bit_length() - 1))
                    if position < end:
                        break
                    sequence, begin, rest = sequence + 1, end, rest - (end - begin)
            size = min(length - done, end - position)
            out.append((done, size, self.stream_sequence + sequence, position - begin))
            done += size
        return out


def plan_packing(histogram: dict[int, int], window: int, sweeps: int = 6) -> PackingPlan:
    histogram = {length: n for length, n in histogram.items() if length and n}
    patterns = combinations(list(histogram), window)
    counts = repeat_counts(patterns, histogram, sweeps)
    left, dealt, sequences = dict(histogram), dict.fromkeys(histogram, 0), 0
    intervals: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for i in sorted(range(len(patterns)), key=lambda i: -counts[i]):
        pattern = patterns[i]
        room = min(left[length] // pattern.count(length) for length in pattern)
        n = min(round(counts[i]), room)
        if n <= 0:
            continue
        offset = 0
        for length in pattern:
            intervals[length].append((dealt[length], sequences, offset))
            dealt[length] += n
            left[length] -= n
            offset += length
        sequences += n
    stream, tokens = {}, 0
    for length in sorted(left):
        stream[length] = tokens
        tokens += length * left[length]
    rest = tokens % window
    columns = {length: np.array(rows, np.int64).T for length, rows in intervals.items()}
    return PackingPlan(
        window,
        *({length: c[k] for length, c in columns.items()} for k in range(3)),
        dealt, stream, tokens, sequences, sequences + tokens // window + rest.bit_count(),
    )


# --- the job --------------------------------------------------------------------------

TOKENS_DDL = (
    "doc_id long, doc_tokens long, whole_crc32 array<long>, tail_length int, tail binary, "
    "part int, nth long, whole_before long"
)


def tokenized(docs: DataFrame, files: tuple[str, str, str], window: int) -> DataFrame:
    """One row per document: checksums of its whole windows, its tail, and its place in its
    partition (``nth`` of its tail length, whole windows before it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, part = load_tokenizer(*files), TaskContext.get().partitionId()
        end = np.array([END_TOKEN], "<u4").tobytes()
        seen: dict[int, int] = defaultdict(int)
        before, step = 0, 4 * window
        for batch in slices(batches):
            rows = []
            for text in batch.column("text"):
                ids = tokenizer.encode(text.as_py()) + end
                n = len(ids) // 4
                whole = n // window
                crcs = [zlib.crc32(ids[k * step : (k + 1) * step]) for k in range(whole)]
                length = n % window
                rows.append((n, crcs, length, ids[whole * step :], part, seen[length], before))
                seen[length] += 1
                before += whole
            names = ["doc_tokens", "whole_crc32", "tail_length", "tail", "part", "nth", "whole_before"]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, TOKENS_DDL)


PIECES_DDL = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def pack(docs: DataFrame, tokenizer_file: str, ranks_file: str, pattern: str, window: int = 1024) -> DataFrame:
    """The pieces of all documents, each with its sequence and its offset there."""
    tokens = materialize(tokenized(docs, (tokenizer_file, ranks_file, pattern), window), "tokens")

    lengths = tokens.groupBy("part", "tail_length").agg(F.count(F.lit(1)).alias("n"))
    lengths = materialize(lengths, "tail-lengths")
    # At most one row per length below the window.
    histogram = {r.tail_length: r.n for r in lengths.groupBy("tail_length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(histogram, window)

    earlier = Window.partitionBy("tail_length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = lengths.select("part", "tail_length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # One narrow row per partition.
    whole = tokens.groupBy("part").agg(F.sum(F.size("whole_crc32")).alias("whole"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("part", F.coalesce(F.sum("whole").over(running), F.lit(0)).alias("whole_earlier"))
    placed = tokens.join(before.join(whole, "part"), ["part", "tail_length"]).select(
        "doc_id", "doc_tokens", "whole_crc32", "tail_length", "tail",
        (F.col("before") + F.col("nth")).alias("rank"),
        (F.col("whole_earlier") + F.col("whole_before") + plan.sequences).alias("sequence"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PIECES_DDL.split(", ")]
        for batch in slices(batches):
            rows = []
            for r in batch.to_pylist():
                doc, n, crcs, tail = r["doc_id"], r["doc_tokens"], r["whole_crc32"], r["tail"]
                for k, crc in enumerate(crcs):
                    rows.append((doc, k * window, window, crc, n, r["sequence"] + k, 0))
                if tail:
                    base = len(crcs) * window
                    for start, size, sequence, offset in plan.pieces(r["tail_length"], r["rank"]):
                        crc = zlib.crc32(tail[4 * start : 4 * (start + size)])
                        rows.append((doc, base + start, size, crc, n, sequence, offset))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return placed.mapInArrow(run, PIECES_DDL)
