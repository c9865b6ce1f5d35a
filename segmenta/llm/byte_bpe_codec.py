"""Byte-level BPE encoding by forced-boundary splitting, and decoding.

A merge can only make a token of the vocabulary, so two neighbouring bytes that stand side by side
inside no token are never merged: between them lies a certain cut.  ``ByteBpe`` marks the byte
pairs of all tokens once (65,536 flags).  A text falls at special tokens, then into words by the
file's own splitting pattern, then at every certain cut; the fragments are encoded independently of
each other and their ids concatenated.  One fragment is merged lowest rank first, leftmost first
among equals; in long ones a heap over a linked list finds the next pair, so even a fragment
without any cut costs ``n log n``.  Words and fragments are remembered in caches of bounded size; a
cache never changes a result.

Vocabulary, merges and special tokens are read from the tokenizer file itself.  The ``tokenizers``
library takes no part in encoding or decoding; it is only asked, once per worker, how it splits the
few characters that its Unicode tables and those of ``regex`` may class differently.

Documents are encoded where they lie, without a shuffle; a task holds one Arrow batch of texts and
the ids of one text.

Results for odd input: a null text counts as empty; an empty text has no ids and decodes to the
empty text; a text of any length is encoded whole; null ids, ties and repeated rows are documents
like any other and stay as they are; an empty table gives no rows; other columns are not read.  In
``decode_ids`` ids outside the vocabulary are skipped and null ids count as none.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, compress, count
from operator import not_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import text_or_empty

#: Bounds of what a worker process remembers.
CACHED_WORDS = 800_000
CACHED_FRAGMENTS = 400_000
#: Longer words and fragments are rarely seen again; they are encoded the same way but not kept.
KEPT_LENGTH = 32
#: Up to this length the next merge is found by looking at all pairs, beyond it by a heap.
SCANNED_LENGTH = 64

# Fixed value: the splitting pattern of byte-level vocabularies, with the classes of letters,
# numbers and the rest left open.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The character that stands for each byte in the file: visible Latin-1 characters stand for
    themselves, the others, in order, for characters from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


def basic_class(pattern: str, without: str = "") -> str:
    """The characters up to U+FFFF that a class of ``regex`` holds, as ranges that ``re`` reads."""
    holds = regex.compile(pattern).match
    inside = np.array([bool(holds(chr(c))) and chr(c) not in without for c in range(1 << 16)] + [False])
    edges = np.flatnonzero(np.diff(inside, prepend=False)).tolist()
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2]))


def differing_characters() -> str:
    """Letters and numbers of ``regex`` that the ``tokenizers`` library takes for neither.  Only
    characters newer than Python's own Unicode tables can be."""
    from tokenizers.pre_tokenizers import ByteLevel

    visible = regex.compile(r"[\p{L}\p{N}]")
    newer = [c for c in map(chr, chain(range(0xD800), range(0xE000, 0x110000))) if unicodedata.category(c) == "Cn" and visible.match(c)]
    # "!" is neither letter nor number: it shares a word with its neighbour only if that is neither.
    parts = ByteLevel(add_prefix_space=False).pre_tokenize_str(" ".join("!" + c for c in newer))
    at = {start for _, (start, _) in parts}
    return "".join(c for i, c in enumerate(newer) if 3 * i + 1 not in at)


class ByteBpe:
    """Encoder and decoder over one tokenizer file (byte-level BPE without normaliser)."""

    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as f:
            file = json.load(f)
        model, splitter = file["model"], file["pre_tokenizer"] or {}
        plain = {"dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"}
        if model.get("type") != "BPE" or any(model.get(k) for k in plain) or file["normalizer"]:
            raise ValueError("the file must hold a plain BPE model without normaliser")
        if splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True):
            raise ValueError("the file must split texts by the byte-level pattern, without a space in front")
        added = file["added_tokens"] or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("special tokens must stand for exactly their text")

        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        vocabulary: dict[str, int] = model["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(map(value.__getitem__, token)) for token, i in vocabulary.items()}
        self.byte_ids = np.array([vocabulary[c] for c in letters])
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: For every id the ranks of its pairs, by the id that follows, and the id that a rank makes.
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(vocabulary.values()) + 1)]
        for rank, (a, b) in enumerate(merges):
            self.ranks[vocabulary[a]][vocabulary[b]] = rank
        self.made = [vocabulary[a + b] for a, b in merges]
        #: The ranks of pairs of single bytes.
        self.byte_ranks = np.array([
            self.ranks[a].get(b, len(merges)) for a in self.byte_ids.tolist() for b in self.byte_ids.tolist()
        ])
        self.certain = np.ones(1 << 16, bool)
        for token in self.bytes_of.values():
            for a, b in zip(token, token[1:]):
                self.certain[a << 8 | b] = False

        self.special = {t["content"]: t["id"] for t in added}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.at_special = None
        if self.special:
            longest_first = sorted(self.special, key=len, reverse=True)
            self.at_special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")")
        differing = differing_characters()
        #: For texts up to U+FFFF the same words by ``re``, which is faster.  Letters come first there:
        #: no other word begins with a letter, or with a space and a letter.
        letter, number, space = basic_class(r"\p{L}", differing), basic_class(r"\p{N}", differing), basic_class(r"\s")
        self.split_basic = re.compile(
            rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
        )
        self.beyond_basic = re.compile(r"[^\0-\uffff]")
        self.split_exact = regex.compile(SPLIT.format(letter=r"\p{L}", number=r"\p{N}", other=r"[^\s\p{L}\p{N}]"))
        if differing:
            out = "[" + regex.escape(differing, special_only=False) + "]"
            self.split_exact = regex.compile(
                "(?V1)" + SPLIT.format(letter=rf"[\p{{L}}--{out}]", number=rf"[\p{{N}}--{out}]", other=rf"[[^\s\p{{L}}\p{{N}}]||{out}]")
            )
        self.id_text = [str(i) for i in range(max(self.bytes_of) + 1)]
        self.words: dict[str, tuple[int, ...]] = {}
        self.fragments: dict[bytes, tuple[int, ...]] = {}

    # --- encoding ---------------------------------------------------------------------

    def merge(self, ids: list[int], ranks: list[int]) -> tuple[int, ...]:
        """The ids of one fragment, by merging alone, from those of its bytes and the ranks of
        their pairs."""
        return self._merge_scanning(ids, ranks) if len(ids) <= SCANNED_LENGTH else self._merge_by_heap(ids, ranks)

    def _merge_scanning(self, ids: list[int], ranks: list[int]) -> tuple[int, ...]:
        rules, made, none = self.ranks, self.made, len(self.made)
        while ranks:
            rank = min(ranks)
            if rank == none:
                break
            i = ranks.index(rank)
            new = ids[i] = made[rank]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rules[ids[i - 1]].get(new, none)
            if i < len(ranks):
                ranks[i] = rules[new].get(ids[i + 1], none)
        return tuple(ids)

    def _merge_by_heap(self, ids: list[int], ranks: list[int]) -> tuple[int, ...]:
        n, rules, none = len(ids), self.ranks, len(self.made)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # A heap entry is rank and place in one number; it is stale unless the pair now at the
        # place still has that rank.
        heap = [rank * n + i for i, rank in enumerate(ranks) if rank != none]
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            j = following[i]
            if ids[i] < 0 or j >= n or rules[ids[i]].get(ids[j]) != rank:
                continue
            new = ids[i] = self.made[rank]
            ids[j] = -1
            k = following[i] = following[j]
            if k < n:
                before[k] = i
                if (right := rules[new].get(ids[k])) is not None:
                    heapq.heappush(heap, right * n + i)
            h = before[i]
            if h >= 0 and (left := rules[ids[h]].get(new)) is not None:
                heapq.heappush(heap, left * n + h)
        return tuple(i for i in ids if i >= 0)

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word: all words are cut at certain pairs and at their ends in one pass,
        and the fragments encoded one by one."""
        raw = [word.encode() for word in words]
        joined = b"".join(raw)
        codes = np.frombuffer(joined, np.uint8)
        pairs = codes[:-1].astype(np.uint16) << 8 | codes[1:]
        ends = np.cumsum([len(r) for r in raw])
        cuts = np.ones(len(codes) + 1, bool)
        cuts[1:-1] = self.certain[pairs]
        cuts[ends] = True
        bounds = np.flatnonzero(cuts)
        last = np.searchsorted(bounds, ends).tolist()
        bounds, ids, ranks = bounds.tolist(), self.byte_ids[codes].tolist(), self.byte_ranks[pairs].tolist()
        known, found = self.fragments, []
        for a, b in zip(bounds, bounds[1:]):
            fragment = joined[a:b]
            made = known.get(fragment)
            if made is None:
                made = self.merge(ids[a:b], ranks[a : b - 1])
                if b - a <= KEPT_LENGTH:
                    if len(known) >= CACHED_FRAGMENTS:
                        known.clear()
                    known[fragment] = made
            found.append(made)
        return [
            found[a] if b - a == 1 else tuple(chain.from_iterable(found[a:b])) for a, b in zip([0, *last], last)
        ]

    def split(self, text: str) -> list[str]:
        basic = text.isascii() or not self.beyond_basic.search(text)
        return (self.split_basic if basic else self.split_exact).findall(text)

    def _encode_plain(self, text: str) -> Iterable[int]:
        words = self.split(text)
        known = self.words
        found = list(map(known.get, words))
        if not all(found):  # every word has ids, so only unknown words are false
            at = list(compress(count(), map(not_, found)))
            missing = list(dict.fromkeys(map(words.__getitem__, at)))
            made = dict(zip(missing, self.encode_words(missing)))
            for i in at:
                found[i] = made[words[i]]
            if len(known) + len(missing) > CACHED_WORDS:
                known.clear()
            known.update((word, ids) for word, ids in made.items() if len(word) <= KEPT_LENGTH)
        return chain.from_iterable(found)

    def encode(self, text: str) -> list[int]:
        if self.at_special is None:
            return list(self._encode_plain(text)) if text else []
        parts = self.at_special.split(text)
        out: list[int] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.special[part])
            elif part:
                out.extend(self._encode_plain(part))
        return out

    # --- decoding ---------------------------------------------------------------------

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load_codec(tokenizer_file: str) -> ByteBpe:
    """One codec per file and worker process."""
    return ByteBpe(tokenizer_file)


def encode_documents(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """``doc_id, ids array<int>`` for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load_codec(tokenizer_file)
        for batch in batches:
            ids = pa.array([codec.encode(t.as_py()) for t in batch.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, tokenizer_file: str) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id`` and ``ids``, special tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load_codec(tokenizer_file)
        for batch in batches:
            texts = [codec.decode(i for i in ids.as_py() if i in codec.bytes_of) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    whole = rows.select(F.col("doc_id").cast("long"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return whole.mapInArrow(run, "doc_id long, text string")


def codec_digests(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every whole text: the texts are
    encoded and the ids decoded again in the same task, so no ids leave it."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load_codec(tokenizer_file)
        text_of = codec.id_text
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for text in batch.column("text"):
                ids = codec.encode(text.as_py())
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join([text_of[i] for i in ids]).encode()).hexdigest())
                of_text.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
