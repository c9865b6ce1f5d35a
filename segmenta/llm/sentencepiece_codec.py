"""SentencePiece BPE encoding by a table of last tokens, and decoding.

Every prefix of a text has one encoding, so it has one last token.  Of the pieces that end a
prefix, that one is its last token which is compatible with the last token of the prefix before
it: the two, merged from characters, come out as exactly that pair.  The table of a segment is
filled along the matches of an Aho-Corasick automaton, linear in the text whatever its form, and
the ids are read from it backwards; pair tests are remembered.

Pieces never hold a space mark after another character, and characters outside the vocabulary
merge with nothing, so a text falls into independent segments; the ids of short segments are
remembered in a cache of bounded size, long ones are worked out each time by the same table.  The merge scores and pieces come from the model file through the
``sentencepiece`` library, which takes no part in encoding or decoding.

Results for odd input: a null text counts as empty; an empty text has no ids and decodes to the
empty text; null ids and repeated rows are kept as they are; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import text_or_empty

SPACE = "▁"
#: Bounds of what a worker process remembers.
CACHED_SEGMENTS = 400_000
CACHED_LENGTH = 64
CACHED_PAIRS = 1_000_000


class SegmentCache(dict):
    """Ids of short segments, by the segment without its leading mark; of bounded size."""

    def __init__(self, codec: PieceCodec, mark: str):
        super().__init__()
        self.codec, self.mark = codec, mark

    def __missing__(self, word: str) -> tuple[int, ...]:
        if self.mark and "\n" in word:  # several segments
            segments = self.codec.segment.findall(self.mark + word)
            return tuple(chain.from_iterable(map(self.codec.bare.__getitem__, segments)))
        ids = self.codec.encode_segment(self.mark + word)
        if len(word) < CACHED_LENGTH:
            if len(self) >= CACHED_SEGMENTS:
                self.clear()
            self[word] = ids
        return ids


class PieceCodec:
    """Encoder and decoder over one model file (BPE, byte fallback, identity normaliser)."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.scores = [model.get_score(i) for i in range(size)]
        normal = [
            i for i in range(size)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
        ]
        self.ids = {self.pieces[i]: i for i in normal}
        for piece in self.ids:
            if re.search(f"[^{SPACE}]{SPACE}", piece) or any(c not in self.ids for c in piece):
                raise ValueError("pieces must start with their space marks and have known characters")
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.id_text = [str(i) for i in range(size)]
        self.raw = [b""] * size
        for i in normal:
            self.raw[i] = self.pieces[i].replace(SPACE, " ").encode()
        for value, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([value])
        self.raw[model.unk_id()] = " ⁇ ".encode()
        self.silent = frozenset(i for i in range(size) if model.is_control(i))
        self.characters = frozenset(p for p in self.ids if len(p) == 1)
        if size > 1 << 16:
            raise ValueError("pair keys hold ids of 16 bits")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.length = [len(p) for p in self.pieces]
        self.rank = {piece: self.scores[i] for piece, i in self.ids.items()}
        self.byte_set = frozenset(self.byte_ids)
        # Newline is outside most vocabularies: a segment of its own.
        self.segment = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if "\n" not in self.ids else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.bare = SegmentCache(self, "")
        self.words = SegmentCache(self, SPACE)
        self.pairs: dict[int, bool] = {}

    # -- encoding ----------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """Merge characters by best score, leftmost first: only for one or two pieces."""
        parts = list(text)
        worst = float("-inf")
        ranks = [self.rank.get(a + b, worst) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = max(ranks)
            if best == worst:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = self.rank.get(parts[at - 1] + parts[at], worst)
            if at < len(ranks):
                ranks[at] = self.rank.get(parts[at] + parts[at + 1], worst)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` (-1: the start) and ``right`` stay two tokens when merged anew.
        Nothing merges with the bytes of an unknown character."""
        a = "" if left < 0 or left in self.byte_set else self.pieces[left]
        b = self.pieces[right]
        return self.merged(a + b) == ([a, b] if a else [b])

    def unknown(self, character: str) -> list[int]:
        return [self.byte_ids[b] for b in character.encode()]

    def encode_segment(self, segment: str) -> tuple[int, ...]:
        """The last token of every prefix, filled from left to right along the automaton's matches,
        then read backwards."""
        n = len(segment)
        last = [-2] * (n + 1)  # -2: no token ends here yet
        last[0] = -1
        if not self.characters.issuperset(segment):  # characters that no piece covers
            last[1:] = [-2 if c in self.characters else -3 - ord(c) for c in segment]
        pairs = self.pairs
        for end, (length, token) in self.automaton.iter(segment):
            end += 1
            if last[end] == -2:
                before = last[end - length]
                key = ((before if before >= 0 else -1) << 16) + token
                if pairs[key] if key in pairs else self.test_pair(key):
                    last[end] = token
        ids: list[int] = []
        while n:
            n = self.take(last[n], n, ids)
        ids.reverse()
        return tuple(ids)

    def take(self, token: int, n: int, ids: list[int]) -> int:
        """Append the last token, or the bytes of an unknown character, backwards."""
        if token >= 0:
            ids.append(token)
            return n - self.length[token]
        ids.extend(reversed(self.unknown(chr(-3 - token))))
        return n - 1

    def test_pair(self, key: int) -> bool:
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        fits = self.pairs[key] = self.compatible(key >> 16, key & 0xFFFF)
        return fits

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            segments = self.segment.findall(SPACE + text.replace(" ", SPACE))
            return list(chain.from_iterable(map(self.bare.__getitem__, segments)))
        return list(chain.from_iterable(map(self.words.__getitem__, text.split(" "))))

    # -- decoding ----------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        if not self.silent.isdisjoint(ids):  # a control token ends a run of byte tokens
            runs, start = [], 0
            for i, token in enumerate(ids):
                if token in self.silent:
                    runs.append(ids[start:i])
                    start = i + 1
            runs = [r for r in (*runs, ids[start:]) if r]
            return "".join(self.joined(r, strip=not k) for k, r in enumerate(runs))
        return self.joined(ids, strip=True)

    def joined(self, ids: list[int], strip: bool) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        if strip and ids and self.pieces[ids[0]].startswith(SPACE):
            raw = raw[1:]  # the mark that encoding puts in front
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _lenient(raw)


def _lenient(raw: bytes) -> str:
    """One replacement character for each byte that starts no whole character."""
    out, i = [], 0
    while i < len(raw):
        for width in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + width].decode())
                i += width
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


@functools.lru_cache(maxsize=2)
def load_codec(model_file: str) -> PieceCodec:
    """One codec per model and worker process."""
    return PieceCodec(model_file)


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, ids array<int>`` for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load_codec(model_file)
        for batch in batches:
            ids = pa.array([codec.encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def codec_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every whole text: the texts are
    encoded and the ids decoded again in the same task, so no ids leave it."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load_codec(model_file)
        text_of = codec.id_text.__getitem__
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for text in batch.column("text"):
                ids = codec.encode(text.as_py())
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(text_of, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
