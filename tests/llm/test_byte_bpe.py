"""The byte-level BPE codec against the ``tokenizers`` library."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from segmenta.llm import byte_bpe_codec, queries

FILE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, n_tokens string"
TEXTS = [
    "", None, "one", " \n\t x", "don't  stop\n\n\nnow", "tie", "tie", "a<|endoftext|><|endoftext|> b<|end", "1٣²½Ⅷ",
    "中文字符没有空格" * 400, "é\U0001f600\U0001f468‍\U0001f469" * 50, "՘֋ \x85\x1c　x", "\0\x7f",
]
#: Runs without a certain cut, and a long text with all kinds of characters.
LONG = ["a" * 100_000, "ab" * 50_000, " " * 50_000 + "x", "word, and 12 more. " * 20_000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def codec():
    return byte_bpe_codec.ByteBpe(FILE)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests_of_documents(spark, library):
    rows = [(i, t, "x", None) for i, t in enumerate(TEXTS + LONG)]
    rows += [rows[0], rows[4], (None, "null id", None, None)]  # repeated rows, clashing names
    docs = spark.createDataFrame(rows, SCHEMA)
    wanted = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        wanted.append((doc_id, len(ids), digest(",".join(map(str, ids))), digest(decoded)))
    found = byte_bpe_codec.codec_digests(docs, FILE)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    key = lambda row: (row[0] is None, row[0] or 0, row[2])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(wanted, key=key)


def test_ids_and_texts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    ids = byte_bpe_codec.encode_documents(docs, FILE)
    back = {r.doc_id: r.text for r in byte_bpe_codec.decode_ids(ids, FILE).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    odd = spark.createDataFrame([(1, None), (2, [31373, 99_999, 995, None])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in byte_bpe_codec.decode_ids(odd, FILE).collect()} == {1: "", 2: "hello world"}


def test_random_texts(codec, library):
    rng = random.Random(3)
    parts = [t for t in TEXTS if t and len(t) < 40] + ["a", " ", "\n", "'s", "'", "the", "ing", "0", "!", "<|endoftext|>"]
    for _ in range(5_000):
        text = "".join(
            rng.choice(parts) if rng.random() < 0.6
            else chr(rng.choice([rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)]))
            for _ in range(rng.randrange(1, 20))
        )
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids, text


def test_basic_split_is_the_exact_one(codec):
    rng = random.Random(7)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    exact, basic = codec.split_exact.findall, codec.split_basic.findall
    assert basic(every) == exact(every) and basic(" ".join(every)) == exact(" ".join(every))
    parts = [" ", "  ", "\n", "'s", "'S", "'", "re", "é", "1", "٣", "½", "!", "\x1c", "\x85", "\u3000", "中"]
    for _ in range(2_000):
        text = "".join(rng.choice(parts) if rng.random() < 0.8 else rng.choice(every) for _ in range(30))
        assert basic(text) == exact(text), text
        assert codec.split(text + "\U0001f600") == exact(text + "\U0001f600")
    assert not codec.beyond_basic.search(" é中\ud7a3") and codec.beyond_basic.search("a\U0001f600")


def test_certain_cuts_are_those_of_the_vocabulary(codec):
    inside = {pair for token in codec.bytes_of.values() for pair in zip(token, token[1:])}
    inside -= {pair for pair in zip(b"<|endoftext|>", b"|endoftext|>") if codec.certain[pair[0] << 8 | pair[1]]}
    assert all(codec.certain[a << 8 | b] == ((a, b) not in inside) for a in range(256) for b in range(256))


def test_scan_and_heap_agree(codec):
    rng = random.Random(5)
    for _ in range(2_000):
        raw = "".join(rng.choice("abehinst ") for _ in range(rng.randrange(2, 60))).encode()
        ids = [int(codec.byte_ids[b]) for b in raw]
        ranks = [int(codec.byte_ranks[a << 8 | b]) for a, b in zip(raw, raw[1:])]
        assert codec._merge_scanning(ids[:], ranks[:]) == codec._merge_by_heap(ids[:], ranks[:])


def test_full_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe_codec, "CACHED_WORDS", 3)
    monkeypatch.setattr(byte_bpe_codec, "CACHED_FRAGMENTS", 2)
    codec = byte_bpe_codec.ByteBpe(FILE)
    for text in ["one two three four five six", "six five four three two one zero", *filter(None, TEXTS)]:
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_byte_bpe(spark, str(tmp_path)).collect() == []
