import heapq
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leafmill.llm import token_files
from leafmill.llm.common import Scratch
from leafmill.llm.huffman import Code, limited_lengths, pack, unpack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_huffman(weights):
    heap = [(w, k, {k: 0}) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    tick = len(weights)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], tick, {k: v + 1 for k, v in (a[2] | b[2]).items()}))
        tick += 1
    return heap[0][2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=2, max_size=60))
def test_lengths_are_optimal_without_a_binding_limit(weights):
    best = sum(weights[k] * n for k, n in plain_huffman(weights).items())
    lengths = limited_lengths(np.array(weights), 60)
    assert (lengths * np.array(weights)).sum() == best


def test_limit_binds():
    weights = np.array([2**k for k in range(20)])
    lengths = limited_lengths(weights, 6)
    assert lengths.max() <= 6 and sum(2.0 ** -int(x) for x in lengths) <= 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=400), st.integers(1, 50))
def test_blocks_round_trip(ids, block):
    ids = np.array(ids, np.int64)
    symbols, counts = np.unique(ids, return_counts=True)
    code = Code.from_bytes(Code.of_counts(symbols, counts).to_bytes())
    payload, offsets = pack(ids, code.encoder(), block)
    assert unpack(payload, offsets, len(ids), block, code.decoder(), code.limit).tolist() == ids.tolist()


def expected(rows):
    library, at, out = Tokenizer.from_file(PATH), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def write_and_read(spark, rows):
    path = Scratch(spark, "t").path("x")
    token_files.write_files(spark, spark.createDataFrame(rows, "doc_id long, text string, start string"), PATH, path)
    return sorted(map(tuple, token_files.read_files(spark, path).collect()), key=lambda r: r[1])


def test_files_hold_the_librarys_ids(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 50)
    texts = ["", None, "a <|endoftext|> b", "word " * 400, "ñandú 漢字 😀\n\n  it's", "LMHE\nLMH1", "\x00\x01"]
    rows = [(k * 7 % 31, texts[k % len(texts)], "x") for k in range(31)] + [(None, "null id", "x")]
    assert write_and_read(spark, rows) == expected([r[:2] for r in rows])


def test_repeated_rows_and_an_empty_table(spark):
    rows = [(5, "same", "")] * 3 + [(4, "b", "")]
    assert write_and_read(spark, rows) == expected([r[:2] for r in rows])
    assert write_and_read(spark, []) == []


@pytest.mark.parametrize("text", ["a  b", " \n x", "I'll  <|endoftext|>", "½Ⅷ\x1c\x85　z"])
def test_words_are_encoded_as_in_their_text(text):
    with open(PATH, "rb") as f:
        e = token_files.encoder_for(f.read())
    assert np.frombuffer(e.ids(text, 0), e.kind).tolist() == [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 0]


LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeht nio's,.!\n\t\x0b\x1c <|>é½　\x85\x7f"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_equal_the_library_on_any_text(text):
    with open(PATH, "rb") as f:
        e = token_files.encoder_for(f.read())
    assert np.frombuffer(e.ids(text, 7), e.kind).tolist() == [*LIBRARY.encode(text, add_special_tokens=False).ids, 7]


def test_very_long_words_are_not_kept():
    with open(PATH, "rb") as f:
        one = token_files.encoder_for(f.read())
    text = "long " * 220_000 + "x" * 70_000 + " " + "é" * 200
    got = np.frombuffer(one.ids(text, 0), one.kind)
    assert got.tolist() == [*one.library.encode(text, add_special_tokens=False).ids, 0]
    assert max(map(len, one.table)) <= 64
