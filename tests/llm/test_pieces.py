import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm.pieces import PieceModel, digest, encoded, is_unigram, model_for

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "a", " a", "  a", "   a", "    a     b", "\t\n x\n", "hello world", "▁▁a ▁b", "ñandú 漢字 😀", "x" * 3000, "ab" * 900, "\x00", "thethethere thing things thinking", " " * 37 + "z", "a" + " " * 9]


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return model_for(f.read())


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_the_library(model, text):
    ids = model.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text)
    assert model.decode(ids) == LIBRARY.decode(LIBRARY.encode(text))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aeht niors  \n"), st.characters(exclude_categories=["Cs"])), max_size=50), max_size=5))
def test_ids_equal_the_library_on_any_texts(model, texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts)] == [LIBRARY.encode(t) for t in texts]


def test_documents_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = digest(encoded(spark, docs, PATH)).collect()
    assert len(rows) == len(texts) and all(r["round_trip"] for r in rows)
    for r in rows:
        want = LIBRARY.encode(texts[r["doc_id"]])
        assert (r["n_pieces"], r["ids_crc32"]) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "same", 0), (3, "same", 0), (4, "▁", 0), (None, "long word " * 100_000, 0)], "doc_id long, text string, n_pieces int")
    rows = sorted(((r["doc_id"] or 0), r["n_pieces"], r["round_trip"]) for r in digest(encoded(spark, docs, PATH)).collect())
    assert rows[1:] == [(1, 0, True), (2, 0, True), (3, 1, True), (3, 1, True), (4, 1, False)] and rows[0][2]
    assert encoded(spark, docs.limit(0), PATH).count() == 0


def message(*fields):
    """Serialised fields (number, value)."""
    out = b""
    for n, v in fields:
        v = v.encode() if isinstance(v, str) else v
        if isinstance(v, float):
            out += bytes([n << 3 | 5]) + struct.pack("<f", v)
        elif isinstance(v, bytes):
            out += bytes([n << 3 | 2, len(v) & 127 | 128, len(v) >> 7]) + v
        else:
            key = n << 3
            out += (bytes([key]) if key < 128 else bytes([key & 127 | 128, key >> 7])) + bytes([v])
    return out


def small_vocabulary(with_bytes):
    """A vocabulary of the unigram kind, written by hand: nothing is trained."""
    words = {"▁": -3.0, "a": -4.0, "b": -4.25, "c": -5.0, "ab": -6.0, "bc": -5.5, "abc": -9.0, "▁a": -5.0, "▁ab": -8.0, "ca": -9.5, "cab": -9.0, "aa": -7.5, "aaa": -11.0, "▁the": -6.5, "t": -6.0, "h": -6.0, "e": -5.5, "he": -8.0, "th": -9.0, "é": -7.0, ".": -5.0, "a.": -8.0}
    rows = [message((1, "<unk>"), (2, 0.0), (3, 2)), message((1, "<s>"), (2, 0.0), (3, 3)), message((1, "</s>"), (2, 0.0), (3, 3))]
    rows += [message((1, f"<0x{b:02X}>"), (2, 0.0), (3, 6)) for b in range(256 * with_bytes)]
    rows += [message((1, w), (2, x)) for w, x in words.items()]
    trainer = message((3, 1), (35, int(with_bytes)))
    return message(*[(1, r) for r in rows], (2, trainer), (3, message((1, "identity"), (3, 1), (4, 0), (5, 1))))


@pytest.mark.parametrize("with_bytes", [True, False])
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(alphabet="abcthe é.z漢", max_size=30), max_size=6))
def test_best_scores_equal_the_library(with_bytes, texts):
    raw = small_vocabulary(with_bytes)
    assert is_unigram(raw)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=raw), PieceModel(raw)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library.encode(t) for t in texts]


def test_the_kind_of_the_vocabulary_at_hand():
    with open(PATH, "rb") as f:
        assert not is_unigram(f.read())
