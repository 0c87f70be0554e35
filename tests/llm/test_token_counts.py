import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leafmill.llm.token_counts import counter_for, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "a", "  a\n\n b\t", "it's we'll 'S", "x" * 5000, "ab" * 700, "½Ⅷ٣ a1b2", "\x1c\x1d a\x85b　 c", "<|endoftext|>", "a <|endoftext|><|endoftext|> b<|endo", "ñandú Ärger œuvre 漢字 😀😀", "\u0000", "aaaa aaaa  aaaa"]


@pytest.fixture(scope="module")
def counter():
    with open(PATH, "rb") as f:
        return counter_for(f.read())


@pytest.mark.parametrize("text", ODD)
def test_counts_equal_the_library(counter, text):
    assert counter.text(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeht nio's\n\t <|>é½　"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_counts_equal_the_library_on_any_text(counter, text):
    assert counter.text(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_null_repeated_and_empty_rows(spark):
    docs = spark.createDataFrame([(1, "hello world", 5), (1, "hello world", 5), (2, None, 6), (None, "", 7)], "doc_id long, text string, n_tokens int")
    rows = sorted(map(tuple, count_tokens(spark, docs, PATH, limit=1).collect()), key=str)
    assert rows == sorted([(1, 11, 2, True), (1, 11, 2, True), (2, 0, 0, False), (None, 0, 0, False)], key=str)
    assert count_tokens(spark, docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("text", ["a lone word, and 12 more\n" * 45_000, "漢字 ñandú " * 120_000, "x" * 1_200_000])
def test_very_long_texts(counter, text):
    assert len(text) > 1_000_000 and counter.text(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)
    assert max(map(len, counter.table)) <= 64
