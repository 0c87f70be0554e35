import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm.decontaminate import Items, contamination, least_distance, masks_of, pieces, plain


def slow_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=300, deadline=None)
@given(st.text("ab c", min_size=1, max_size=70), st.text("ab c", max_size=120), st.integers(0, 12))
def test_bit_parallel_distance(pattern, text, most):
    assert least_distance(len(pattern), masks_of(pattern), text, most) == min(slow_distance(pattern, text), most + 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", min_size=20, max_size=60), min_size=1, max_size=4), st.text("ab ", max_size=150), st.data())
def test_items_are_those_of_a_full_search(items, text, data):
    """Also with an item in the text, and some edits to it."""
    piece = plain(data.draw(st.sampled_from(items)))
    for _ in range(data.draw(st.integers(0, 4)) if piece else 0):
        i = data.draw(st.integers(0, len(piece)))
        piece = piece[:i] + data.draw(st.sampled_from(["", "a", "b"])) + piece[i + data.draw(st.integers(0, 1)) :]
    text = plain(f"{text} {piece} {text[::-1]}")
    want = {}
    for key, item in enumerate(items):
        norm = plain(item)
        if norm and (d := slow_distance(norm, text)) <= (len(norm) - 2) // 16 and text:
            want[key] = d
    assert Items(list(enumerate(items))).met_by(text) == want


@pytest.mark.parametrize("item, text, met", [("the", "they breathe", False), ("the", "breathe the air", True), ("cat sat", "concat sat on", False), ("cat sat", "a Cat, SAT on", True), ("the", "the", True)])
def test_items_are_whole_words(item, text, met):
    assert bool(Items([(1, item)]).met_by(plain(text))) == met


def test_pieces_cover_the_item():
    assert "".join(p for _, p in pieces("abcdefghij", 3)) == "abcdefghij" and len(pieces("abcdefghij", 3)) == 4


WORDS = "river stone meadow lantern copper window orchard thunder saddle pepper candle market harbor violin".split()


def passage(seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("block_chars", [10, 10**6])
def test_rows(spark, block_chars):
    item = passage(1)
    edited = item.replace("river", "rivet", 1).replace("stone", "ston", 1).upper().replace(" ", ",\n ")
    docs = spark.createDataFrame([(1, f"{passage(2)} {item} {passage(3)}", 0), (2, f"{passage(4)} {edited}", 0), (3, passage(5), 0), (4, None, 0), (5, "", 0), (3, passage(5), 0), (6, passage(6, 60_000) + item, 0)], "doc_id long, text string, n_items int")
    items = spark.createDataFrame([(10, item), (11, item), (12, passage(9)), (13, ""), (14, None), (None, item), (10, passage(9))], "item_id long, text string")
    got = sorted((r["doc_id"], r["__items"], r["__distances"]) for r in contamination(spark, docs, items, block_chars).collect())
    assert got[0] == (1, [None, 10, 11], [0, 0, 0]) and got[1][:2] == (2, [None, 10, 11]) and 0 < got[1][2][0] <= 2 + 2
    assert [g[1] for g in got[2:]] == [[], [], [], [], [None, 10, 11]]
    assert contamination(spark, docs.limit(0), items, block_chars).count() == 0
    assert all(not r["__items"] for r in contamination(spark, docs, items.limit(0), block_chars).collect())
