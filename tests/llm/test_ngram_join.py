import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import ngram_join
from leafmill.llm.common import Scratch
from leafmill.llm.components import connected_components
from leafmill.llm.shingles import shingle_set, word_hashes


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow_set(text, size=5):
    w = words_of(text)
    if not w:
        return frozenset()
    n = min(size, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def slow_components(rows):
    """Every pair compared."""
    sets = [slow_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least[find(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abAB éÉ\t\n\x0b\x1c　Z"), max_size=60))
def test_sets_have_the_right_size(text):
    assert len(shingle_set(text)) == len(slow_set(text))


def test_equal_words_have_equal_hashes(monkeypatch):
    text = "Alpha beta " * 50 + "x" * 3000 + " ALPHA " + "x" * 3000
    h = word_hashes(text)
    assert h[0] == h[2] == h[-2] and h[-1] == h[-3] and len(set(h.tolist())) == 3
    monkeypatch.setattr("leafmill.llm.shingles.AT_ONCE", 64)
    assert np.array_equal(word_hashes(text), h)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), max_size=12), min_size=1, max_size=8))
def test_partial_overlaps_sum_to_the_whole(sets):
    sets = sorted(sets, key=len)
    one = ngram_join.Overlaps(np.array([len(s) for s in sets]))
    for f in range(3):
        one.add([np.array(sorted(x for x in s if x % 3 == f), np.uint64) for s in sets])
    for i, counts in enumerate(one.counts):
        assert counts.tolist() == [len(sets[i] & sets[i + 1 + k]) for k in range(len(counts))]
        assert all(3 * len(sets[j]) > 4 * len(sets[i]) for j in range(i + 1 + len(counts), len(sets)))


def test_fragments_grow_with_the_data_and_common_ngrams_are_found(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FRAGMENT_BYTES", 800)
    docs = spark.createDataFrame([(i, "a b c d e f " + " ".join(f"{i}w{k}" for k in range(94))) for i in range(60)], "doc_id long, text string")
    fragments, common = ngram_join.shape(docs, 5)
    assert fragments == 58 and len(common) == 2
    assert ngram_join.shape(docs.limit(0), 5)[0] == 16


def test_packed_ids_round_trip():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64))
    assert np.array_equal(ngram_join.unpack_sorted(ngram_join.pack_sorted(x)), x)


def corpus(seed):
    """Unrelated texts, groups of near copies around the limit, exact copies, a passage that many share, short texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.choice([2, 3, 4])))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for g in range(12):
        base = [word() for _ in range(r.choice([12, 40, 90]))]
        for _ in range(r.choice([1, 2, 9])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 4])):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w) if g % 3 else passage + " " + " ".join(w[: r.choice([5, 12, 20])]))
    rows += [rows[0].upper(), rows[0].replace(" ", "\n\t"), "", None, "one", "one", "one two three", "One Two  three", " ", "a b c d e", "a b c d e f", "a b c d e f g h"]
    r.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_those_of_all_pairs(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, component_id int").repartition(3)
    got = sorted((tuple(r) for r in ngram_join.components(spark, docs).collect()), key=str)
    assert got == slow_components(rows)


def test_a_large_group_whose_first_member_misses_some(spark):
    """A chain of links: none of its ends is linked with the first of the group."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(40):
        w = list(base)
        for k in range(i // 4 * 2):
            w[(k * 7) % 100] = f"v{k}"
        w[-1 - i % 4] = f"u{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in ngram_join.components(spark, docs).collect()), key=str) == slow_components(rows)


def test_clusters_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TASK_GRAMS", 300)
    rows = corpus(11)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in ngram_join.components(spark, docs).collect()), key=str) == slow_components(rows)


def test_odd_rows(spark):
    rows = [(5, "the same row of seven words here"), (5, "the same row of seven words here"), (None, "the same row of seven words here"), (None, "alone"), (2, None), (9, "word " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.components(spark, docs).collect()), key=str)
    assert got == slow_components(rows)
    assert ngram_join.components(spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_connected_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 30)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in connected_components(spark, spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}
    assert connected_components(spark, spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def slow_links(rows):
    """(doc_id, links) of each row, every pair compared."""
    sets = [slow_set(t) for _, t in rows]
    link = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)
    return sorted(((d, sum(link(sets[i], sets[j]) for j in range(len(rows)) if i != j)) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("seed, most, classes, common", [(0, 4_000_000, 1024, 2), (1, 4_000_000, 1024, 1 << 30), (11, 300, 1024, 4), (12, 4_000_000, 3, 3)])
def test_links_equal_those_of_all_pairs(spark, monkeypatch, seed, most, classes, common):
    for name, value in (("TASK_GRAMS", most), ("TASK_CLASSES", classes), ("COMMON", common)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = corpus(seed)
    rows += [rows[3], (None, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.linked(spark, docs).collect()
    assert sorted(((r["doc_id"], r["n_links"]) for r in got), key=str) == slow_links(rows)
    assert sum(r["n_links"] > 2 for r in got) > 10


def test_links_within_one_component_are_all_found(spark):
    """Different texts of one group: all are linked with all, and the copy of one counts for each."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:i], f"v{i}", *base[i + 1 :]]) for i in range(10, 190, 20)]
    rows = list(enumerate([*texts, texts[0]]))
    got = ngram_join.linked(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_links"], r["component_id"]) for r in got} == {(i, 9, 0) for i in range(10)}
