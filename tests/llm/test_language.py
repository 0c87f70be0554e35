import math
import zlib
from collections import Counter

import numpy as np
import pytest

from leafmill.llm import language

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("text", ["", "a", "Ab c", "1 2 ?", "né  né\n漢字", "x" * 500])
def test_counts_equal_a_slow_count(text):
    w32 = lambda x: x & 0xFFFFFFFF
    s = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    while "  " in s:
        s = s.replace("  ", " ")
    want = Counter()
    for n, salt in ((1, 0x3C6EF372), (2, 0x1B873593), (3, 0x27D4EB2F)):
        for i in range(len(s) - n + 1):
            g = s[i : i + n]
            if g == " ":
                continue
            h = 0
            for c in g:
                h = w32(h * 0x01000193 + ord(c))
            h = w32((h + salt) * 0x9E3779B1)
            want[w32((h ^ (h >> 15)) * 0x9E3779B1) >> 19] += 1
    got = language.counts_of(text)
    assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == dict(want)


@pytest.mark.parametrize("text", ["The cat, the dog and  a bird. " * 20, "x" * 200 + " y " * 50, "né 漢字 — ß" * 40, "... 12 ... " * 30])
@pytest.mark.parametrize("at_once", [8, 33])
def test_long_texts_are_counted_as_a_whole(monkeypatch, text, at_once):
    want = language.counts_of(text)
    monkeypatch.setattr(language, "AT_ONCE", at_once)
    assert np.array_equal(language.counts_of(text), want)


def test_predictions_equal_slow_ones():
    """Weights, centroids, cosines and rejection, a number at a time."""
    texts = ["the cat sat on the mat", "a dog and the cat", "der Hund lief weg", "die Katze und der Hund", "le chat est sur la table"]
    rng = np.random.default_rng(2)
    idf = rng.uniform(1, 3, language.BUCKETS).astype(np.float32)
    vectors = np.stack([language.vector_of(t, idf) for t in texts])
    centres, least = language.clusters(vectors, 3)
    assert np.allclose(np.linalg.norm(centres, axis=1), 1, atol=1e-5)
    mine = [max(range(3), key=lambda c: float(v @ centres[c])) for v in vectors]
    for c in range(3):
        members = [v for v, m in zip(vectors, mine, strict=True) if m == c]
        total = np.sum(members, axis=0)
        assert np.allclose(centres[c], total / np.linalg.norm(total), atol=1e-4) and least[c] == pytest.approx(min(float(v @ centres[c]) for v in members), abs=1e-5)
    model = language.Model(idf, ["x", "y", "z"], centres, least)
    for t in ["the cat ran", "ein Hund", "漢字", "le chat"]:
        counts = language.counts_of(t)
        v = [math.log(1 + int(n)) * float(w) for n, w in zip(counts, idf, strict=True)]
        size = math.sqrt(sum(x * x for x in v))
        cosines = [sum(a * float(b) for a, b in zip(v, c, strict=True)) / size for c in centres]
        best = max(range(3), key=cosines.__getitem__)
        lang, score, rejected = model.predict(t)
        assert (lang, rejected) == ("xyz"[best], cosines[best] < language.SLACK * least[best]) and score == pytest.approx(cosines[best], abs=1e-4)


def test_held_out_accuracy(spark):
    rows = language.op4_language(spark, SF).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) >= 0.97
    assert sum(r["rejected"] for r in held) / len(held) < 0.05


def test_predictions_ignore_the_held_fold(spark):
    rows = [(i, "the cat sat" if i % 2 else "der Hund lief", "en" if i % 2 else "de") for i in range(60)]
    lied = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else g) for i, t, g in rows]
    schema = "doc_id long, text string, lang string"
    a, b = (language.fit(spark, spark.createDataFrame(x, schema).where(language.crc_mod("doc_id", 4) != 2)) for x in (rows, lied))
    assert a.langs == b.langs and np.array_equal(a.centres, b.centres) and np.array_equal(a.idf, b.idf)
    assert a.predict("the cat lay")[0] == "en" and a.predict("der Hund lag")[0] == "de"
    assert a.predict("漢字漢字")[2]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", 0.0), (2, "12 ?!", "en", 0.0), (3, "the cat", None, 0.0), (4, "the cat sat", "en", 0.0), (4, "the cat sat", "en", 0.0), (None, "the " * 400_000, "en", 0.0)], "doc_id long, text string, lang string, score double")
    model = language.fit(spark, docs)
    got = sorted((r["doc_id"] or 0, r["lang_pred"]) for r in language.identify(spark, docs, model).collect())
    assert got == [(0, "en"), (1, "und"), (2, "und"), (3, "en"), (4, "en"), (4, "en")]
    nothing = language.fit(spark, docs.limit(0))
    assert nothing.predict("the cat") == ("und", 0.0, True)
    assert language.identify(spark, docs.limit(0), nothing).count() == 0
