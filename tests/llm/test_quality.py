import math
import zlib

import numpy as np
import pytest

from leafmill.llm import quality

SF = "/root/testdata/sf0.01"


def slow_features(text):
    """The same features, one at a time."""
    w32 = lambda x: x & 0xFFFFFFFF
    down, mix, out = 32 - quality.BITS, 0x85EBCA6B, []  # of all kinds, in order
    cp = [ord(c) for c in text]
    for a, b, c in zip(cp, cp[1:], cp[2:], strict=False):
        h = w32(a * 0x01000193 + b * 0xC2B2AE35 + c * 0x27D4EB2F)
        out.append(w32((h ^ (h >> 15)) * mix) >> down)
    words, run = [], []
    for c in [*cp, 32]:
        if c > 32:
            run.append(c)
        elif run:
            h = w32(sum(w32((x ^ 0x5BD1E995) * pow(0x9E3779B1, (i & 63) + 1, 1 << 32)) for i, x in enumerate(run)))
            words.append(w32((h ^ (h >> 13)) * mix))
            run = []
    out += [w >> down for w in words]
    out += [0 if a == b else w32(a * 0xCC9E2D51 + b * 0x1B873593) >> down for a, b in zip(words, words[1:], strict=False)]
    return out


@pytest.mark.parametrize("text", ["", "a", "ab cd", "  leading and trailing  ", "same same same", "x" * 200, "né 漢字\n😀 ok", "\n\n", "a\x00b"])
def test_features(text):
    assert np.concatenate(quality.features(text)).tolist() == slow_features(text)
    ids, shares = quality.shares_of(text)
    assert set(ids.tolist()) == set(slow_features(text)) and (not len(ids) or abs(shares.sum() - 1) < 1e-5)


@pytest.mark.parametrize("text", ["the cat sat on a a mat " * 30, "x" * 300 + " y " + "zz zz\n\n  z " * 40, "a b c d e f g h i j k l m n o p " * 9, "née  漢字 " * 50, " " * 200 + "end"])
@pytest.mark.parametrize("at_once", [16, 61])
def test_long_texts_have_the_features_of_the_whole(monkeypatch, text, at_once):
    weights = np.random.default_rng(3).standard_normal(1 << quality.BITS)
    want, (ids, shares) = quality.score_of(text, weights, 0.1), quality.shares_of(text)
    monkeypatch.setattr(quality, "AT_ONCE", at_once)
    assert sum(1 for _ in quality.stretches(text)) > 3 or text.strip() == "end"
    assert quality.score_of(text, weights, 0.1) == pytest.approx(want)
    got = quality.shares_of(text)
    assert np.array_equal(got[0], ids) and np.allclose(got[1], shares)


def slow_train(rows, labels, seed=7):
    """The same descent, a number at a time."""
    rng, d = np.random.default_rng(seed), quality.DIM
    vectors = rng.uniform(-1 / d, 1 / d, (1 << quality.BITS, d)).astype(np.float32).astype(float)
    top, bias = [[0.0, 0.0] for _ in range(d)], [0.0, 0.0]
    g_v, g_t, g_b = {}, [[1e-8, 1e-8] for _ in range(d)], [1e-8, 1e-8]
    for epoch in range(quality.EPOCHS):
        step = quality.RATE * (1 - epoch / quality.EPOCHS)
        for i in rng.permutation(len(rows)).tolist():
            ids, share = rows[i][0].tolist(), rows[i][1].tolist()
            hidden = [sum(s * vectors[r][k] for r, s in zip(ids, share, strict=True)) for k in range(d)]
            z = [sum(hidden[k] * top[k][c] for k in range(d)) + bias[c] for c in (0, 1)]
            e = [math.exp(x - max(z)) for x in z]
            p = [x / sum(e) - (c == labels[i]) for c, x in enumerate(e)]
            back = [sum(top[k][c] * p[c] for c in (0, 1)) for k in range(d)]
            for c in (0, 1):
                for k in range(d):
                    g_t[k][c] += (hidden[k] * p[c]) ** 2
                    top[k][c] -= step * hidden[k] * p[c] / math.sqrt(g_t[k][c])
                g_b[c] += p[c] ** 2
                bias[c] -= step * p[c] / math.sqrt(g_b[c])
            for r, s in zip(ids, share, strict=True):
                g_v[r] = g_v.get(r, 1e-8) + s * s * sum(x * x for x in back)
                for k in range(d):
                    vectors[r][k] -= step * s / math.sqrt(g_v[r]) * back[k]
    return vectors, top, bias


def test_training_and_the_folded_score_equal_slow_ones():
    texts = ["a quiet river runs by the hill", "BUY NOW!! SALE!! SALE!!", "letters lay where they were put", "win win win money money"]
    rows, labels = [quality.shares_of(t) for t in texts], [1, 0, 1, 0]
    weights, offset = quality.train(rows, labels)
    vectors, top, bias = slow_train(rows, labels)
    for t in [*texts, "a river of money", ""]:
        kinds = [k for k in quality.features(t) if len(k)]
        hidden = [sum(sum(vectors[r][k] for r in rows) / len(rows) for rows in kinds) / max(1, len(kinds)) for k in range(quality.DIM)]
        z = [sum(hidden[k] * top[k][c] for k in range(quality.DIM)) + bias[c] for c in (0, 1)]
        assert quality.score_of(t, weights, offset) == pytest.approx(math.exp(z[1]) / (math.exp(z[0]) + math.exp(z[1])), abs=2e-3)


def test_the_sample_has_one_row_an_id_and_a_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i // 2, f"text {i} of many words", "q") for i in range(80)], "doc_id long, text string, quality string")
    known = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    assert sorted(q for q, _, _ in quality.sample(spark, docs, known, {0: 30, 1: 30})) == [0] * 20 + [1] * 20
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 7)
    got = quality.sample(spark, docs, known, {0: 30, 1: 30})
    assert len(got) == 14
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 3 * max(8 * len(ids) for _, ids, _ in got))
    assert 4 <= len(quality.sample(spark, docs, known, {0: 30, 1: 30})) < 14


def test_training_tells_kinds_apart():
    good = [f"a quiet line of prose number {i} about rivers and hills" for i in range(60)]
    bad = [f"BUY!! NOW!! {i}!! SALE!! BUY!!" for i in range(60)]
    weights, bias = quality.train([quality.shares_of(t) for t in good + bad], [1] * 60 + [0] * 60)
    assert quality.score_of("another line about hills and quiet rivers", weights, bias) > 0.7
    assert quality.score_of("SALE!! NOW!! BUY!!", weights, bias) < 0.3


def test_held_out_rows(spark):
    rows = quality.op5_quality(spark, SF).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held)
    kept = [r["predicted"] for r in held if labels[r["doc_id"]] == 1]
    assert right >= 0.9 and sum(kept) / len(kept) >= 0.97


def test_scores_do_not_depend_on_labels_of_the_held_fold(spark):
    docs = spark.createDataFrame([(i, f"text {i} good" if i % 2 else f"BAD!! {i}") for i in range(40)], "doc_id long, text string")
    true = [(i, i % 2) for i in range(40)]
    lied = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in true]
    a, b = (quality.fit(spark, docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (true, lied))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "x " * 300_000, 0.5), (3, "again", 0.5), (None, "null id", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 0)], "doc_id long, quality int")
    model = quality.fit(spark, docs, labels)
    scores = [r["__s"] for r in quality.score(spark, docs, model, "__s").collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 and not math.isnan(s) for s in scores)
    assert quality.score(spark, docs.limit(0), quality.fit(spark, docs.limit(0), labels.limit(0)), "__s").count() == 0
