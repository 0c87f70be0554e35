import math

import numpy as np
import pytest

from leafmill.llm import embeddings
from leafmill.llm.embeddings import near_duplicates, plan

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def slow(rows, threshold=0.93):
    """Every pair of rows of one label."""
    n = len(rows)
    ok = []
    for vec_id, v, label in rows:
        x = None if vec_id is None or v is None or label is None or not v or any(c is None for c in v) else np.array(v, np.float32).astype(float)
        ok.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = ok[i], ok[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], links[i], least.get(find(i)), r[0] is not None and least[find(i)] == r[0]) for i, r in enumerate(rows)), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in near_duplicates(spark, df).collect()), key=str)


def clustered(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dim))
    x = centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, dim)) * rng.choice([0.02, 0.2, 0.35], n)[:, None]
    return [(int(i * 2), x[i].astype(np.float32).tolist(), int(i % 3)) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_links_equal_those_of_all_pairs(spark, seed):
    rows = clustered(seed, 400)
    assert run(spark, rows) == slow(rows)


def test_blocks_of_a_label(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rows = clustered(5, 300)
    assert run(spark, rows) == slow(rows)


def test_large_labels_are_dealt_by_signature(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("MOST_BLOCKS", 2), ("BUCKET", 24)):
        monkeypatch.setattr(embeddings, name, value)
    rows = clustered(6, 300) + [(1000 + i, r[1], 7) for i, r in enumerate(clustered(7, 20))]
    assert run(spark, rows) == slow(rows)


def test_each_pair_counts_once_in_a_task():
    x = np.repeat(np.random.default_rng(1).standard_normal((3, 8)), 4, 0) * np.linspace(1, 2, 12)[:, None]
    found = embeddings.links(x, x, 0.93, 0)
    added, root = embeddings.counted(found, np.ones(12), np.ones(12), True)
    assert added.tolist() == [3] * 12 and root.tolist() == [0] * 4 + [4] * 4 + [8] * 4
    crossing = embeddings.links(x[:6], x[6:], 0.93, 0)
    added, root = embeddings.counted(crossing, np.ones(6), np.ones(6) * 2, False)
    assert added.tolist() == [0] * 4 + [4, 4] + [2, 2] + [0] * 4 and root.tolist() == [-1] * 4 + [4] * 4 + [-1] * 4


def test_odd_rows(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(1, e, 0), (2, [2.0, 0.0, 0.0], 0), (3, e, 1), (4, e, None), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 0.0], 0), (8, [float("nan"), 0.0, 1.0], 0), (9, [float("inf"), 0.0, 0.0], 0), (10, [1.0, 0.0], 0), (11, [], 0), (1, e, 0), (None, e, 0), (12, [1e30, 0.0, -0.0], 0), (13, [1e-30, 0.0, 0.0], 0)]
    assert run(spark, rows) == slow(rows)
    assert run(spark, []) == []


def test_tables_grow_with_the_largest_label():
    assert plan(5_000, 0.93)[0] < plan(5_000_000, 0.93)[0]
    for n in (10, 10**4, 10**8):
        bits, tables = plan(n, 0.93)
        assert (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** tables <= 1.0000001e-6


def test_recall_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert run(spark, rows) == slow(rows)


def test_doubles(spark):
    rows = [(1, [1.0, 1e-9], 0), (2, [1.0, 2e-9], 0), (3, [0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted((r["vec_id"], r["n_links"]) for r in near_duplicates(spark, df).collect()) == [(1, 1), (2, 1), (3, 0)]


def test_names_that_clash_and_long_vectors(spark):
    rows = [(1, [1.0] * 5000, 0, 1, 2, "t"), (2, [1.0] * 4999 + [0.9], 0, 1, 2, "t"), (3, [-1.0] * 5000, 0, 1, 2, "t")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key int, node int, task string")
    assert sorted(tuple(r) for r in near_duplicates(spark, df).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
