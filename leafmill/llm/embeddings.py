"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Vectors of one label and length that hold the same numbers are one class. The classes of a label and length are cut into
blocks of about BLOCK, and each pair of blocks is one task's work: there, every class gets a signature of signs in each
of several tables, classes whose signatures agree in a table are compared in double precision, and a pair counts once
however many tables bring it together. A class moves once for each block of its label, not once for each table. A label
of more than MOST_BLOCKS blocks is first dealt into buckets of equal signatures, once for each of several tables whose
bits grow with it, and the buckets are cut into blocks like labels; a pair is then counted in the first table that brings
it together. The tables are as many as leave a pair at the threshold out with a chance of at most MISS. A task hands on a
count for each class and a spanning forest, never its pairs.

Results for odd rows: a vector that is null, zero, holds null or non-finite numbers, or has a null label or vec_id
links with nothing; repeated rows are vectors that link with each other; a null vec_id has no component; a component of
several least rows of one vec_id (ties) is named by it and keeps them all; vectors of any length are compared whole; an
empty table gives an empty table; columns besides vec_id, embedding and label are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import Scratch, in_runs, partitions_for, ship, table
from leafmill.llm.components import connected_components

THRESHOLD = 0.93
MISS, TARGET = 1e-6, 64
#: Classes of a block, and blocks of a label above which it is dealt by signature; classes of such a bucket by chance.
BLOCK, MOST_BLOCKS, BUCKET = 4096, 16, 1024
SEED = 20240229


def plan(classes: int, threshold: float, target: int = TARGET) -> tuple[int, int]:
    """(bits of a signature, tables) so that a bucket holds about so many of the classes by chance."""
    bits = max(1, math.ceil(math.log2(max(1, classes) / target)))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree))


def number_kind(rows: DataFrame) -> str:
    """The vectors' own numbers, 4 or 8 bytes each; comparisons are in double precision either way."""
    return "<f4" if isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"


def checked(rows: DataFrame) -> DataFrame:
    """vec_id, key of the class (null for vectors that link with nothing), label, the numbers' bytes."""
    kind = number_kind(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, data = [], []
            for vec_id, v, label in zip(b.column("vec_id").to_pylist(), b.column("embedding"), b.column("label").to_pylist(), strict=True):
                raw = None
                if vec_id is not None and label is not None and v.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if np.isfinite(x).all() and x.any():
                        raw = (x + 0.0).astype(kind).tobytes()  # one zero
                keys.append(hashlib.blake2b(f"{label}|".encode() + raw, digest_size=16).digest() if raw else None)
                data.append(raw)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, pa.binary()), b.column("label").cast(pa.int64()), pa.array(data, pa.binary())], ["vec_id", "key", "label", "data"])

    return rows.select("vec_id", "embedding", "label").mapInArrow(run, "vec_id long, key binary, label long, data binary")


def signs(x: np.ndarray, bits: int, tables: int, seed: int = 0) -> np.ndarray:
    """A signature for each vector and table."""
    planes = np.random.default_rng([SEED, seed, x.shape[1]]).standard_normal((x.shape[1], bits * tables))
    on = (x @ planes >= 0).reshape(len(x), tables, bits)
    return (on << np.arange(bits, dtype=np.uint64)).sum(2, dtype=np.uint64)


def alike(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of a and of b that hold the same value, for each value in both."""
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b = a[by_a], b[by_b]
    for v in np.intersect1d(a, b):
        yield by_a[np.searchsorted(a, v) : np.searchsorted(a, v, "right")], by_b[np.searchsorted(b, v) : np.searchsorted(b, v, "right")]


def links(x: np.ndarray, y: np.ndarray, threshold: float, seed: int) -> np.ndarray:
    """Which vectors of x link with which of y: those that agree in a table and have the cosine."""
    bits, tables = plan(max(len(x), len(y)), threshold)
    ux, uy = (v / np.abs(v).max(1, keepdims=True) for v in (x, y))
    nx, ny = (np.sqrt((u * u).sum(1)) for u in (ux, uy))
    sx, sy = (signs(u, bits, tables, seed) for u in (ux, uy))
    found = np.zeros((len(x), len(y)), bool)
    for t in range(tables):
        for i, j in alike(sx[:, t], sy[:, t]):
            for s in range(0, len(i), 512):
                k = i[s : s + 512]
                found[np.ix_(k, j)] |= (ux[k] @ uy[j].T) / (nx[k, None] * ny[None, j]) >= threshold
    return found


def first_met(found: np.ndarray, turn: int, left: list[bytes], right: list[bytes]) -> None:
    """Takes away the links of pairs whose signatures agree in a table before this one."""
    i, j = np.flatnonzero(found.any(1)), np.flatnonzero(found.any(0))
    if turn < 1 or not len(i):
        return
    a, b = (np.stack([np.frombuffer(side[k], np.uint64, turn) for k in of]) for side, of in ((left, i), (right, j)))
    new = np.ones((len(i), len(j)), bool)
    for t in range(turn):
        new &= a[:, t, None] != b[None, :, t]
    found[np.ix_(i, j)] &= new


def counted(found: np.ndarray, size_x: np.ndarray, size_y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(links added, place of the component's first, -1 without one) of the classes of both sides, one after the other; of one side if both are the same block."""
    m = len(size_x)
    if same:
        np.fill_diagonal(found, False)
        added, root = found @ size_y, np.full(m, -1)
        met_by = lambda k: found[k].any(0)
    else:
        added, root = np.concatenate([found @ size_y, size_x @ found]), np.full(m + len(size_y), -1)
        met_by = lambda k: np.concatenate([found[:, k[k >= m] - m].any(1), found[k[k < m]].any(0)])
    for start in np.flatnonzero(found.any(1)):
        if root[start] >= 0:
            continue
        front = np.array([start])
        root[start] = start
        while len(front):
            front = np.flatnonzero(met_by(front) & (root < 0))
            root[front] = start
    return added, root


def within_tasks(rows: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(node, added, root) of each class that a task links with any; rows are dealt by task and sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in in_runs(batches, "task"):
            g = g.sort_by("node")
            side, signatures = g.column("side").to_numpy(), g.column("signs").to_pylist()
            node, size = g.column("node").to_numpy(), g.column("size").to_numpy().astype(np.float64)
            # another task may have the same hash: only equal labels, lengths, buckets and pairs of blocks meet
            keys = list(zip(*(g.column(c).to_pylist() for c in ("label", "width", "turn", "bucket", "lo", "hi")), strict=True))
            for key in dict.fromkeys(keys):
                of = np.array([k == key for k in keys])
                same = key[4] == key[5]
                left, right = np.flatnonzero(of & (side != 1)), np.flatnonzero(of & (side != 0))
                if not len(left) or not len(right) or (same and len(left) < 2):
                    continue
                data = g.column("data")
                x = np.stack([np.frombuffer(data[int(i)].as_buffer(), kind) for i in left]).astype(np.float64)
                y = x if same else np.stack([np.frombuffer(data[int(i)].as_buffer(), kind) for i in right]).astype(np.float64)
                found = links(x, y, threshold, key[2] + 1)
                first_met(found, key[2], [signatures[i] for i in left], [signatures[i] for i in right])
                added, root = counted(found, size[left], size[right], same)
                nodes = node[left] if same else np.concatenate([node[left], node[right]])
                on = added > 0
                if on.any():
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[on], pa.int64()), pa.array(np.rint(added[on]), pa.float64()).cast(pa.int64()), pa.array(nodes[root[on]], pa.int64())], ["node", "added", "root"])

    n = partitions_for(rows.sparkSession)
    return rows.repartition(n, "task").sortWithinPartitions("task").mapInArrow(run, "node long, added long, root long")


def dealt(rows: DataFrame, bits_of: dict[int, tuple[int, int]], kind: str) -> DataFrame:
    """A row for each class of a large label and each of its label's tables: the bucket, and the signatures in all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                kinds = list(zip(b.column("width").to_pylist(), b.column("step").to_pylist(), strict=True))
                for width, step in dict.fromkeys(kinds):
                    part = b.filter(pa.array([k == (width, step) for k in kinds]))
                    bits, tables = bits_of[step]
                    x = np.stack([np.frombuffer(v.as_buffer(), kind) for v in part.column("data")]).astype(np.float64)
                    found = signs(x / np.abs(x).max(1, keepdims=True), bits, tables)
                    packed = pa.array([s.tobytes() for s in found], pa.binary())
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("label", "width", "node", "size", "data")), pa.array([t] * part.num_rows, pa.int32()), pa.array(found[:, t].astype(np.int64)), packed], ["label", "width", "node", "size", "data", "turn", "bucket", "signs"])

    return rows.select("label", "width", "node", "size", "data", "step").mapInArrow(run, "label long, width int, node long, size long, data binary, turn int, bucket long, signs binary")


def in_pairs(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (label, width, turn, bucket, ...) once for each pair of blocks that theirs is part of, with the task that the pair is; blocks has the numbers of blocks above one."""
    by = ["label", "width", "turn", "bucket"]
    n = F.coalesce("blocks", F.lit(1))
    rows = rows.join(blocks, by, "left").withColumn("block", F.pmod(F.xxhash64("node"), n).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    side = F.when(F.col("lo") == F.col("hi"), 2).when(F.col("block") == F.col("lo"), 0).otherwise(1)
    return rows.withColumn("side", side.cast("int")).withColumn("task", F.xxhash64(*by, "lo", "hi")).drop("blocks", "block", "other")


def blocks_of(counts: DataFrame, block: int) -> DataFrame:
    return counts.where(F.col("c") > block).select("label", "width", "turn", "bucket", F.ceil(F.col("c") / block).cast("int").alias("blocks"))


def near_duplicates(spark: SparkSession, rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of rows (vec_id, embedding, label)."""
    ship(spark)
    scratch = Scratch(spark, "vectors")
    kind = number_kind(rows)
    base = checked(rows)
    classes = base.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("data").alias("data"))
    classes = scratch.put(classes.withColumn("node", F.xxhash64("key")).withColumn("width", F.octet_length("data")), "classes")
    # small tables are stored first, so that Spark knows their size and moves no vector for a join with them
    counts = scratch.put(classes.groupBy("label", "width").agg(F.count("*").alias("c")).withColumn("turn", F.lit(-1)).withColumn("bucket", F.lit(0).cast("long")), "counts")
    small = scratch.put(blocks_of(counts.where(F.col("c") <= BLOCK * MOST_BLOCKS), BLOCK), "blocks")
    large = scratch.put(counts.where(F.col("c") > BLOCK * MOST_BLOCKS).select("label", "width", F.ceil(F.log2(F.col("c") / BUCKET)).cast("int").alias("step")), "large")
    steps = [r["step"] for r in large.select("step").distinct().collect()]  # no more than the bits of a count
    all_ = classes.select("label", "width", "node", "size", "data")
    whole = all_.join(large, ["label", "width"], "left_anti") if steps else all_
    found = within_tasks(in_pairs(whole.withColumns({"turn": F.lit(-1), "bucket": F.lit(0).cast("long"), "signs": F.lit(None).cast("binary")}), small), threshold, kind)
    if steps:
        bits_of = {s: plan(BUCKET << s, threshold, BUCKET) for s in steps}
        buckets = dealt(all_.join(large, ["label", "width"]), bits_of, kind)
        cut = scratch.put(blocks_of(buckets.groupBy("label", "width", "turn", "bucket").agg(F.count("*").alias("c")), BLOCK), "buckets")
        found = found.unionByName(within_tasks(in_pairs(buckets, cut), threshold, kind))
    found = scratch.put(found, "found")
    linked = scratch.put(found.groupBy("node").agg(F.sum("added").alias("added")), "linked")
    labels = scratch.put(connected_components(spark, found.select(F.col("node").alias("u"), F.col("root").alias("v")), scratch), "labels")
    per_class = classes.select("key", "node", "first", "size").join(linked, "node", "left").join(labels, "node", "left")
    per_class = scratch.put(per_class.select("key", "first", (F.col("size") - 1 + F.coalesce("added", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("root")), "per_class")
    # stored, so that both sides of the join come straight from a shuffle and Spark can split a large component
    roots = scratch.put(per_class.groupBy("root").agg(F.min("first").alias("component_id")), "roots")
    named = scratch.put(per_class.join(roots, "root").select("key", "n_links", "component_id"), "named")
    out = checked(rows).select("vec_id", "key").join(named, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = scratch.put(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "result")
    scratch.only(out)
    return out


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))
