"""Quality classifier: supervised subword embeddings.

A text's features are its character trigrams, its words and its pairs of adjacent words, hashed into one table of
learned vectors; a pair of equal words is the same feature whatever the word. The vectors are averaged over the text,
each of the three kinds by itself and then over the kinds (so that the many trigrams do not drown the pairs), and a
softmax layer gives the two labels' shares. Training is numpy stochastic gradient descent (with per-weight step
sizes) on a bounded sample of labelled rows; the label shares of all labelled rows set the prior. As everything after
the look-up is linear up to the softmax, scoring folds the output layer into the table: one number a feature.

Results for odd rows: a null or empty text has no features and gets the prior; very long texts are scored whole; ties: of
rows that share a sampled id the one of the least features trains, and rows labelled more than once train with their
least label; a null doc_id is scored, and teaches nothing; repeated rows give one row each; without labels of both kinds every score is the share of label 1
(1 without any label); an empty table gives an empty table; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import SLICE_BYTES, Scratch, crc_mod, ship, table, text_slices

BITS = 16
DIM = 8
#: The training sample: so many rows of each label, the first by hash of their id, and of these the first whose features take so many bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 2_500, 64_000_000
EPOCHS, RATE = 6, 0.25
#: Features of one text are looked up so many characters at a time, and to the end of the word.
AT_ONCE = 1 << 20

#: The feature of two equal words in a row, whatever the word; hashed features may share it, as any two may share one.
_REPEAT = 0
_GAP = re.compile("[\x00-\x20]")
_POWERS = np.cumprod(np.full(64, 0x9E3779B1, np.uint32), dtype=np.uint32)


def features(text: str) -> list[np.ndarray]:
    """Table rows of a text's trigrams, words and pairs of words."""
    none = np.zeros(0, np.int64)
    if not text:
        return [none, none, none]
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    down, mix = np.uint32(32 - BITS), np.uint32(0x85EBCA6B)
    out = [none, none, none]
    if len(cp) > 2:
        h = cp[:-2] * np.uint32(0x01000193) + cp[1:-1] * np.uint32(0xC2B2AE35) + cp[2:] * np.uint32(0x27D4EB2F)
        out[0] = ((h ^ (h >> np.uint32(15))) * mix) >> down
    ink = np.concatenate([[False], cp > 32, [False]])
    edges = np.flatnonzero(ink[1:] != ink[:-1])
    starts, ends = edges[::2], edges[1::2]
    if len(starts):
        sizes = ends - starts
        heads = np.cumsum(sizes) - sizes
        letters = cp[cp > 32]
        place = np.arange(len(letters)) - np.repeat(heads, sizes)
        words = np.add.reduceat((letters ^ np.uint32(0x5BD1E995)) * _POWERS[place & 63], heads, dtype=np.uint32)
        words = (words ^ (words >> np.uint32(13))) * mix
        out[1] = words >> down
        if len(words) > 1:
            pairs = (words[:-1] * np.uint32(0xCC9E2D51) + words[1:] * np.uint32(0x1B873593)) >> down
            pairs[words[:-1] == words[1:]] = _REPEAT
            out[2] = pairs
    return [x.astype(np.int64) for x in out]


def stretches(text: str) -> Iterator[tuple[int, str]]:
    """(sign, stretch): the features of a text are those of the stretches, taken away where the sign is -1. A stretch begins with the last word of the one before, whose own features are taken away once."""
    at, tail, word = 0, "", ""
    while at < len(text):
        end = at + AT_ONCE
        end = m.end() if end < len(text) and (m := _GAP.search(text, end)) else len(text)
        if tail:
            yield -1, tail
        yield 1, tail + text[at:end]
        last = end
        while last > at and ord(text[last - 1]) <= 32:
            last -= 1
        if last > at:
            start = last - 1
            while start > at and ord(text[start - 1]) > 32:
                start -= 1
            word = text[start:last]
        tail = word + text[max(last, end - 2) : end]  # enough for a pair of words and for trigrams
        at = end


def shares_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Table rows that a text uses and the share of each in its vector."""
    counts = np.zeros((3, 1 << BITS), np.int64)
    for sign, part in stretches(text or ""):
        for k, rows in enumerate(features(part)):
            counts[k] += sign * np.bincount(rows, minlength=1 << BITS)
    there = [c / c.sum() for c in counts if c.any()]
    shares = sum(there) / max(1, len(there)) if there else counts[0]
    ids = np.flatnonzero(shares)
    return ids, shares[ids].astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """(a logit share for each table row, the offset of the sample) from numpy gradient descent, one text (its table rows and their shares) at a time."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    top, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    g_vectors, g_top, g_bias = np.full((1 << BITS, 1), 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    for epoch in range(EPOCHS):
        step = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            hidden = share @ vectors[ids]
            z = hidden @ top + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            d_hidden = top @ p
            d_top = np.outer(hidden, p)
            g_top += d_top**2
            top -= step * d_top / np.sqrt(g_top)
            g_bias += p**2
            bias -= step * p / np.sqrt(g_bias)
            g_vectors[ids, 0] += share**2 * float(d_hidden @ d_hidden)
            vectors[ids] -= step * (share[:, None] / np.sqrt(g_vectors[ids])) * d_hidden
    return vectors @ (top[:, 1] - top[:, 0]), float(bias[1] - bias[0])


def sample(spark: SparkSession, docs: DataFrame, known: DataFrame, counts: dict[int, int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, table rows, shares) of the training sample, given the rows of each label."""
    ship(spark)
    scratch = Scratch(spark, "labels")
    place = F.row_number().over(Window.partitionBy("quality").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id"))
    # ids beyond twice the share that is wanted cannot be among the first, but where most labels have no document
    wanted = F.create_map(*[F.lit(x) for q, n in counts.items() for x in (q, min(1.0, 2 * SAMPLE_ROWS / n))])[F.col("quality")]
    low = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < wanted * (1 << 30))
    there = low.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("place", place).where(F.col("place") <= SAMPLE_ROWS)
    ids = scratch.put(there, "sampled")

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in text_slices(whole, SLICE_BYTES)):
            found = [shares_of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("quality").cast(pa.int32()), b.column("place").cast(pa.int32()), *(pa.array([x.astype(kind).tobytes() for x in side], pa.binary()) for kind, side in (("<u4", [i for i, _ in found]), ("<f4", [w for _, w in found])))], ["quality", "place", "ids", "shares"])

    # at most twice SAMPLE_ROWS ids; their texts are met in one pass over the documents
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id", "quality", "place")), "doc_id").select("text", "quality", "place")
    rows = chosen.mapInArrow(shares, "quality int, place int, ids binary, shares binary")
    rows = scratch.put(rows.groupBy("quality", "place").agg(F.min(F.struct("ids", "shares")).alias("x")), "features")
    taken, out = {0: 0, 1: 0}, []
    for r in rows.orderBy("place", "quality").toLocalIterator():
        taken[r["quality"]] += len(r["x"]["ids"]) + len(r["x"]["shares"])
        if taken[r["quality"]] <= SAMPLE_BYTES:
            out.append((r["quality"], np.frombuffer(r["x"]["ids"], "<u4").astype(np.int64), np.frombuffer(r["x"]["shares"], "<f4")))
    scratch.only()
    return out


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> tuple[np.ndarray, float]:
    """Learns from the rows of labels whose id is outside the held fold."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", folds) != held))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    shares = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return np.zeros(1 << BITS, np.float32), 40.0 if shares.get(1, 1) else -40.0
    got = sample(spark, docs, known, shares)
    n1 = sum(q for q, _, _ in got)
    if not 0 < n1 < len(got):
        return np.zeros(1 << BITS, np.float32), math.log(shares[1] / shares[0])
    table_, bias = train([(ids, w) for _, ids, w in got], [q for q, _, _ in got])
    # the sample holds the labels in other shares than the rows it stands for
    return table_.astype(np.float32), bias + math.log(shares[1] / shares[0]) - math.log(n1 / (len(got) - n1))


def score_of(text: str | None, weights: np.ndarray, bias: float) -> float:
    total, n = np.zeros(3), np.zeros(3)
    for sign, part in stretches(text or ""):
        for k, rows in enumerate(features(part)):
            total[k] += sign * weights[rows].sum(dtype=np.float64)
            n[k] += sign * len(rows)
    there = n > 0
    z = bias + (float((total[there] / n[there]).mean()) if there.any() else 0.0)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def score(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, float], column: str = "score") -> DataFrame:
    """The rows of docs with a column of scores."""
    ship(spark)
    shared, names = spark.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for whole in batches:
            for b in text_slices(whole, SLICE_BYTES):
                scores = [score_of(t, weights, bias) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(spark, docs, table(spark, sf_dir, "labels"))
    scored = score(spark, docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
