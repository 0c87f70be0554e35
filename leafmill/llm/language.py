"""Language identification by the nearest of several centroids a language.

Letters are lower-cased, all else is a gap; a text's one- to three-letter strings (gaps included) are hashed, their
counts damped and weighted by inverse document frequency, and the vector is brought to length one. Each language's
sample vectors are clustered on the sphere; a text gets the language of the centroid of the greatest cosine. A text
that lies farther from that centroid than the centroid's own sample did is marked as rejected.

Document frequencies cover all training rows; centroids come from a bounded sample of them.

Results for odd rows: a null text or one without a letter is `und` with score 0, rejected; so is every text where nothing
could be learned; equal cosines (ties) go to the language first by name; very long texts are taken whole; of rows that
share a language and an id in the sample, that of the least vector is clustered; a null doc_id is one id like any other;
repeated rows give one row each; an empty table gives an empty table; columns besides doc_id, text and lang are not read,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import SLICE_BYTES, Scratch, crc_mod, ship, table, text_slices

BUCKETS = 1 << 13
#: The sample that is clustered: so many rows a language, the first by hash of their id.
SAMPLE_ROWS = 300
CENTROIDS, ROUNDS = 4, 12
#: A text is rejected below this share of the least cosine in its centroid's sample.
SLACK = 0.75
#: A text is counted so many characters at a time, and to the end of the word.
AT_ONCE = 1 << 20

_LETTER, _GAP = regex.compile(r"\p{L}"), re.compile(r"[\x00-\x40\x5b-\x60\x7b-\x7f]")
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def counts_of(text: str) -> np.ndarray:
    """How often each bucket's strings occur."""
    total, at, tail = np.zeros(BUCKETS, np.int64), 0, ""
    while at < len(text):
        end = at + AT_ONCE
        end = m.end() if end < len(text) and (m := _GAP.search(text, end)) else len(text)
        # the strings over the border are those of the last word and what follows, less those of the last word
        total += _counts(tail + text[at:end]) - (_counts(tail) if tail else 0)
        last = end
        while last > at and not text[last - 1].isalpha():
            last -= 1
        if last > at:  # the last word; what stands behind it is one gap
            word = last - 1
            while word > at and not _GAP.match(text, word - 1):
                word -= 1
            tail = text[word:last] + " "
        at = end
    return total


def _counts(text: str) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.where(letters()[cp], cp, np.uint32(32))
    cp = cp[np.concatenate([[True], (cp[1:] != 32) | (cp[:-1] != 32)])]
    down, mix = np.uint32(32 - 13), np.uint32(0x9E3779B1)
    two = cp[:-1] * np.uint32(0x01000193) + cp[1:]
    three = two[:-1] * np.uint32(0x01000193) + cp[2:]
    one = cp[cp != 32]
    for h, salt in ((one, 0x3C6EF372), (two, 0x1B873593), (three, 0x27D4EB2F)):
        h = (h + np.uint32(salt)) * mix
        total += np.bincount(((h ^ (h >> np.uint32(15))) * mix) >> down, minlength=BUCKETS)
    return total


def vector_of(text: str, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts_of(text).astype(np.float32)) * idf
    n = float(np.sqrt(v @ v))
    return v / n if n else v


def clusters(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids of length one, the least cosine of each one's members): farthest-first start, then spherical k-means."""
    mean = vectors.mean(0)
    chosen = [int(np.argmax(vectors @ mean))]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(np.argmin((vectors @ vectors[chosen].T).max(1))))
    centres = vectors[chosen]
    for _ in range(ROUNDS):
        best = np.argmax(vectors @ centres.T, 1)
        new = np.stack([vectors[best == c].sum(0) if (best == c).any() else centres[c] for c in range(len(centres))])
        centres = (new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    cosines = vectors @ centres.T
    best = np.argmax(cosines, 1)
    return centres, np.array([cosines[best == c, c].min(initial=1.0) for c in range(len(centres))])


class Model:
    """Inverse document frequencies, and the languages' centroids in order of language."""

    def __init__(self, idf: np.ndarray, langs: list[str], centres: np.ndarray, least: np.ndarray):
        self.idf, self.langs, self.centres, self.least = idf, langs, centres, least

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0, True
        cosines = self.centres @ vector_of(text, self.idf)
        best = int(np.argmax(cosines))
        cosine = float(cosines[best])
        return self.langs[best], min(1.0, max(0.0, cosine)), cosine < SLACK * self.least[best]


def fit(spark: SparkSession, docs: DataFrame) -> Model:
    """Learns from docs (doc_id, text, lang); rows without a text or lang teach nothing."""
    ship(spark)
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS + 1, np.int64)
        for b in (part for whole in batches for part in text_slices(whole, SLICE_BYTES)):
            for t in b.column("text").to_pylist():
                seen[:BUCKETS] += counts_of(t) > 0
                seen[BUCKETS] += 1
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(seen[used], pa.int64())], ["bucket", "n"])

    seen = np.zeros(BUCKETS + 1, np.int64)
    for r in known.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        seen[r["bucket"]] = r["n"]
    idf = (np.log((1 + seen[BUCKETS]) / (1 + seen[:BUCKETS])) + 1).astype(np.float32)
    shared = spark.sparkContext.broadcast(idf)

    scratch = Scratch(spark, "languages")
    counts = scratch.put(known.groupBy("lang").agg(F.count("*").alias("n")), "counts")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    first = Window.partitionBy("lang").orderBy(place, "doc_id")
    # ids beyond twice the share that is wanted are not ranked
    low = known.select("lang", "doc_id").join(counts, "lang").where((F.col("n") <= 4 * SAMPLE_ROWS) | (place < F.lit(1 << 30) * (2 * SAMPLE_ROWS / F.col("n"))))
    ids = low.withColumn("place", F.dense_rank().over(first)).where(F.col("place") <= SAMPLE_ROWS).select("lang", "doc_id").distinct()
    # at most SAMPLE_ROWS ids a language
    sample = known.alias("k").join(F.broadcast(ids).alias("i"), F.expr("k.lang = i.lang and k.doc_id <=> i.doc_id"), "left_semi")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in text_slices(whole, SLICE_BYTES)):
            rows = [vector_of(t, shared.value).astype(np.float16).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(rows, pa.binary())], ["doc_id", "lang", "vector"])

    def centroids(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "vector"])
        v = np.stack([np.frombuffer(x, np.float16) for x in rows["vector"]]).astype(np.float32)
        centres, least = clusters(v[v.any(1)], CENTROIDS) if v.any() else (np.zeros((0, BUCKETS), np.float32), np.zeros(0))
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "place": range(len(centres)), "centre": [c.astype(np.float32).tobytes() for c in centres], "least": least})

    one = sample.mapInArrow(vectors, "doc_id long, lang string, vector binary").groupBy("lang", "doc_id").agg(F.min("vector").alias("vector"))
    found = one.groupBy("lang").applyInPandas(centroids, "lang string, place long, centre binary, least double").collect()
    scratch.only()
    found.sort(key=lambda r: (r["lang"], r["place"]))
    centres = np.stack([np.frombuffer(r["centre"], np.float32) for r in found]) if found else np.zeros((0, BUCKETS), np.float32)
    return Model(idf, [r["lang"] for r in found], centres, np.array([r["least"] for r in found]))


def identify(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the cosine) and rejected of each row of docs (doc_id, text)."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in text_slices(whole, SLICE_BYTES)):
            got = [shared.value.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([bool(g[2]) for g in got], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(spark, docs.where(crc_mod("doc_id", 4) != 2))
    found = identify(spark, docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
