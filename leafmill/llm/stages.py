"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns the documents that it keeps.

All but the last return the columns that they were given, whatever other columns there are. No stage drops a row for want
of a doc_id. The last adds columns; where docs has one of such a name already, that stays and the new one gets `_` behind
its name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, ngram_join, pieces, quality, secrets
from leafmill.llm.common import Scratch, free_names, table

#: Least quality score of a document that stays.
QUALITY = 0.3


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of those at hand, does not reject."""
    model = quality.fit(spark, docs, table(spark, sf_dir, "labels"))
    (score,) = free_names(docs.columns, "__score")
    return quality.score(spark, docs, model, score).where(F.col(score) >= QUALITY).drop(score)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, of the least id (a null one after all others); rows without words are no copies."""
    scratch = Scratch(spark, "near")
    names = docs.columns
    key, rows = free_names(names, "__key", "__rows")
    # ids may be null or repeated: id and text together are a row's key, and rows of one key are copies
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "text"))
    found = ngram_join.components(spark, keyed.select(F.col(key).alias("doc_id"), "text")).withColumnRenamed("doc_id", key)
    # stored, as are all tables that are joined by a key that many rows may have: Spark then splits such a key
    keys = scratch.put(found.where("n_shingles > 0").groupBy(key).agg(F.first("component_id").alias("group"), F.count("*").alias(rows)), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key, rows)).alias("first")
    kept = keyed.select(key, "doc_id").join(keys, key).groupBy("group").agg(first).select(f"first.{key}", f"first.{rows}")
    kept = scratch.put(kept.unionByName(found.where("n_shingles = 0").select(key).distinct().withColumn(rows, F.lit(1).cast("long"))), "kept")
    scratch.only(kept)
    # the keys that stay grow with the input, so they are never broadcast: texts move once, whatever the size
    out = keyed.join(kept.hint("merge"), key)
    if kept.where(F.col(rows) > 1).limit(1).count():
        return out.where(F.col(rows) == 1).select(*names).unionByName(out.where(F.col(rows) > 1).dropDuplicates([key]).select(*names))
    return out.select(*names)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    items, distances = free_names(docs.columns, "__items", "__distances")
    met = decontaminate.contamination(spark, docs, table(spark, sf_dir, "benchmark"), names=(items, distances))
    return met.where(F.size(items) == 0).drop(items, distances)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    return secrets.redacted(spark, docs)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the ids of their pieces (4 bytes each, little-endian), how many these are, and whether decoding gives the text back."""
    ids, n, same = free_names(docs.columns, "piece_ids", "n_pieces", "round_trip")
    found = pieces.encoded(spark, docs, public_tokenizers.path("piece_bpe_32k.model"), ids, same)
    return found.withColumn(n, (F.octet_length(ids) / 4).cast("long"))
