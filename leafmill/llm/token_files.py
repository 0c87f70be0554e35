"""Token ids written as canonical length-limited Huffman code, and read back.

Texts are cut into words and each distinct word is encoded once by the tokenizers library's model of the file; a text's
ids are those of its words and of the added tokens between them. Global id counts give one code. Documents, in ascending doc_id order
over range partitions, go to one file a partition, in segments whose blocks of ids can each be decoded from their own
bit offset. Files are written by Spark's committer to any store, and need no more memory than a segment to write.

Results for odd rows: a null text has no ids but the end id; documents with equal ids follow each other, by their ids'
hash (ties); a null doc_id comes first and stays null; very long texts are one document of a segment of their own size, and
very long words are not kept; repeated rows are documents each; an empty table gives no rows; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import SLICE_BYTES, Scratch, joined, partitions_for, ship, table, text_slices, without_shuffles
from leafmill.llm.huffman import END, Code, read_segments, write_segment
from leafmill.llm.pretoken import ByteBpe, shown_bytes, words_of

#: Words kept in a worker's table, and the longest of them.
TABLE_WORDS, KEPT_CHARS = 500_000, 64
#: Ids of a segment, of a file (about 45 MB of code), and of a block that is decoded on its own.
SEGMENT_IDS, FILE_IDS, BLOCK_IDS = 1_000_000, 32_000_000, 512

_encoders: dict[int, Encoder] = {}


class Encoder:
    def __init__(self, raw: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.bpe, self.library = ByteBpe(raw), Tokenizer.from_str(raw.decode())
        if sys.byteorder != "little":
            raise OSError("ids are written in little-endian order")
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.model, self.code = self.library.model, "HI"[self.kind == "<u4"]
        self.shown = shown_bytes()
        self.space = self.shown[0x20]
        self.table: dict[str, bytes] = {}

    def symbols(self, word: str) -> str:
        """A word as the vocabulary writes its bytes."""
        if word.isascii() and word.isprintable():
            return word.replace(" ", self.space)
        return word.encode().decode("latin-1").translate(self.shown)

    def ids(self, text: str, end: int) -> bytes:
        """The text's ids and the end id, each of self.kind."""
        known, parts = self.table, []
        for part, special in self.bpe.plain(text):
            if part is None:
                parts.append(np.array([special], self.kind).tobytes())
                continue
            for words in words_of(part):
                try:
                    parts.append(b"".join(map(known.__getitem__, words)))
                except KeyError:
                    used = set(words)
                    new = list(used.difference(known))
                    if len(known) > TABLE_WORDS:
                        # the words met first are the common ones
                        known = self.table = dict(islice(known.items(), TABLE_WORDS // 4))
                        new = list(used.difference(known))
                    for w in new:
                        known[w] = array(self.code, [t.id for t in self.model.tokenize(self.symbols(w))]).tobytes()
                    parts.append(b"".join(map(known.__getitem__, words)))
                    for w in new:
                        if len(w) > KEPT_CHARS:
                            del known[w]
        parts.append(np.array([end], self.kind).tobytes())
        return b"".join(parts)


def encoder_for(raw: bytes) -> Encoder:
    key = hash(raw)
    if key not in _encoders:
        _encoders[key] = Encoder(raw)
    return _encoders[key]


def encode(spark: SparkSession, docs: DataFrame, vocabulary: str, end: int) -> DataFrame:
    """doc_id and the ids of each row's text, little-endian, 2 bytes each (4 for vocabularies over 65,536)."""
    with open(vocabulary, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder_for(raw.value).ids
        for b in (part for whole in batches for part in text_slices(whole, SLICE_BYTES)):
            # a batch's copies are encoded once
            texts = [t or "" for t in b.column("text").to_pylist()]
            once = {t: ids(t, end) for t in set(texts)}
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(once.__getitem__, texts), pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def id_counts(ids: DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids in use and their counts over all documents; no more rows than the vocabulary has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            c = np.bincount(np.frombuffer(joined(b.column("ids")), kind))
            if len(c) > len(total):
                total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
            total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    rows.sort()
    return np.array([r["id"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)


def write_files(spark: SparkSession, docs: DataFrame, vocabulary: str, path: str, end: int = 0) -> None:
    """Writes path/code (one file) and path/ids (one file for each range of doc_id)."""
    ship(spark)
    scratch = Scratch(spark, "ids")
    with open(vocabulary, "rb") as f:
        kind = encoder_for(f.read()).kind
    ids = scratch.put(encode(spark, docs, vocabulary, end), "ids")
    symbols, counts = id_counts(ids, kind)
    code = Code.of_counts(symbols, counts)
    shared = spark.sparkContext.broadcast(code.encoder())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, parts, held = TaskContext.get().partitionId(), [], [], 0

        def segment() -> pa.RecordBatch:
            sizes = np.array([len(p) for p in parts], np.int64)
            raw = write_segment(part, keys, sizes, np.concatenate(parts), shared.value, BLOCK_IDS)
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["segment"])

        for b in batches:
            for key, x in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                keys.append(key)
                parts.append(np.frombuffer(x.as_buffer(), kind))
                held += len(parts[-1])
                if held >= SEGMENT_IDS:
                    yield segment()
                    keys, parts, held = [], [], 0
        if keys:
            yield segment()

    n = max(partitions_for(spark), -(-int(counts.sum()) // FILE_IDS))
    key = F.xxhash64("ids").alias("h")
    rows = ids.select("doc_id", "ids", key).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "ids")
    segments = rows.select("doc_id", "ids").mapInArrow(run, "segment binary")
    # as text without a change of bytes: Spark's own committer then writes plain files to any store
    with without_shuffles(spark):
        segments.select(F.col("segment").cast("string").alias("value")).write.option("lineSep", END).text(f"{path}/ids")
    spark.createDataFrame([(code.to_bytes(),)], "value binary").select(F.col("value").cast("string")).coalesce(1).write.option("lineSep", END).text(f"{path}/code")
    scratch.drop(ids)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    ship(spark)
    code_file = spark.read.format("binaryFile").load(f"{path}/code").where("length > 0").select("content").collect()
    code = spark.sparkContext.broadcast(bytes(code_file[0][0]))
    files = spark.read.format("binaryFile").load(f"{path}/ids").select("content")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("content"):
                got = list(read_segments(x.as_buffer().to_pybytes(), None))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([got[0][0]], pa.int64()), pa.array([sum(n for _, n in got)], pa.int64())], ["part", "n"])

    # a row for each file
    sizes, base, at = sorted(map(tuple, files.mapInArrow(totals, "part long, n long").collect())), {}, 0
    for part, n in sizes:
        base[part] = at
        at += n
    first = spark.sparkContext.broadcast(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Code.from_bytes(code.value)
        for b in batches:
            for x in b.column("content"):
                at = None
                for part, keys, counts, ids in read_segments(x.as_buffer().to_pybytes(), known):
                    at = first.value[part] if at is None else at
                    ends = np.cumsum(counts)
                    plain = memoryview(ids.astype("<u4").tobytes())
                    crcs = [zlib.crc32(plain[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(at + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    at += int(ends[-1])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-files").path("documents")
    write_files(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_files(spark, path)
