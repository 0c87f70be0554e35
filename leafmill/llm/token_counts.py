"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a linked list; a heap holds the adjacent pairs that can merge, lowest rank first, then leftmost.
Each pop merges one pair; the count is the symbols less the merges. No ids are made. Words that a Python worker has
met before come from a bounded table.

Results for odd rows: a null text counts as empty (0 bytes, 0 tokens); very long texts are cut a number of words at a time
and very long words are not kept; pairs of one rank (ties) merge from the left; a null doc_id stays null; repeated rows give one row each; an empty table
gives an empty table; columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import SLICE_BYTES, ship, table, text_slices
from leafmill.llm.pretoken import ByteBpe, words_of

#: Words kept in a worker's table; it is emptied when full. Longer words are not kept.
TABLE_WORDS, KEPT_CHARS = 600_000, 64

_counters: dict[int, Counter] = {}


class Counter:
    def __init__(self, raw: bytes):
        self.bpe, self.table = ByteBpe(raw), {}

    def word(self, word: str) -> int:
        """Tokens of one word."""
        symbol, pairs = self.bpe.symbol, self.bpe.pairs
        at = [symbol[b] for b in word.encode()]
        n = left = len(at)
        if n == 1:
            return 1
        heap = [(*found, i) for i in range(n - 1) if (found := pairs.get((at[i], at[i + 1])))]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, made, i = heappop(heap)
            j = after[i]
            # a pair that has changed since it was pushed no longer has this rank and result
            if at[i] < 0 or j >= n or pairs.get((at[i], at[j])) != (rank, made):
                continue
            at[i], at[j], after[i] = made, -1, after[j]
            left -= 1
            if (k := after[i]) < n:
                before[k] = i
                if found := pairs.get((made, at[k])):
                    heappush(heap, (*found, i))
            if (k := before[i]) >= 0 and (found := pairs.get((at[k], made))):
                heappush(heap, (*found, k))
        return left

    def text(self, text: str) -> int:
        table, total = self.table, 0
        for part, special in self.bpe.plain(text):
            if part is None:
                total += 1
                continue
            for words in words_of(part):
                try:
                    total += sum(map(table.__getitem__, words))
                except KeyError:
                    if len(table) > TABLE_WORDS:
                        table.clear()
                    new = set(words).difference(table)
                    for w in new:
                        table[w] = self.word(w)
                    total += sum(map(table.__getitem__, words))
                    for w in new:
                        if len(w) > KEPT_CHARS:
                            del table[w]
        return total


def counter_for(raw: bytes) -> Counter:
    """This worker's counter; its table of words outlives a task."""
    key = hash(raw)
    if key not in _counters:
        _counters[key] = Counter(raw)
    return _counters[key]


def count_tokens(spark: SparkSession, docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text)."""
    ship(spark)
    with open(vocabulary, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_for(raw.value).text
        for b in (part for whole in batches for part in text_slices(whole, SLICE_BYTES)):
            texts = b.column("text").to_pylist()
            sizes = [0 if t is None else len(t.encode()) for t in texts]
            counts = [0 if not t else count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
