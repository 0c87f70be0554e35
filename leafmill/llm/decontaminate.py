"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are brought to lower-case words with one space between, before and after; so an item is not met
inside of other words. An item of m characters may be met with k = m // BUDGET edits; cut into k + 1 pieces, one piece at
least must be met exactly. One automaton finds all pieces of a block of items; each hit's window is verified with Myers'
bit-parallel distance. A block of items goes over all documents once. Where there are more, each block hands on only the
texts that meet some of it, by a hash of the text, and the documents are joined with these at the end.

Results for odd rows: a null or empty text meets nothing; an item without a word is met by nothing; items of equal text
(ties) are both reported, a null item_id first; items that share an id are reported once, with the least distance; very
long texts are searched whole; a null doc_id stays null; repeated rows give one row each; an empty table on either side
gives rows without items; columns besides doc_id and text, item_id and text are not read, whatever their names.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import SLICE_BYTES, Scratch, free_names, ship, table, text_slices

#: One edit is allowed for so many characters of an item.
BUDGET = 16
#: Characters of items in a block; each block is broadcast by itself and goes over all documents once.
BLOCK_CHARS = 1_000_000

_WORDS = re.compile(r"[^\W_]+")


def plain(text: str | None) -> str:
    """The words of a text with a space between, before and after; empty without any."""
    words = _WORDS.findall(text.lower()) if text else []
    return f" {' '.join(words)} " if words else ""


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def masks_of(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def least_distance(m: int, masks: dict[str, int], text: str, most: int) -> int:
    """The least edit distance of a pattern of m characters to any substring of text; most + 1 if it is more than that."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, min(m, most + 1)
    for left, c in zip(range(len(text) - 1, -1, -1), text, strict=True):
        eq = masks.get(c, 0)
        x = eq | down
        d0 = ((((eq & up) + up) ^ up) | x) & full
        h_up = (down | ~(d0 | up)) & full
        h_down = up & d0
        if h_up & top:
            score += 1
        elif h_down & top:
            score -= 1
        h_up = (h_up << 1) & full  # a match may begin anywhere: the first row is all zero
        h_down = (h_down << 1) & full
        up = (h_down | ~(d0 | h_up)) & full
        down = h_up & d0
        if score < best:
            best = score
            if not best:
                return 0
        if score - left > best:
            break  # each further character lowers the score by one at most
    return best


class Items:
    """A block of items, ready to be looked for."""

    def __init__(self, items: list[tuple[int | None, str]], budget: int = BUDGET):
        by_text: dict[str, list[int]] = {}
        for key, text in items:
            if norm := plain(text):
                by_text.setdefault(norm, []).append(key)
        self.items = [(norm, keys, (len(norm) - 2) // budget, masks_of(norm)) for norm, keys in by_text.items()]
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (norm, _, k, _) in enumerate(self.items):
            for offset, piece in pieces(norm, k):
                at.setdefault(piece, []).append((i, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, tuple(where))
        if at:
            self.automaton.make_automaton()
        self.empty = not at

    def met_by(self, text: str) -> dict[int, int]:
        """Item id -> least distance, of the items that the (plain) text meets within their budgets."""
        if self.empty or not text:
            return {}
        windows: dict[int, set[int]] = {}
        for end, where in self.automaton.iter(text):
            for i, offset in where:
                windows.setdefault(i, set()).add(end + 1 - offset)
        met: dict[int, int] = {}
        for i, begins in windows.items():
            norm, keys, k, masks = self.items[i]
            if norm in text:
                best = 0
            else:
                best, done = k + 1, -1
                for begin in sorted(begins):
                    # windows that overlap are looked at as one
                    if begin + len(norm) + k <= done:
                        continue
                    done = begin + len(norm) + 2 * k
                    best = min(best, least_distance(len(norm), masks, text[max(0, begin - k) : done + k], k))
                    if not best:
                        break
            if best <= k:
                met |= {key: min(best, met.get(key, best)) for key in keys}
        return met


def blocks_of(items: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of a bounded size."""
    block, held = [], 0
    for r in items.select("item_id", "text").where("text is not null").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        held += len(r["text"])
        if held >= chars:
            yield block
            block, held = [], 0
    if block:
        yield block


_ready: dict[int, Items] = {}


def items_for(shared) -> Items:
    """A worker's items of a broadcast; those of the one before it leave."""
    if shared.id not in _ready:
        _ready.clear()
        _ready[shared.id] = Items(shared.value)
    return _ready[shared.id]


class Block:
    """A block of items sent to the executors."""

    def __init__(self, spark: SparkSession, items: list[tuple[int, str]]):
        self.sent, self.id = spark.sparkContext.broadcast(items), random.getrandbits(63)

    def __getstate__(self):
        return self.sent, self.id

    def __setstate__(self, state):
        self.sent, self.id = state

    @property
    def value(self) -> list[tuple[int, str]]:
        return self.sent.value


def meeting(rows: DataFrame, block: Block, names: tuple[str, str], all_rows: bool) -> DataFrame:
    """Rows (with a text) and the items of the block that each meets, with the distances; all rows or those that meet any."""
    given = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = items_for(block)
        for b in (part for whole in batches for part in text_slices(whole, SLICE_BYTES)):
            found = [sorted(ready.met_by(plain(t)).items(), key=lambda f: (f[0] is not None, f[0])) for t in b.column("text").to_pylist()]
            if not all_rows:
                b = b.filter(pa.array([bool(f) for f in found], pa.bool_()))
                found = [f for f in found if f]
            ids, ds = pa.array([[k for k, _ in f] for f in found], pa.list_(pa.int64())), pa.array([[d for _, d in f] for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids, ds], [*given, *names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(names[0], T.ArrayType(T.LongType())), T.StructField(names[1], T.ArrayType(T.IntegerType()))]))


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS, names: tuple[str, str] = ("__items", "__distances")) -> DataFrame:
    """The rows of docs with the list of items that each meets (ids, ascending) and the distances of these, under names."""
    ship(spark)
    blocks = blocks_of(items, block_chars)
    now, after = next(blocks, []), next(blocks, None)
    if after is None:
        return meeting(docs, Block(spark, now), names, all_rows=True)
    scratch, met, id_, distance = Scratch(spark, "benchmark"), [], "item", "distance"
    while now:
        block = Block(spark, now)
        rows = meeting(docs.select("text").where("text is not null"), block, (id_, distance), all_rows=False)
        met.append(scratch.put(rows.select(F.xxhash64("text").alias("a"), F.xxhash64(F.reverse("text"), F.lit(1)).alias("b"), F.explode(F.arrays_zip(id_, distance)).alias("m")), "met"))
        block.sent.destroy()
        now, after = after, next(blocks, None)
    each = reduce(DataFrame.unionByName, met).groupBy("a", "b", F.col(f"m.{id_}").alias(id_)).agg(F.min(f"m.{distance}").alias(distance))
    found = scratch.put(each.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct(id_, distance))).alias("m")), "found")
    scratch.only(found)
    a, b, m = free_names([*docs.columns, *names], "__a", "__b", "__m")
    out = docs.withColumns({a: F.xxhash64("text"), b: F.xxhash64(F.reverse("text"), F.lit(1))}).join(found.toDF(a, b, m), [a, b], "left")
    m = F.when(F.col("text").isNotNull(), F.col(m))
    return out.select(*docs.columns, F.coalesce(m[id_], F.array().cast("array<long>")).alias(names[0]), F.coalesce(m[distance], F.array().cast("array<int>")).alias(names[1]))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending), least_edits (null without items)."""
    met = contamination(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return met.select("doc_id", (F.size("__items") > 0).alias("contaminated"), F.size("__items").cast("long").alias("n_items"), F.col("__items").alias("item_ids"), F.array_min("__distances").alias("least_edits"))
