"""N-gram Jaccard self-join by vertical partitioning.

The n-gram order (rarest first, then by hash) is cut into fragments by hash. Each fragment sees all postings of its
n-grams, so it knows how many texts hold each, and hands back only the shared ones, counted by text. The counts of all
fragments are summed for each text: a text with fewer than three quarters of its n-grams shared can link with nothing
and goes. N-grams that a bounded sample finds in very many texts are known to be shared and stand last in the order, so
their postings go to no fragment: no fragment grows with one n-gram, and there are as many fragments as the n-grams need.

Equal sets are one class from the start. Of the classes left, the n-grams that a link must meet (the prefix of the
order) give the candidates: all classes whose prefixes share an n-gram meet in the cluster of the least of them. There
the order is cut once more, into PAIR_FRAGMENTS: the overlaps of the pairs whose sizes allow a link are counted fragment
by fragment, only one fragment's n-grams being held at a time, and summed for each pair. A pair that meets in several
clusters is counted in the one of the least lead. A cluster hands on the number of links of each class (copies weighted)
and what ties it together, never its pairs. Large clusters are cut into parts, and each pair of parts is a task's work.

Results for odd rows: a text without words has no n-grams and is a component of its own; very long texts are taken whole;
repeated rows are links of weight one like any equal texts, and of rows with one least id (ties) each is named by it; a
null doc_id stays null and never names a component; an empty table gives an empty table; columns besides doc_id and text
are not read, whatever their names. Equality of n-grams is that of 48 bits of their hash and its fragment (54 bits and
more), or of all 64 bits for those of the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import Scratch, in_runs, joined, partitions_for, ship, table, text_slices
from leafmill.llm.components import connected_components
from leafmill.llm.shingles import mixed, shingle_set

#: A link needs PART hundredths of the union shared.
PART = 75
#: Texts that are cut into fragments together: so many bytes, so many rows (their places take 16 bits).
SLICE_BYTES, SLICE_ROWS = 6_000_000, 60_000
#: Fragments for each shuffle partition at least, and bytes of postings of one.
SPREAD, FRAGMENT_BYTES = 4, 64_000_000
#: The sample that finds very common n-grams: about so many rows; the n-grams of at least so many of its texts, at most so many of them. Only the way of such postings depends on it, no result.
SAMPLE_ROWS, COMMON, MOST_COMMON = 4_000, 4, 400_000
#: Fragments of the order in which a cluster's overlaps are counted; n-grams, and classes, of a part of a cluster.
PAIR_FRAGMENTS, TASK_GRAMS, TASK_CLASSES = 4, 4_000_000, 64

_MEMBER = np.dtype([("doc_id", "<i8"), ("null", "?"), ("n", "<i8"), ("a", "<u8"), ("b", "<u8"), ("place", "<i4")])
#: In place of a fragment, in the ids of very common n-grams.
_COMMON_FRAGMENT = (1 << 31) - 1
_POSTINGS = "kind int, fragment int, slice long, data binary"


def least_overlap(n):
    """The fewest n-grams that a set of n must share with any other to link."""
    return -(-PART * n // 100)


def shape(docs: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """(fragments that the n-grams need, hashes of very common ones in order), from a sample of the rows."""
    spark = docs.sparkSession
    rows = docs.count()
    share = min(1.0, SAMPLE_ROWS / max(1, rows))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for part in text_slices(b, SLICE_BYTES):
                sets = [shingle_set(t, size) for t in part.column("text").to_pylist() if t]
                found, held = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                n += int(held.sum())
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(held, pa.int64())], ["gram", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64())], ["gram", "n"])

    sample = docs.select("text") if share == 1.0 else docs.select("text").sample(share, 7)
    found = sample.mapInArrow(grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where((F.col("n") >= COMMON) | F.col("gram").isNull())
    got = found.orderBy(F.col("gram").isNotNull(), F.col("n").desc(), "gram").limit(MOST_COMMON + 1).collect()
    total = sum(r["n"] for r in got if r["gram"] is None) / share
    common = np.sort(np.array([r["gram"] for r in got if r["gram"] is not None], np.int64).view(np.uint64))
    return max(SPREAD * partitions_for(spark), math.ceil(8 * total / FRAGMENT_BYTES)), common


def cut(docs: DataFrame, fragments: int, size: int, common: np.ndarray) -> DataFrame:
    """For each slice of texts and fragment one row (kind 1): hash (48 bits) and place in the slice (16) of each n-gram; and a row each of members (kind 0) and of very common n-grams (kind 2), these as `shared_only` gives others."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_id = TaskContext.get().partitionId() << 24
        known = shared.value
        low = np.zeros(1 << 20, bool)
        low[(known & np.uint64(0xFFFFF)).astype(np.int64)] = True
        for b in batches:
            for rows in text_slices(b, SLICE_BYTES, rows=SLICE_ROWS):
                members = np.zeros(rows.num_rows, _MEMBER)
                sets, places = [], {}
                for i, (key, text) in enumerate(zip(rows.column("doc_id").to_pylist(), rows.column("text"), strict=True)):
                    s = shingle_set(text.as_py(), size)
                    a, c = int(mixed(s).sum(dtype=np.uint64)), int(mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                    if len(s) and (a, c) not in places:  # equal sets of a slice are sent once
                        places[a, c] = len(sets)
                        sets.append(s)
                    members[i] = (key or 0, key is None, len(s), a, c, places.get((a, c), -1))
                home = int(mixed(np.array([slice_id], np.uint64))[0] % np.uint64(fragments))
                kinds, frags, data = [0], [home], [members.tobytes()]
                if sets:
                    h = np.concatenate(sets)
                    place = np.repeat(np.arange(len(sets), dtype=np.uint64), [len(s) for s in sets])
                    if len(known):
                        maybe = np.flatnonzero(low[(h & np.uint64(0xFFFFF)).astype(np.int64)])
                        at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
                        is_common = known[at] == h[maybe]
                        at, maybe = at[is_common], maybe[is_common]
                        if len(maybe):
                            kinds.append(2)
                            frags.append(home)
                            data.append(((place[maybe] << np.uint64(48)) | np.uint64(0xFFFF << 32) | at.astype(np.uint64)).tobytes())
                            rest = np.ones(len(h), bool)
                            rest[maybe] = False
                            h, place = h[rest], place[rest]
                    frag = ((h >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
                    packed = (h << np.uint64(16)) | place
                    order = np.argsort(frag.astype(np.uint32), kind="stable")
                    frag, packed = frag[order], packed[order]
                    starts = np.flatnonzero(np.diff(frag, prepend=np.uint64(1 << 40)))
                    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(frag)], strict=True):
                        kinds.append(1)
                        frags.append(int(frag[s]))
                        data.append(packed[s:e].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(frags, pa.int32()), pa.array([slice_id] * len(data), pa.int64()), pa.array(data, pa.binary())], ["kind", "fragment", "slice", "data"])
                slice_id += 1

    return docs.select("doc_id", "text").mapInArrow(run, _POSTINGS)


def shared_only(rows: pa.Table) -> pa.Table:
    """Of one fragment: for each slice the postings of n-grams that two texts or more hold, as place (16 bits), how many hold it (16, at most that), rank of the n-gram (32). Other rows pass."""
    rows = rows.combine_chunks()
    kind = rows.column("kind").to_numpy()
    passing = rows.filter(pa.array(kind != 1))
    rows = rows.filter(pa.array(kind == 1)).combine_chunks()
    if not rows.num_rows:
        return passing
    data = rows.column("data").chunk(0)
    slices = rows.column("slice").to_numpy()
    packed = np.frombuffer(joined(data), np.uint64)
    sizes = np.diff(np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]) // 8
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    order = np.argsort(packed, kind="stable")
    packed, row = packed[order], row[order]
    h = packed >> np.uint64(16)
    new = np.diff(h, prepend=h[0] + np.uint64(1)) != 0
    group = np.cumsum(new) - 1
    held = np.bincount(group)
    keep = held[group] > 1
    packed, row, group = packed[keep], row[keep], group[keep]
    if not len(row):
        return passing
    rank = np.cumsum(np.diff(group, prepend=-1) != 0).astype(np.uint64)
    out = ((packed & np.uint64(0xFFFF)) << np.uint64(48)) | (np.minimum(held[group], 0xFFFF).astype(np.uint64) << np.uint64(32)) | rank
    order = np.argsort(row, kind="stable")
    row, out = row[order], out[order]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    pieces = [out[s:e].tobytes() for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(row)], strict=True)]
    fragment = rows.column("fragment")[0].as_py()
    shared = pa.table({"kind": pa.array([1] * len(pieces), pa.int32()), "fragment": pa.array([fragment] * len(pieces), pa.int32()), "slice": pa.array(slices[row[starts]], pa.int64()), "data": pa.array(pieces, pa.binary())})
    return pa.concat_tables([passing.cast(shared.schema), shared])


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending integers as compressed differences, their bytes plane by plane."""
    d = np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.T).tobytes())


def unpack_sorted(raw: bytes) -> np.ndarray:
    d = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(d.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def survivors(rows: pa.Table) -> pa.Table:
    """Of one slice: its members (kind 0), and the shared n-grams of each set that has enough of them (kind 1): those of its prefix as plain ids, all as packed ids, in fragments."""
    out: dict[str, list] = {"kind": [], "doc_id": [], "n": [], "a": [], "b": [], "shared": [], "prefix": [], "grams": []}

    def add(kind, doc_id, n, a, b, shared, prefix, grams):
        for k, v in zip(out, (kind, doc_id, n, a, b, shared, prefix, grams), strict=True):
            out[k].append(v)

    kinds, fragments, data = rows.column("kind").to_pylist(), rows.column("fragment").to_pylist(), rows.column("data")
    member = [np.frombuffer(d.as_py(), _MEMBER) for k, d in zip(kinds, data, strict=True) if k == 0]
    parts = [np.frombuffer(d.as_py(), np.uint64) for k, d in zip(kinds, data, strict=True) if k]
    frags = [f if k == 1 else _COMMON_FRAGMENT for k, f in zip(kinds, fragments, strict=True) if k]
    signed = lambda x: int(x) - (1 << 64) if x >= 1 << 63 else int(x)
    for m in member:
        for d, null, n, a, b, _ in m.tolist():
            add(0, None if null else d, n, signed(a), signed(b), None, None, None)
    if parts and member:
        by_place = {m["place"]: m for m in member[0] if m["place"] >= 0}
        packed = np.concatenate(parts)
        frag = np.repeat(np.array(frags, np.uint64), [len(p) for p in parts])
        place, held = packed >> np.uint64(48), (packed >> np.uint64(32)) & np.uint64(0xFFFF)
        gram = (frag << np.uint64(32)) | (packed & np.uint64(0xFFFFFFFF))
        order = np.lexsort((gram, held, place))
        place, gram = place[order], gram[order]
        starts = np.flatnonzero(np.diff(place.astype(np.int64), prepend=-1))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(place)], strict=True):
            m = by_place[int(place[s])]
            n = int(m["n"])
            if (spare := e - s - int(least_overlap(n))) >= 0:
                # the unshared n-grams come first in the order and take their part of the prefix
                add(1, None, n, signed(m["a"]), signed(m["b"]), e - s, gram[s : s + spare + 1].tobytes(), in_fragments(gram[s:e]))
    return pa.table({"kind": pa.array(out["kind"], pa.int32()), "doc_id": pa.array(out["doc_id"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "a": pa.array(out["a"], pa.int64()), "b": pa.array(out["b"], pa.int64()), "shared": pa.array(out["shared"], pa.int64()), "prefix": pa.array(out["prefix"], pa.binary()), "grams": pa.array(out["grams"], pa.list_(pa.binary()))})


def in_fragments(grams: np.ndarray) -> list[bytes]:
    """A set's shared n-grams, cut by hash into PAIR_FRAGMENTS, packed."""
    home = (mixed(grams) >> np.uint64(32)) * np.uint64(PAIR_FRAGMENTS) >> np.uint64(32)
    return [pack_sorted(np.sort(grams[home == f])) for f in range(PAIR_FRAGMENTS)]


def prefix_lists(classes: DataFrame) -> DataFrame:
    """(gram, node) for each n-gram of each class's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = np.frombuffer(joined(b.column("prefix")), np.int64)
            sizes = np.array([len(x.as_buffer()) // 8 for x in b.column("prefix")], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.repeat(b.column("node").to_numpy(), sizes))], ["gram", "node"])

    return classes.select("node", "prefix").mapInArrow(run, "gram long, node long")


class Overlaps:
    """The classes of a task (by ascending n) and the overlaps of every two whose sizes allow a link, summed over fragments."""

    def __init__(self, n: np.ndarray):
        self.n = n
        self.ends = np.searchsorted(n, 100 * n // PART, "right")  # larger sets cannot link with it
        self.counts = [np.zeros(max(0, end - i - 1), np.int64) for i, end in enumerate(self.ends.tolist())]

    def add(self, grams: list[np.ndarray]) -> None:
        """Counts the partial overlaps of one fragment, given each class's n-grams in it."""
        ends = np.cumsum([len(g) for g in grams])
        kinds, ids = np.unique(np.concatenate(grams), return_inverse=True)
        held = np.zeros(len(kinds) + 1, np.uint8)
        ids = np.append(ids, len(kinds))  # so that every class's begin is a place
        starts = np.concatenate([[0], ends])
        empty = starts[1:] == starts[:-1]
        for i, counts in enumerate(self.counts):
            if not len(counts) or empty[i]:
                continue
            own, end = ids[starts[i] : starts[i + 1]], int(self.ends[i])
            held[own] = 1
            met = held[ids[starts[i + 1] : starts[end] + 1]]
            met[-1] = 0  # what begins behind the last class
            part = np.add.reduceat(met, starts[i + 1 : end] - starts[i + 1], dtype=np.int64)
            part[empty[i + 1 : end]] = 0
            counts += part
            held[own] = 0

    def linked(self, size: np.ndarray, earlier: list[np.ndarray], part: np.ndarray, crossing: bool) -> tuple[np.ndarray, np.ndarray]:
        """(links added, root) of each class. A pair that an earlier cluster holds too ties its classes, but its link is counted there. If crossing, only pairs of classes of different parts count."""
        m, n = len(self.n), self.n
        added, root = np.zeros(m, np.int64), np.arange(m)
        ends = np.cumsum([len(x) for x in earlier])
        starts = ends - [len(x) for x in earlier]
        kinds, ids = np.unique(np.concatenate(earlier), return_inverse=True)
        held = np.zeros(len(kinds), bool)
        for i, overlap in enumerate(self.counts):
            linked = 100 * overlap >= PART * (n[i] + n[i + 1 : i + 1 + len(overlap)] - overlap)
            if crossing:
                linked &= part[i + 1 : i + 1 + len(overlap)] != part[i]
            j = np.flatnonzero(linked) + i + 1
            if not len(j):
                continue
            roots = np.unique(root[np.append(j, i)])
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
            if ends[i] > starts[i]:
                own = ids[starts[i] : ends[i]]
                held[own] = True
                sums = np.concatenate([[0], np.cumsum(held[ids])])
                held[own] = False
                j = j[sums[ends[j]] == sums[starts[j]]]
            added[i] += size[j].sum()
            added[j] += size[i]
        return added, root


def clusters(lists: DataFrame, scratch: Scratch) -> DataFrame:
    """(lead, node): the least class of each list, and every class of its lists. Any two classes of one list share its lead."""
    # stored, so that both sides of the join come straight from a shuffle and Spark can split a long list
    lead = scratch.put(lists.groupBy("gram").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead != last").select("gram", "lead"), "leads")
    return lists.join(lead, "gram").select("lead", "node").distinct()


def links(members: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, added, root) of each class that a cluster links with any: the copies linked there, weighted by how many they are, and a tie."""
    sized = members.join(classes.select("node", "shared"), "node").groupBy("lead").agg(F.ceil(F.greatest(F.sum("shared") / TASK_GRAMS, F.count("*") / TASK_CLASSES)).cast("int").alias("parts"))
    large = scratch.put(sized.where("parts > 1"), "large")  # few: stored, so that Spark knows it
    leads = members.groupBy("node").agg(F.collect_list("lead").alias("leads"))
    rows = classes.select("node", "n", "size", "grams").join(leads, "node").withColumn("lead", F.explode("leads")).withColumn("earlier", F.filter("leads", lambda x: x < F.col("lead"))).drop("leads")
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.join(large, "lead", "left").withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.withColumn("task", F.xxhash64("lead", F.least("part", "other"), F.greatest("part", "other")))
    rows = rows.withColumn("crossing", F.col("part") != F.col("other"))
    rows = rows.select("task", "node", "n", "size", "part", "crossing", "earlier", F.posexplode("grams").alias("fragment", "own"))
    rows = rows.withColumn("earlier", F.when(F.col("fragment") == 0, F.col("earlier")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = first = None

        def done() -> pa.RecordBatch:
            node = first.column("node").to_numpy()
            earlier = [np.array(x, np.int64) for x in first.column("earlier").to_pylist()]
            added, root = now.linked(first.column("size").to_numpy(), earlier, first.column("part").to_numpy(), first.column("crossing")[0].as_py())
            out = (added > 0) | (root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(x[out], pa.int64()) for x in (node, added, node[root])], ["node", "added", "root"])

        for g in in_runs(batches, "task", "fragment"):
            if g.column("fragment")[0].as_py() == 0:
                if now:
                    yield done()
                now, first = Overlaps(g.column("n").to_numpy()), g.drop_columns(["own"])
            now.add([unpack_sorted(x) for x in g.column("own").to_pylist()])
        if now:
            yield done()

    return rows.repartition(partitions_for(members.sparkSession), "task").sortWithinPartitions("task", "fragment", "n", "node").mapInArrow(run, "node long, added long, root long")


def linked(spark: SparkSession, docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, n_links, component_id of each row of docs (doc_id, text)."""
    ship(spark)
    scratch = Scratch(spark, "ngrams")
    fragments, common = shape(docs, size)
    kept = cut(docs, fragments, size, common).groupBy("fragment").applyInArrow(shared_only, _POSTINGS)
    kept = kept.groupBy("slice").applyInArrow(survivors, "kind int, doc_id long, n long, a long, b long, shared long, prefix binary, grams array<binary>")
    kept = scratch.put(kept, "sets")

    members = kept.where("kind = 0").select("doc_id", "n", "a", "b")
    node = F.xxhash64("a", "b", "n").alias("node")
    copies = scratch.put(members.where("n > 0").groupBy(node).agg(F.min("doc_id").alias("first"), F.count("*").alias("size")), "copies")
    sets = kept.where("kind = 1").select(node, "n", "shared", "prefix", "grams")
    sets = sets.groupBy("node").agg(F.first("n").alias("n"), F.first("shared").alias("shared"), F.first("prefix").alias("prefix"), F.first("grams").alias("grams"))
    sets = scratch.put(sets.join(copies.select("node", "size"), "node"), "classes")
    lists = scratch.put(prefix_lists(sets), "lists")
    found = scratch.put(links(scratch.put(clusters(lists, scratch), "clusters"), sets, scratch), "links")
    labels = scratch.put(connected_components(spark, found.select(F.col("node").alias("u"), F.col("root").alias("v")), scratch), "labels")
    added = scratch.put(found.groupBy("node").agg(F.sum("added").alias("added")), "added")
    classes = copies.join(labels, "node", "left").join(added, "node", "left")
    classes = scratch.put(classes.select("node", "first", (F.col("size") - 1 + F.coalesce("added", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("root")), "named")
    roots = scratch.put(classes.groupBy("root").agg(F.min("first").alias("component_id")), "roots")
    named = scratch.put(classes.join(roots, "root").select("node", "n_links", "component_id"), "per_class")
    out = members.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, node).alias("node")).join(named, "node", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = scratch.put(out, "result")
    scratch.only(out)
    return out


def components(spark: SparkSession, docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text)."""
    return linked(spark, docs, size).drop("n_links")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark, table(spark, sf_dir, "documents"))
