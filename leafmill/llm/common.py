"""What the training-data operators share: reading, shared scratch tables, Arrow helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.plans.session import ship

#: Bytes of texts that a Python worker has as strings at a time.
SLICE_BYTES = 3_000_000

#: Spark's setting that an execution takes its shuffle files along when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

__all__ = ["SLICE_BYTES", "Scratch", "crc_mod", "crc_mod_py", "free_names", "in_runs", "joined", "partitions_for", "shared_dir", "ship", "table", "text_slices", "without_shuffles"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where it is unset, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/leafmill-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: Spark removes them when the write ends."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


class Scratch:
    """Tables in the shared folder that cut lineage; a lost executor only re-reads them.

    `put` returns the stored table, `drop` deletes some that nothing reads any more, `only` all but those given. What is
    left, such as the table that a result is read from, goes when the application ends.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.n, self.paths = spark, f"{shared_dir(spark)}/leafmill-{tag}-{uuid.uuid4().hex[:12]}", 0, {}
        folder, files = self._files(self.root)
        files.mkdirs(folder)
        files.deleteOnExit(folder)

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with without_shuffles(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def remove(self, path: str) -> None:
        p, files = self._files(path)
        files.delete(p, True)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self.remove(self.paths.pop(id(df))[1])

    def only(self, *frames: DataFrame) -> None:
        self.drop(*[df for df, _ in list(self.paths.values()) if all(df is not f for f in frames)])


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names for columns of an operator's own that no given column has, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def in_runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Rows that are sorted by integer keys, as one table for each run of equal keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy() for k in keys]
        change = np.zeros(b.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = (np.flatnonzero(change) + 1).tolist()
        for s, e in zip([0, *starts], [*starts, b.num_rows], strict=True):
            now = tuple(c[s] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def crc_mod(col: str, m: int):
    """crc32 of the id as text, mod m; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % m


def crc_mod_py(doc_id, m: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def joined(column: pa.Array) -> memoryview:
    """The bytes of a binary column without nulls, one row after the other."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return memoryview(column.buffers()[2] or b"")[offsets[0] : offsets[-1]] if len(column) else memoryview(b"")


def text_slices(batch: pa.RecordBatch, most: int, column: str = "text", rows: int = 1 << 30):
    """A batch in slices whose texts have at most so many bytes together (or that are one row), and so many rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield batch.slice(at, end - at)
        at = end


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
