"""Groups in order, streamed through one Arrow function a partition: for very many small groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_groups(rows: DataFrame, key: str, order: list[str], make: Callable[[object, dict[str, list]], list[tuple]], names: list[str], kinds: tuple, schema: str, at_once: int = 20_000) -> DataFrame:
    """Rows of make(key, columns of the group as lists, in order) for each key.

    One shuffle by key and a sort; a task holds one group and what it has made so far, and no group costs a call of its own.
    """
    columns = rows.columns
    dealt = rows.withColumn("__null", F.col(key).isNull()).repartition(key).sortWithinPartitions("__null", key, *order).drop("__null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in columns}
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

        for b in batches:
            if not b.num_rows:
                continue
            cols = {c: b.column(c).to_pylist() for c in columns}
            keys = cols[key]
            starts = [0, *(np.flatnonzero(np.array([a != c for a, c in zip(keys, keys[1:], strict=False)], bool)) + 1).tolist(), len(keys)]
            for s, e in zip(starts, starts[1:], strict=False):
                if held[key] and held[key][0] != keys[s]:
                    out += make(held[key][0], held)
                    held = {c: [] for c in columns}
                    if len(out) >= at_once:
                        yield made()
                        out = []
                for c in columns:
                    held[c] += cols[c][s:e]
        if held[key]:
            out += make(held[key][0], held)
        yield made()

    return dealt.mapInArrow(run, schema)
