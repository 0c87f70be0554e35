"""Office packages as tables: archive parts, relationships, replacement and saving.

A package that cannot be read gives one row with what is wrong in `error`; nothing fails the job. Parts stay compressed
until a query asks for one, and saving copies the compressed bytes of every part that was not replaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.plans.grouped import in_groups
from leafmill.plans.session import ship
from leafmill.sources import xml

_END, _END64, _FIND64 = struct.Struct("<4s4H2LH"), struct.Struct("<4sQ2H2L4Q"), struct.Struct("<4sLQL")
_ENTRY, _LOCAL = struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")


class BadPackage(ValueError):
    pass


@dataclass(frozen=True)
class Part:
    name: str
    method: int
    crc: int
    size: int
    data: bytes  # as stored
    time: int = 0
    date: int = 33
    attributes: int = 0

    def content(self) -> bytes:
        """The part's bytes, checked against its size and sum."""
        try:
            out = self.data if self.method == 0 else zlib.decompress(self.data, -15)
        except zlib.error as e:
            raise BadPackage(f"{self.name}: damaged: {e}") from None
        if len(out) != self.size or zlib.crc32(out) != self.crc:
            raise BadPackage(f"{self.name}: size or sum does not agree")
        return out


def stored(name: str, content: bytes, time: int = 0, date: int = 33, attributes: int = 0) -> Part:
    """A part of new content: deflated where that is smaller."""
    z = zlib.compressobj(wbits=-15)
    small = z.compress(content) + z.flush()
    method, data = (8, small) if len(small) < len(content) else (0, content)
    return Part(name, method, zlib.crc32(content), len(content), data, time, date, attributes)


def _directory(raw: bytes) -> tuple[int, int]:
    """(entries, offset of the central directory) from the end record, searched past a comment, or its 64-bit form."""
    low = max(0, len(raw) - _END.size - 65535)
    at = raw.rfind(b"PK\x05\x06", low)
    if at < 0 or at + _END.size > len(raw):
        raise BadPackage("no end record: not an archive, or cut short")
    _, _, _, _, count, _, offset, _ = _END.unpack_from(raw, at)
    if (count == 0xFFFF or offset == 0xFFFFFFFF) and at >= _FIND64.size and raw[at - _FIND64.size :][:4] == b"PK\x06\x07":
        _, _, where, _ = _FIND64.unpack_from(raw, at - _FIND64.size)
        if where + _END64.size > len(raw) or raw[where : where + 4] != b"PK\x06\x06":
            raise BadPackage("no 64-bit end record")
        *_, count, _, offset = _END64.unpack_from(raw, where)
    return count, offset


def read_parts(raw: bytes) -> list[Part]:
    count, at = _directory(raw)
    parts = []
    for _ in range(count):
        if at + _ENTRY.size > len(raw) or raw[at : at + 4] != b"PK\x01\x02":
            raise BadPackage("the directory is cut short")
        _, _, _, flags, method, time, date, crc, packed, size, n, extra, comment, _, _, attributes, local = _ENTRY.unpack_from(raw, at)
        name = raw[at + _ENTRY.size : at + _ENTRY.size + n].decode("utf-8", "replace")
        at += _ENTRY.size + n + extra + comment
        if name.endswith("/"):
            continue
        if flags & 1:
            raise BadPackage(f"{name}: encrypted")
        if method not in (0, 8):
            raise BadPackage(f"{name}: method {method}")
        if 0xFFFFFFFF in (packed, size, local):
            raise BadPackage(f"{name}: 64-bit entry")
        if local + _LOCAL.size > len(raw) or raw[local : local + 4] != b"PK\x03\x04":
            raise BadPackage(f"{name}: no local header")
        *_, own_name, own_extra = _LOCAL.unpack_from(raw, local)  # these lengths may differ from the directory's
        begin = local + _LOCAL.size + own_name + own_extra
        if begin + packed > len(raw):
            raise BadPackage(f"{name}: cut short")
        parts.append(Part(name, method, crc, size, raw[begin : begin + packed], time, date, attributes))
    return parts


def write_parts(parts: list[Part]) -> bytes:
    body, directory, at = [], [], 0
    for p in parts:
        name = p.name.encode()
        flags = 0x800 if any(b > 127 for b in name) else 0
        head = _LOCAL.pack(b"PK\x03\x04", 20, flags, p.method, p.time, p.date, p.crc, len(p.data), p.size, len(name), 0) + name
        directory.append(_ENTRY.pack(b"PK\x01\x02", 20, 20, flags, p.method, p.time, p.date, p.crc, len(p.data), p.size, len(name), 0, 0, 0, 0, p.attributes, at) + name)
        body += [head, p.data]
        at += len(head) + len(p.data)
    listed = b"".join(directory)
    return b"".join([*body, listed, _END.pack(b"PK\x05\x06", 0, 0, len(parts), len(parts), len(listed), at, 0)])


PARTS = "doc string, ord int, name string, method int, crc long, size long, time int, date int, attributes long, data binary, error string"


def parts(packages: DataFrame) -> DataFrame:
    """One row for each part of each package (doc, content), in order of its directory; data as stored."""
    ship(packages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PARTS.split(", ")]
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.string())
        for b in batches:
            for doc, raw in zip(b.column("doc").to_pylist(), b.column("content"), strict=True):
                try:
                    rows = [(doc, i, p.name, p.method, p.crc, p.size, p.time, p.date, p.attributes, p.data, None) for i, p in enumerate(read_parts(raw.as_py() or b""))]
                except BadPackage as e:
                    rows = [(doc, -1, None, None, None, None, None, None, None, None, str(e))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return packages.select("doc", "content").mapInArrow(run, PARTS)


def contents(rows: DataFrame) -> DataFrame:
    """Adds content (inflated) and whether size and sum agree; select parts by name before this."""
    ship(rows.sparkSession)

    @F.pandas_udf("binary")
    def inflated(data, method):
        def one(d, m):
            try:
                return d if d is None or m == 0 else zlib.decompress(d, -15)
            except zlib.error:
                return None

        import pandas as pd

        return pd.Series([one(d, m) for d, m in zip(data, method, strict=True)], dtype=object)

    out = rows.withColumn("content", inflated("data", "method"))
    return out.withColumn("intact", F.coalesce((F.octet_length("content") == F.col("size")) & (F.crc32("content") == F.col("crc")), F.lit(False)))


def packages(spark: SparkSession, path: str) -> DataFrame:
    """Packages of a folder: doc (path), content."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc"), "content")


def saved(rows: DataFrame, replacements: DataFrame) -> DataFrame:
    """(doc, content): packages with the parts in replacements (doc, name, content) exchanged; others keep their stored bytes. Names that are no part change nothing."""
    ship(rows.sparkSession)
    new = replacements.select("doc", "name", F.col("content").alias("new"))
    both = rows.where("error is null").join(new, ["doc", "name"], "left")

    columns = ["doc", "ord", "name", "method", "crc", "size", "time", "date", "attributes", "data", "new"]

    def make(doc: str, group: dict[str, list]) -> list[tuple]:
        found = []
        for _, _, name, method, crc, size, time, date, attributes, data, new_content in zip(*(group[c] for c in columns), strict=True):
            p = Part(name, method, crc, size, data, time, date, attributes)
            found.append(p if new_content is None else stored(name, new_content, time, date, attributes))
        return [(doc, write_parts(found))]

    # one function a partition, not one call a package
    return in_groups(both.select(*columns), "doc", ["ord"], make, ["doc", "content"], (pa.string(), pa.binary()), "doc string, content binary", at_once=200)


# ---- relationships


def relationship_part(name: str) -> str:
    """Where a part's relationships are; the package's own for an empty name."""
    folder, _, base = name.rpartition("/")
    return f"{folder}/_rels/{base}.rels" if folder else f"_rels/{base}.rels"


def resolved(source: str, target: str) -> str:
    """A target as a part name: from the root if it begins with /, else from its source's folder; . and .. are followed."""
    steps = [] if target.startswith("/") else source.split("/")[:-1]
    for s in target.split("/"):
        if s == "..":
            steps = steps[:-1]
        elif s not in ("", "."):
            steps.append(s)
    return "/".join(steps)


def relationships_of(content: bytes, source: str) -> list[tuple[str, str, str, bool]]:
    """(id, last step of the type, target part, external) of a relationships part."""
    tree = xml.parse(content.decode("utf-8-sig"))
    return [(a.get("Id", ""), a.get("Type", "").rsplit("/", 1)[-1], a.get("Target", "") if a.get("TargetMode") == "External" else resolved(source, a.get("Target", "")), a.get("TargetMode") == "External") for n in tree.elements("Relationship") for a in [tree.attributes(n)]]


def relationships(rows: DataFrame) -> DataFrame:
    """(doc, source, ord, id, kind, target, external) from all relationships parts; source is empty for the package's own."""
    found = contents(rows.where(F.col("name").endswith(".rels"))).where("intact")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
        for b in batches:
            out = []
            for doc, name, content in zip(b.column("doc").to_pylist(), b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                source = name.replace("_rels/", "", 1)[: -len(".rels")] if name.startswith("_rels/") else name.replace("/_rels/", "/")[: -len(".rels")]
                try:
                    out += [(doc, source, i, *r) for i, r in enumerate(relationships_of(content, source))]
                except xml.BadXml:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["doc", "source", "ord", "id", "kind", "target", "external"])

    return found.select("doc", "name", "content").mapInArrow(run, "doc string, source string, ord int, id string, kind string, target string, external boolean")


#: Picture types by extension.
PICTURES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml", "webp": "image/webp", "emf": "image/emf", "wmf": "image/wmf"}


def content_type(name: Column) -> Column:
    extension = F.lower(F.element_at(F.split(name, r"\."), -1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in PICTURES.items() for x in p]), extension), F.lit("application/octet-stream"))


def media(rows: DataFrame, links: DataFrame, source: str = "word/document.xml") -> DataFrame:
    """(doc, id, name, content_type) of the pictures that a part refers to; links to other places are left out."""
    wanted = links.where((F.col("kind") == "image") & ~F.col("external") & (F.col("source") == source)).select("doc", "id", F.col("target").alias("name"))
    return rows.join(wanted, ["doc", "name"]).select("doc", "id", "name", content_type(F.col("name")).alias("content_type"))


def furniture(rows: DataFrame, links: DataFrame, source: str = "word/document.xml") -> DataFrame:
    """(doc, id, kind, name) of the headers and footers that a part refers to."""
    wanted = links.where(F.col("kind").isin("header", "footer") & ~F.col("external") & (F.col("source") == source)).select("doc", "id", "kind", F.col("target").alias("name"))
    return rows.join(wanted, ["doc", "name"]).select("doc", "id", "kind", "name")


def main_part(links: DataFrame) -> DataFrame:
    """(doc, name) of the first office document that each package points to."""
    own = links.where((F.col("source") == "") & (F.col("kind") == "officeDocument") & ~F.col("external"))
    return own.groupBy("doc").agg(F.min_by("target", "ord").alias("name"))
