"""TrueType files as tables: metrics, glyphs and advances, kerning pairs. Character maps of format 4 and pair adjustments of formats 1 and 2."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.lines import Face
from leafmill.plans.session import ship

#: Fixed value: a character without a glyph that has another's shape.
SAME_SHAPE = {0x2011: 0x2D}


class BadFont(ValueError):
    pass


class Bytes:
    """Big-endian numbers at places of a file, checked against its end."""

    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw, at

    def get(self, form: str, at: int) -> tuple:
        try:
            return struct.unpack_from(">" + form, self.raw, self.at + at)
        except struct.error:
            raise BadFont("cut short") from None

    def u16(self, at: int) -> int:
        return self.get("H", at)[0]

    def i16(self, at: int) -> int:
        return self.get("h", at)[0]

    def u16s(self, at: int, n: int) -> tuple[int, ...]:
        return self.get(f"{n}H", at)

    def within(self, at: int) -> Bytes:
        return Bytes(self.raw, self.at + at)


@dataclass
class Font:
    family: str
    style: str
    em: int
    ascent: int
    descent: int
    gap: int
    underline: int
    underline_thickness: int
    strikeout: int
    strikeout_thickness: int
    glyphs: dict[int, int]  # character -> glyph
    advances: list[int]
    pairs: dict[tuple[int, int], int]  # glyphs -> adjustment of the first's advance
    legacy_kerning: bool

    def glyph(self, c: int) -> int:
        return self.glyphs.get(c) or self.glyphs.get(SAME_SHAPE.get(c, -1), 0)

    def advance(self, c: int) -> int:
        return self.advances[min(self.glyph(c), len(self.advances) - 1)]

    def face(self, characters: str) -> Face:
        """For the line breaker: the advances and pairs of some characters."""
        by_glyph: dict[int, list[str]] = {}
        for c in set(characters):
            by_glyph.setdefault(self.glyph(ord(c)), []).append(c)
        pairs = {(a, b): v for (x, y), v in self.pairs.items() if x in by_glyph and y in by_glyph for a in by_glyph[x] for b in by_glyph[y]}
        return Face(self.em, self.advances[0], self.ascent, -self.descent, self.gap, {c: self.advance(ord(c)) for c in set(characters)}, pairs, (self.underline_thickness / 2 - self.underline, self.underline_thickness), (self.strikeout, self.strikeout_thickness))


def tables_of(raw: bytes) -> dict[str, Bytes]:
    b = Bytes(raw)
    if raw[:4] not in (b"\x00\x01\x00\x00", b"OTTO", b"true"):
        raise BadFont("not a font of one face")
    out = {}
    for k in range(b.u16(4)):
        tag, _, at, size = b.get("4s3L", 12 + 16 * k)
        if at + size > len(raw):
            raise BadFont(f"table {tag.decode('latin-1')} is cut short")
        out[tag.decode("latin-1")] = Bytes(raw, at)
    return out


def characters_of(cmap: Bytes) -> dict[int, int]:
    """Character -> glyph of the first Unicode subtable of format 4."""
    for k in range(cmap.u16(2)):
        platform, encoding, at = cmap.get("HHL", 4 + 8 * k)
        t = cmap.within(at)
        if (platform, encoding) not in ((3, 1), (0, 3), (0, 4), (0, 1), (0, 0)) or t.u16(0) != 4:
            continue
        n = t.u16(6) // 2
        ends, starts = t.u16s(14, n), t.u16s(16 + 2 * n, n)
        deltas, ranges = t.u16s(16 + 4 * n, n), t.u16s(16 + 6 * n, n)
        out = {}
        for s, (end, start, delta, offset) in enumerate(zip(ends, starts, deltas, ranges, strict=True)):
            for c in range(start, min(end, 0xFFFE) + 1):
                g = (c + delta) & 0xFFFF
                if offset:
                    g = t.u16(16 + 6 * n + 2 * s + offset + 2 * (c - start))
                    g = (g + delta) & 0xFFFF if g else 0
                if g:
                    out[c] = g
        return out
    raise BadFont("no character map of format 4")


def _coverage(t: Bytes) -> list[int]:
    if t.u16(0) == 1:
        return list(t.u16s(4, t.u16(2)))
    return [g for k in range(t.u16(2)) for g in range(t.u16(4 + 6 * k), t.u16(6 + 6 * k) + 1)]


def _classes(t: Bytes) -> dict[int, int]:
    if t.u16(0) == 1:
        return {t.u16(2) + k: c for k, c in enumerate(t.u16s(6, t.u16(4)))}
    return {g: t.u16(8 + 6 * k) for k in range(t.u16(2)) for g in range(t.u16(4 + 6 * k), t.u16(6 + 6 * k) + 1)}


def kerning_of(gpos: Bytes, wanted: set[int]) -> dict[tuple[int, int], int]:
    """Adjustments of pairs of wanted glyphs; the first subtable that moves a pair decides."""
    lookups = gpos.within(gpos.u16(8))
    features = gpos.within(gpos.u16(6))
    used: list[int] = []
    for k in range(features.u16(0)):
        tag, at = features.get("4sH", 2 + 6 * k)
        if tag == b"kern":
            f = features.within(at)
            used += [i for i in f.u16s(4, f.u16(2)) if i not in used]
    out: dict[tuple[int, int], int] = {}
    for i in sorted(used):
        lookup = lookups.within(lookups.u16(2 + 2 * i))
        kind = lookup.u16(0)
        for at in lookup.u16s(6, lookup.u16(4)):
            t, real = lookup.within(at), kind
            if kind == 9:
                real, far = t.u16(2), t.get("L", 4)[0]
                t = t.within(far)
            if real == 2:
                for pair, v in _pairs(t, wanted).items():
                    if v:
                        out.setdefault(pair, v)
    return out


def _pairs(t: Bytes, wanted: set[int]) -> dict[tuple[int, int], int]:
    first, second = t.u16(4), t.u16(6)
    size = lambda form: 2 * bin(form & 0xFF).count("1")
    if not first & 4:
        return {}
    where = 2 * bin(first & 3).count("1")  # of the advance in the first value
    covered = _coverage(t.within(t.u16(2)))
    out = {}
    if t.u16(0) == 1:
        step = 2 + size(first) + size(second)
        for g, at in zip(covered, t.u16s(10, t.u16(8)), strict=False):
            if g in wanted:
                s = t.within(at)
                for k in range(s.u16(0)):
                    other = s.u16(2 + k * step)
                    if other in wanted:
                        out[g, other] = s.i16(4 + k * step + where)
        return out
    ones, twos = _classes(t.within(t.u16(8))), _classes(t.within(t.u16(10)))
    columns, step = t.u16(14), size(first) + size(second)
    rights = [(g, twos.get(g, 0)) for g in sorted(wanted)]
    for g in covered:
        if g in wanted:
            row = 16 + ones.get(g, 0) * columns * step
            for other, c in rights:
                if v := t.i16(row + c * step + where):
                    out[g, other] = v
    return out


def parse(raw: bytes, characters: str | None = None) -> Font:
    """A font; kerning is read for the pairs of the characters given (printable ASCII if none are)."""
    t = tables_of(raw)
    missing = [n for n in ("head", "hhea", "hmtx", "maxp", "cmap") if n not in t]
    if missing:
        raise BadFont(f"no table {missing[0]}")
    names = {}
    if (n := t.get("name")) is not None:
        text = n.u16(4)
        for k in range(n.u16(2)):
            platform, _, _, what, size, at = n.get("6H", 6 + 12 * k)
            if what in (1, 2) and (platform == 3 or what not in names):
                raw_name = n.raw[n.at + text + at : n.at + text + at + size]
                names[what] = raw_name.decode("utf-16-be" if platform in (0, 3) else "latin-1", "replace")
    ascent, descent, gap = t["hhea"].get("3h", 4)
    n_metrics = t["hhea"].u16(34)
    advances = list(t["hmtx"].u16s(0, 2 * n_metrics))[::2]
    glyphs = characters_of(t["cmap"])
    post, os2 = t.get("post"), t.get("OS/2")
    under, thick = post.get("2h", 8) if post else (0, 0)
    strike_thick, strike = os2.get("2h", 26) if os2 else (0, 0)
    wanted = {glyphs.get(ord(c), 0) for c in (characters or "".join(map(chr, range(32, 127))))} - {0}
    pairs = kerning_of(t["GPOS"], wanted) if "GPOS" in t else {}
    return Font(names.get(1, ""), names.get(2, ""), t["head"].u16(18), ascent, descent, gap, under, thick, strike, strike_thick, glyphs, advances, pairs, "kern" in t)


def _table(files: DataFrame, schema: str, kinds: tuple, rows) -> DataFrame:
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("font").to_pylist(), b.column("content"), strict=True):
                got = rows(name, content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], kind) for k, kind in enumerate(kinds)], [f.split()[0] for f in schema.split(", ")])

    return files.select("font", "content").mapInArrow(run, schema)


def metrics(files: DataFrame) -> DataFrame:
    """One row for each font file (font, content); what is wrong with one that cannot be read is in error."""

    def rows(name: str, raw: bytes) -> list[tuple]:
        try:
            f = parse(raw, "A")
        except BadFont as e:
            return [(name, *[None] * 10, str(e))]
        return [(name, f.family, f.style, f.em, f.ascent, f.descent, f.gap, f.underline, f.underline_thickness, f.strikeout, f.strikeout_thickness, None)]

    schema = "font string, family string, style string, em int, ascent int, descent int, gap int, underline int, underline_thickness int, strikeout int, strikeout_thickness int, error string"
    return _table(files, schema, (pa.string(), pa.string(), pa.string(), *[pa.int32()] * 8, pa.string()), rows)


def glyphs(files: DataFrame) -> DataFrame:
    """(font, codepoint, glyph, advance) of every character that a font has."""

    def rows(name: str, raw: bytes) -> list[tuple]:
        f = parse(raw, "A")
        return [(name, c, g, f.advances[min(g, len(f.advances) - 1)]) for c, g in f.glyphs.items()]

    return _table(files, "font string, codepoint int, glyph int, advance int", (pa.string(), *[pa.int32()] * 3), rows)


def kern_pairs(files: DataFrame, characters: str | None = None) -> DataFrame:
    """(font, before, after, adjustment) for pairs of glyphs of the characters given."""

    def rows(name: str, raw: bytes) -> list[tuple]:
        return [(name, *pair, v) for pair, v in parse(raw, characters).pairs.items()]

    return _table(files, "font string, before int, after int, adjustment int", (pa.string(), *[pa.int32()] * 3), rows)


def advance_of(texts: DataFrame, glyph_table: DataFrame) -> DataFrame:
    """Adds to texts (id, font, text) the sum of advances and the number of characters without a glyph. The glyph table's size is a font's own, so Spark chooses how to join."""
    chars = texts.select("id", "font", F.explode(F.split("text", "")).alias("c")).where("c != ''").select("id", "font", F.expr("ascii(c)").alias("codepoint"))
    joined = chars.groupBy("id", "font", "codepoint").agg(F.count("*").alias("n")).join(glyph_table, ["font", "codepoint"], "left")
    return joined.groupBy("id").agg(F.sum(F.coalesce("advance", F.lit(0)) * F.col("n")).alias("advance"), F.sum(F.when(F.col("glyph").isNull(), F.col("n")).otherwise(0)).alias("n_missing"))


# ---- families


def resolved_faces(requests: DataFrame, families: DataFrame, default: str) -> DataFrame:
    """Requests (family, bold, italic) with the shipped family and file that serve them.

    families has (family, aliases, files: map of regular, bold, italic, boldItalic to a file); names meet without case and
    outer spaces, unknown ones get the default, styles that a family lacks its regular.
    """
    names = families.select("family", "files", F.explode(F.array_union(F.array("family"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    names = names.select(F.col("family").alias("shipped"), "files", F.lower(F.trim("alias")).alias("alias")).dropDuplicates(["alias"])
    fallback = families.where(F.col("family") == default).select(F.col("family").alias("d_family"), F.col("files").alias("d_files")).limit(1)
    style = F.when(F.col("bold") & F.col("italic"), "boldItalic").when(F.col("bold"), "bold").when(F.col("italic"), "italic").otherwise("regular")
    out = requests.withColumn("alias", F.lower(F.trim("family"))).join(names, "alias", "left")
    out = out.join(F.broadcast(fallback), F.lit(True), "left")  # one row
    out = out.withColumn("files", F.coalesce("files", "d_files")).withColumn("shipped", F.coalesce("shipped", "d_family")).withColumn("style", style)
    return out.select("family", "bold", "italic", "shipped", F.coalesce(F.col("files")[F.col("style")], F.col("files")["regular"]).alias("file"))
