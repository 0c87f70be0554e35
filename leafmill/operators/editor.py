"""The flow of an editor's blocks: styled spans and tables over pages, and where each page begins in the editor's own positions.

A document is a JSON list of items. A block has `spans` (text, and at will bold, italic, fontFamily, fontSizePx, at), a
`style`, `pageBreakBefore` and `at`; a table has `rows` of `cells` of `blocks`, `columnWidthsPx`, `cellPaddingPx`,
`borders`, spaces and `at`. What a span does not state is its block's, then the flow's. Positions (`at`) are the editor's:
the layout never reads them, and hands back the one that a page begins at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import utf16_length
from leafmill.operators.flow import LINE, SIZE, SMALL, STARTS_SQL, documents, spread
from leafmill.operators.lines import MONO, Face, Look, Paragraph, Run
from leafmill.operators.pages import Cell, Geometry, Row, Rule, Table, page_starts, paginate
from leafmill.plans.session import ship

#: The flow's style where nothing is stated.
BASE = {"fontFamily": "Calibri", "fontSizePx": 16.0}
#: Names of a block's style, and the kernel's own.
STYLE = {
    "lineHeightPx": "line_height", "spaceBeforePx": "before", "spaceAfterPx": "after", "indentLeftPx": "indent_left", "indentRightPx": "indent_right", "indentFirstLinePx": "indent_first",
    "keepLinesTogether": "keep_lines", "keepWithNext": "keep_next", "widowControl": "widow",
}
SIDES = {"top": "top", "left": "left", "bottom": "bottom", "right": "right", "insideH": "inside_h", "insideV": "inside_v"}

Faces = dict[tuple[str, bool, bool], Face]


def rules(borders: dict | None) -> dict[str, Rule]:
    """An editor's border sides (widthPx, spacePx, colorHex, style) as the kernel's."""
    return {SIDES[k]: Rule(float(b.get("widthPx", 0)), float(b.get("spacePx", 0)), b.get("colorHex", "#000000"), b.get("style", "solid")) for k, b in (borders or {}).items() if k in SIDES and b}


def paragraph(item: dict, base: dict, faces: Faces) -> Paragraph:
    own = item.get("style") or {}
    style = base | {k: v for k, v in own.items() if v is not None}

    def run(span: dict) -> Run:
        has = {k: v for k, v in span.items() if v is not None}
        family, bold, italic = has.get("fontFamily", style["fontFamily"]), has.get("bold", own.get("bold") or False), has.get("italic", own.get("italic") or False)
        return Run(has.get("text", ""), float(has.get("fontSizePx", style["fontSizePx"])), faces.get((family.strip().lower(), bold, italic), MONO), look=Look(family=family, bold=bold, italic=italic))

    kernel = {STYLE[k]: v for k, v in style.items() if k in STYLE} | {"break_before": item.get("pageBreakBefore") is True}
    if borders := rules(own.get("borders")):
        kernel["borders"] = borders
    return Paragraph([run(s) for s in item.get("spans") or [{}]], kernel)


def table(item: dict, base: dict, faces: Faces) -> Table:
    """The table; what a cell spans downwards stands as continued cells in the rows below, which the editor leaves out."""
    widths = [float(w) for w in item.get("columnWidthsPx") or []]
    rows, held = [], {}  # column -> rows still to cover, and how many columns
    for r in item.get("rows") or []:
        cells, own, column = [], list(r.get("cells") or []), 0
        while column < len(widths):
            if column in held:
                left, span = held.pop(column)
                cells.append(Cell([], span, "continue"))
                if left > 1:
                    held[column] = (left - 1, span)
            elif own:
                c = own.pop(0)
                span, down = max(1, c.get("gridSpan") or 1), max(1, c.get("rowSpan") or 1)
                cells.append(Cell([block(b, base, faces) for b in c.get("blocks") or []], span, "restart" if down > 1 else None))
                if down > 1:
                    held[column] = (down - 1, span)
            else:
                break
            column += span
        heads = [c.get("isHeader") is True for c in r.get("cells") or []]
        header = r["repeatHeader"] if r.get("repeatHeader") is not None else bool(heads) and all(heads)
        rows.append(Row(cells, header, False, r.get("heightPx")))
    pad = float(item.get("cellPaddingPx") or 0)
    return Table(rows, widths, (pad,) * 4, rules(item.get("borders")), before=float(item.get("spaceBeforePx") or 0), after=float(item.get("spaceAfterPx") or 0), break_before=item.get("pageBreakBefore") is True)


def block(item: dict, base: dict, faces: Faces) -> Paragraph | Table:
    return table(item, base, faces) if "rows" in item else paragraph(item, base, faces)


def position(item: dict, offset: int) -> int | None:
    """The editor's position of an offset (UTF-16 units) in a block, counted on in the span that holds it or, at the end, in the last; none from a span without a position on. A block without spans has its own."""
    before = 0
    for k, s in enumerate(item.get("spans") or []):
        size = len((s.get("text") or "").encode("utf-16-le")) // 2
        if s.get("at") is None:
            return None if k + 1 < len(item["spans"]) or offset < before + size else item.get("at")
        if offset < before + size or k + 1 == len(item["spans"]):
            return s["at"] + min(offset - before, size)
        before += size
    return item.get("at")


def position_of_row(item: dict, row: int) -> int | None:
    """The first position in a row's cells, else the table's."""
    rows = item.get("rows") or []
    for c in (rows[row].get("cells") or []) if row < len(rows) else []:
        for b in c.get("blocks") or []:
            first = (b.get("spans") or [{}])[0].get("at") if "rows" not in b else None
            found = position_of_row(b, 0) if "rows" in b else first if first is not None else b.get("at")
            if found is not None:
                return found
    return item.get("at") if row < len(rows) else None


STARTS = "doc_id long, page int, block int, text_offset long, row int, at long, inside_block boolean"


def starts_of(items: list[dict], geometry: Geometry, base: dict | None = None, widow: bool = True, faces: Faces | None = None) -> list[tuple]:
    """(page, block, offset, row, position, inside) of the begin of each page after the first."""
    style = BASE | (base or {})
    out = []
    for s in page_starts(paginate([block(i, style, faces or {}) for i in items], geometry, widow)):
        item = items[s.block]
        at = position_of_row(item, s.row) if s.row is not None and "rows" in item else position(item, s.offset) if "rows" not in item else None
        out.append((s.page, s.block, s.offset, s.row, at, s.inside))
    return out


def editor_starts(docs: DataFrame, geometry: Geometry, base: dict | None = None, widow: bool = True) -> DataFrame:
    """Where each page after the first begins, of documents (doc_id, items); items that are null or no list are no blocks."""
    ship(docs.sparkSession)
    kinds, names = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()), [f.split()[0] for f in STARTS.split(", ")]

    def items_of(raw: str | None) -> list[dict]:
        try:
            found = json.loads(raw or "[]")
        except ValueError:
            return []
        return found if isinstance(found, list) and all(isinstance(i, dict) for i in found) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *r) for d, raw in zip(b.column("doc_id").to_pylist(), b.column("items").to_pylist(), strict=True) for r in starts_of(items_of(raw), geometry, base, widow)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return spread(docs.select("doc_id", "items")).mapInArrow(run, STARTS)


def editor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an editor's blocks, each of two spans (the first seven letters are bold) whose positions begin at 100,000 times their block."""
    line = F.split(F.coalesce("text", F.lit("")), "\n")

    def item(t, k):
        begin, head = k.cast("long") * 100_000, F.substring(t, 1, 7)
        return F.struct(F.array(F.struct(head.alias("text"), F.lit(True).alias("bold"), begin.alias("at")), F.struct(F.substring(t, 8, 1 << 30).alias("text"), F.lit(False).alias("bold"), (begin + utf16_length(head)).alias("at"))).alias("spans"))

    docs = documents(spark, sf_dir).select("doc_id", F.to_json(F.transform(line, item)).alias("items"))
    return editor_starts(docs, SMALL, {"lineHeightPx": LINE, "fontSizePx": SIZE}, widow=False).drop("row")


EDITOR_SQL = f"SELECT doc_id, page, block, text_offset, CAST(block AS BIGINT) * 100000 + text_offset AS at, inside_block FROM ({STARTS_SQL})"

QUERIES = {"editor_pages": (editor_pages, EDITOR_SQL)}
