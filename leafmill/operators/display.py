"""Placed pages as draw operations in paint order. Plain Python, no Spark.

An operation is a flat record, so that a page's operations are rows of a table. Furniture comes first, so that a body
that it reaches into is drawn over it; of tables first all fills, then all rules, then what the cells hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from leafmill.operators.lines import ENDS, MONO, SOFT, Paragraph, Picture, Run, Tabs, Text, tab_move
from leafmill.operators.pages import RULE_WIDTH, Box, Page, PlacedFloat, PlacedLine, PlacedRow, Rule
from leafmill.operators.sections import Section

#: The thinnest rule, a tenth of a point; the colour that is not stated; glyphs of tab leaders.
THINNEST, INK = 0.1 * 96 / 72, "#000000"
LEADERS = {"dot": ".", "hyphen": "-", "underscore": "_", "middleDot": "·", "heavy": "_"}

_PARTS = re.compile(r"\t|[^\t]+")
_WORDS = re.compile(r" +|[^ ]+")


@dataclass(slots=True)
class Op:
    layer: str
    kind: str  # text, rect, line, image
    x: float
    y: float
    x2: float | None = None
    y2: float | None = None
    width: float | None = None
    height: float | None = None
    size: float | None = None
    text: str | None = None
    color: str | None = None
    style: str | None = None  # of a line: solid, dashed, dotted, double
    family: str | None = None
    bold: bool = False
    italic: bool = False
    kerned: bool = False
    media: str | None = None  # of an image: its type and its bytes
    content: bytes | None = None


def leader_count(leader: str, exact: float) -> int:
    """How many glyphs fill a tab's span."""
    if leader in ("underscore", "heavy"):
        return int(exact) + 1
    if leader in ("hyphen", "middleDot"):
        return 0 if exact < 1 else int(exact + 0.5)
    return int(exact)


class Painter:
    """The operations of the pages of one document."""

    def __init__(self):
        self.texts: dict[int, tuple[Paragraph, Text, dict[int, int], list]] = {}

    def known(self, p: Paragraph) -> tuple[Paragraph, Text, dict[int, int], list]:
        if id(p) not in self.texts:
            text = Text(p.runs)
            spans = list(text.segments()) if "\t" in text.text else []
            self.texts[id(p)] = (p, text, {s: k for k, (s, _) in enumerate(spans)}, spans)
        return self.texts[id(p)]

    # ---- lines

    def written(self, layer: str, run: Run, x: float, y: float, text: str) -> Op:
        k = run.look
        return Op(layer, "text", x, y, size=run.size, text=text, color=k.color, family=k.family, bold=k.bold, italic=k.italic, kerned=run.kerned)

    def line(self, layer: str, p: PlacedLine) -> Iterator[Op]:
        base = p.y + p.baseline
        if p.marker:
            yield self.written(layer, p.marker[0], p.marker[1], base, p.marker[0].text)
        paragraph, text, tab_at, spans = self.known(p.source)
        first, last = text.index(p.line.start), text.index(p.line.end)
        x, at = p.x, 0
        for run in paragraph.runs:
            s, e = max(first, at), min(last, at + len(run.text))
            at += len(run.text)
            if s < e:
                hyphen = e == last and text.text[e - 1] == SOFT and last < len(text.text)
                begin, ops, x = x, [], x
                if run.picture:
                    yield self.image(layer, run.picture, x, base - run.rise - run.picture.height)
                    x += run.picture.width
                    continue
                for m in _PARTS.finditer(text.text, s, e):
                    if m.group() == "\t":
                        x = self.tab(layer, p, run, text, spans, tab_at.get(m.start()), x, base - run.rise, ops)
                    else:
                        x = self.stretch(layer, p, run, text, *m.span(), x, base - run.rise, hyphen and m.end() == e, ops)
                if run.look.highlight:
                    yield Op(layer, "rect", begin, p.y, width=x - begin, height=p.height, color=run.look.highlight)
                yield from ops
                yield from self.decoration(layer, run, begin, x, base - run.rise)

    def tab(self, layer: str, p: PlacedLine, run: Run, text: Text, spans: list, k: int | None, x: float, base: float, ops: list[Op]) -> float:
        tabs = p.source.style.get("tabs") or Tabs()
        move = tab_move(text, spans, k, x - p.x, tabs) if k is not None else 0.0
        leader = tabs.next(x - p.x).leader
        if leader in LEADERS:
            glyph = Text([Run(LEADERS[leader], run.size, run.face)]).sums[1]
            n = leader_count(leader, move / glyph) if glyph else 0
            if n > 0:
                ops.append(self.written(layer, run, x, base, LEADERS[leader] * n))
        return x + move

    def stretch(self, layer: str, p: PlacedLine, run: Run, text: Text, s: int, e: int, x: float, base: float, hyphen: bool, ops: list[Op]) -> float:
        ink = text.text[s:e].rstrip(ENDS)
        if not p.spacing:
            if ink:
                ops.append(self.written(layer, run, x, base, ink + "-" * hyphen))
            return x + text.width(s, e)
        for m in _WORDS.finditer(ink):
            if m.group()[0] != " ":
                ops.append(self.written(layer, run, x, base, m.group() + "-" * (hyphen and m.end() == len(ink))))
            x += text.width(s + m.start(), s + m.end()) + (p.spacing if m.group()[0] == " " else 0.0)
        return x

    def decoration(self, layer: str, run: Run, x: float, x2: float, base: float) -> Iterator[Op]:
        k, unit = run.look, run.size / run.face.em

        def rule(off: float, thick: float, color: str | None, style: str) -> Op:
            return Op(layer, "line", x, base + off, x2, base + off, width=max(thick, THINNEST), color=color or k.color or INK, style=style)

        if k.underline:
            off, thick = (v * unit for v in run.face.underline)
            style = k.underline[0] if k.underline[0] in ("dotted", "dashed") else "solid"
            yield rule(off, thick, k.underline[1], style)
            if k.underline[0] == "double":
                yield rule(off + 2 * thick, thick, k.underline[1], style)
        if k.strike:
            off, thick = (v * unit for v in run.face.strikeout)
            yield rule(-off, thick, None, "solid")
            if k.strike == "double":
                yield rule(-off - 2 * thick, thick, None, "solid")

    # ---- rules and tables

    def rule(self, layer: str, rule: Rule | tuple, x: float, y: float, x2: float, y2: float) -> Op:
        rule = Rule(*rule)
        return Op(layer, "line", x, y, x2, y2, width=rule.width, color=rule.color, style=rule.style)

    def rows(self, layer: str, rows: list[PlacedRow]) -> Iterator[Op]:
        for r in rows:
            for c in r.cells:
                if c.fill and c.row_span:
                    yield Op(layer, "rect", r.x + c.x, r.y, width=c.width, height=r.height if c.box is None else c.box, color=c.fill)
        for k, r in enumerate(rows):
            opens = not k or rows[k - 1].block != r.block
            for c in r.cells:
                yield from self.cell_rules(layer, r, c, opens)
        for r in rows:
            for c in r.cells:
                x, y = r.x + c.x + c.margins[0], r.y + c.margins[2]
                for p in c.lines:
                    yield from self.line(layer, p.moved(x, y))
                yield from self.rows(layer, [PlacedRow(i.block, i.index, i.repeated, x + i.x, y + i.y, i.height, i.cells) for i in c.rows])

    def cell_rules(self, layer: str, r: PlacedRow, c, opens: bool) -> Iterator[Op]:
        e, left, right = c.edges, r.x + c.x, r.x + c.x + c.width
        above, below = (e[side].width / 2 if side in e else 0.0 for side in ("top", "bottom"))
        top, bottom = r.y - above, r.y + (r.height if c.box is None else c.box) + below
        if opens and "top" in e:
            yield self.rule(layer, e["top"], left, top, right, top)
        if "bottom" in e:
            yield self.rule(layer, e["bottom"], left, bottom, right, bottom)
        for side, x in (("left", left), ("right", right)):
            if side in e:  # past the horizontal rules, so that corners are full
                yield self.rule(layer, e[side], x, top - above, x, bottom + below)

    def box(self, layer: str, b: Box) -> Iterator[Op]:
        half = {side: b.borders[side][0] / 2 if side in b.borders else 0.0 for side in ("left", "right", "top", "bottom")}
        left, right, top, bottom = b.left - half["left"], b.right + half["right"], b.top - half["top"], b.bottom + half["bottom"]
        across = [("top", b.top)] * b.opens + [("bottom", b.bottom)] * b.closes + [("inside_h", y) for y in b.inner]
        for side, y in across:
            if side in b.borders:
                yield self.rule(layer, b.borders[side], left, y, right, y)
        for side, x in (("left", b.left), ("right", b.right)):
            if side in b.borders:
                yield self.rule(layer, b.borders[side], x, top, x, bottom)

    # ---- pictures and boxes of text

    def image(self, layer: str, p: Picture, x: float, y: float) -> Op:
        return Op(layer, "image", x, y, width=p.width, height=p.height, text=p.description, media=p.media, content=p.content)

    def floats(self, layer: str, floats: list[PlacedFloat]) -> Iterator[Op]:
        for f in floats:
            if f.of.picture:
                yield self.image(layer, f.of.picture, f.x, f.y)
            yield from self.rows(layer, f.rows)
            for p in f.lines:
                yield from self.line(layer, p)

    # ---- a page

    def page(self, page: Page, s: Section) -> Iterator[Op]:
        yield from self.rows("furniture", page.furniture_rows)
        for layer, lines in (("header", page.header), ("footer", page.footer)):
            for p in lines:
                yield from self.line(layer, p)
        yield from self.floats("behind", [f for f in page.floats if f.of.behind])
        yield from self.rows("row", page.rows)
        for p in page.lines:
            yield from self.line("line", p)
        for n, right, y in page.line_numbers:
            run = Run(str(n), s.number_size, MONO)
            yield self.written("number", run, right - Text([run]).sums[-1], y, run.text)
        if page.border:
            left, top, right, bottom = page.border
            yield from self.box("box", Box(s.border_rules, left, top, right, bottom))
        for b in page.boxes:
            yield from self.box("box", b)
        if page.rule is not None:
            yield Op("note", "line", s.geometry.left, page.rule, s.geometry.left + RULE_WIDTH, page.rule, width=THINNEST, color=INK, style="solid")
        for p in page.footnotes:
            yield from self.line("note", p)
        yield from self.floats("front", [f for f in page.floats if not f.of.behind])


def shown_lines(page: Page) -> Iterator[tuple[str, int, int, PlacedLine]]:
    """(layer, block, line, placed line) of all text of a page, in paint order; a table's lines have the block and the row of their outermost table."""

    def of_rows(layer: str, rows: list[PlacedRow], x: float = 0.0, y: float = 0.0, at: tuple[int, int] | None = None):
        for r in rows:
            for c in r.cells:
                dx, dy = x + r.x + c.x + c.margins[0], y + r.y + c.margins[2]
                place = at or (r.block, r.index)
                for p in c.lines:
                    yield layer, *place, p.moved(dx, dy)
                yield from of_rows(layer, c.rows, dx, dy, place)

    yield from of_rows("furniture", page.furniture_rows)
    for layer, lines in (("header", page.header), ("footer", page.footer)):
        yield from ((layer, p.block, p.index, p) for p in lines)
    yield from of_rows("row", page.rows)
    yield from (("line", p.block, p.index, p) for p in page.lines)
    yield from (("note", p.block, p.index, p) for p in page.footnotes)
    for f in page.floats:
        yield from of_rows("float", f.rows)
        yield from (("float", p.block, p.index, p) for p in f.lines)
