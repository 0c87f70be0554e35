"""Word-processing packages: styles, lists and the body as records, laid out by the kernel. Plain Python but for the operators at the end.

Null (None) means "not stated": a later statement wins over an earlier one only where it states something, and an
explicit off is a value of its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.operators.display import Op, Painter, shown_lines
from leafmill.operators.flow import milli, text_between
from leafmill.operators.lines import MONO, OBJECT, Face, Look, Paragraph, Picture, Run, Stop, Tabs, Text
from leafmill.operators.pages import Cell, Float, Geometry, Page, Row, Rule, Table, natural, standoff
from leafmill.operators.sections import LineNumbers, Section, layout_sections, shown
from leafmill.plans.session import ship
from leafmill.sources import opc, xml

#: Pixels of a twip and of a half point; script size, rise and drop; small capitals; the page that is not stated, in twips.
TWIP, HALF_POINT = 96 / 1440, 96 / 144
SCRIPT, SUPER_RISE, SUB_DROP, SMALL_CAPS = 0.58, 0.395, 0.09, 0.8
PAGE_WIDTH, PAGE_HEIGHT, PAGE_MARGIN = 11906, 16838, 1440
#: Spaces that built-in headings have where none is stated, and size of runs where a styles part states none, in half points.
HEADING_BEFORE, HEADING_AFTER, UNSTATED_SIZE, UNSTATED_FAMILY = 240, 120, 20, "Liberation Serif"
CELL_MARGIN = 115
#: Fixed value: how far line numbers stand off where nothing says, half a centimetre in pixels.
LINE_NUMBER_GAP = 0.5 / 2.54 * 96


def number(t: xml.Tree, n: xml.Node | None, name: str) -> float | None:
    try:
        return float(t.attribute(n, name))
    except (TypeError, ValueError):
        return None


def toggle(t: xml.Tree, parent: xml.Node | None, name: str) -> bool | None:
    """None if absent; on without a value; off for 0, false and off."""
    n = t.child(parent, name)
    return None if n is None else (t.attribute(n, "val") or "1") not in ("0", "false", "off")


def stated(**values) -> dict:
    return {k: v for k, v in values.items() if v is not None}


#: Alignment names; unknown ones state nothing.
ALIGNMENTS = {"left": "left", "start": "left", "center": "center", "right": "right", "end": "right", "both": "justify", "distribute": "justify"}
STOPS = {"left": "left", "num": "left", "start": "left", "center": "center", "right": "right", "end": "right", "decimal": "decimal"}


def paragraph_properties(t: xml.Tree, n: xml.Node | None) -> dict:
    if n is None:
        return {}
    spacing, indent = t.child(n, "spacing"), t.child(n, "ind")
    first, hanging = number(t, indent, "firstLine"), number(t, indent, "hanging")
    either = lambda a, b: number(t, indent, a) if number(t, indent, a) is not None else number(t, indent, b)
    tabs = t.child(n, "tabs")
    stops = None
    if tabs is not None:
        found = [(number(t, s, "pos"), STOPS.get(t.attribute(s, "val", "")), t.attribute(s, "leader")) for s in t.children(tabs, "tab")]
        stops = tuple(sorted((x for x in found if x[0] is not None and x[1]), key=lambda x: x[0]))
    rule = t.attribute(spacing, "lineRule")
    return stated(
        before=number(t, spacing, "before"), after=number(t, spacing, "after"), line=number(t, spacing, "line"), rule=rule if rule in ("auto", "exact", "atLeast") else None,
        left=either("left", "start"), right=either("right", "end"), first=first if hanging is None else -hanging,
        page_break=toggle(t, n, "pageBreakBefore"), keep_lines=toggle(t, n, "keepLines"), keep_next=toggle(t, n, "keepNext"), widow=toggle(t, n, "widowControl"),
        contextual=toggle(t, n, "contextualSpacing"), stops=stops, alignment=ALIGNMENTS.get(t.attribute(t.child(n, "jc"), "val", "")),
    )


#: How underlines and rules are drawn, by their names; what is not named is single, and solid. Colours of highlights.
UNDERLINES = {"double": "double", "wavyDouble": "double", "dotted": "dotted", "dottedHeavy": "dotted", "dash": "dashed", "dashedHeavy": "dashed", "dashLong": "dashed", "dotDash": "dashed", "dotDotDash": "dashed"}
RULES = {"dashed": "dashed", "dashSmallGap": "dashed", "dotted": "dotted", "dotDash": "dashed", "dotDotDash": "dashed", "double": "double", "triple": "double"}
HIGHLIGHTS = {
    "black": "#000000", "blue": "#0000FF", "cyan": "#00FFFF", "darkBlue": "#000080", "darkCyan": "#008080", "darkGray": "#808080", "darkGreen": "#008000", "darkMagenta": "#800080", "darkRed": "#800000", "darkYellow": "#808000",
    "green": "#00FF00", "lightGray": "#C0C0C0", "magenta": "#FF00FF", "red": "#FF0000", "white": "#FFFFFF", "yellow": "#FFFF00",
}


def color_of(t: xml.Tree, n: xml.Node | None, name: str, auto: str | None = None) -> str | None:
    """A stated colour; auto where it says so."""
    value = t.attribute(n, name)
    return None if value is None else auto if value == "auto" else f"#{value}"


def underline_of(t: xml.Tree, n: xml.Node | None) -> tuple[str, str | None] | None:
    value = t.attribute(n, "val")
    return None if value in (None, "none") else (UNDERLINES.get(value, "single"), color_of(t, n, "color"))


def strike_of(t: xml.Tree, n: xml.Node) -> str | None:
    return "double" if toggle(t, n, "dstrike") else "single" if toggle(t, n, "strike") else None


def rule_of(t: xml.Tree, n: xml.Node | None) -> Rule | None:
    """A border's side; nil and none state nothing."""
    value = t.attribute(n, "val")
    if value in (None, "nil", "none"):
        return None
    width = number(t, n, "sz")
    return Rule((width if width and width > 0 else RULE_EIGHTHS) / 8 * 96 / 72, (number(t, n, "space") or 0) * 96 / 72, color_of(t, n, "color", "#000000") or "#000000", RULES.get(value, "solid"))


def run_properties(t: xml.Tree, n: xml.Node | None) -> dict:
    if n is None:
        return {}
    fonts = t.child(n, "rFonts")
    script = t.attribute(t.child(n, "vertAlign"), "val")
    return stated(
        family=t.attribute(fonts, "ascii") or t.attribute(fonts, "hAnsi"), size=number(t, t.child(n, "sz"), "val"), bold=toggle(t, n, "b"), italic=toggle(t, n, "i"),
        caps=toggle(t, n, "caps"), small_caps=toggle(t, n, "smallCaps"), hidden=toggle(t, n, "vanish"), spacing=number(t, t.child(n, "spacing"), "val"),
        script=script if script in ("superscript", "subscript", "baseline") else None, position=number(t, t.child(n, "position"), "val"),
        color=color_of(t, t.child(n, "color"), "val", "#000000"), underline=underline_of(t, t.child(n, "u")), strike=strike_of(t, n), kerned=kerned_of(t, t.child(n, "kern")),
        highlight=HIGHLIGHTS.get(t.attribute(t.child(n, "highlight"), "val", "")) or color_of(t, t.child(n, "shd"), "fill"),
    )


def kerned_of(t: xml.Tree, n: xml.Node | None) -> bool | None:
    """Kerning is on from a size on; from 0 it is off."""
    return None if n is None else (1 if number(t, n, "val") is None else number(t, n, "val")) > 0


@dataclass
class Style:
    id: str
    name: str
    kind: str
    based_on: str | None
    paragraph: dict
    run: dict
    num: tuple[str | None, int | None]
    table: xml.Node | None = None  # properties of tables
    conditions: dict[str, tuple[dict, dict, xml.Node | None]] = field(default_factory=dict)  # paragraph, run and cell properties of parts of a table


@dataclass
class Styles:
    by_id: dict[str, Style] = field(default_factory=dict)
    default: dict[str, str] = field(default_factory=dict)
    paragraph: dict = field(default_factory=dict)
    run: dict = field(default_factory=dict)
    tree: xml.Tree | None = None

    def table_chain(self, style: str | None) -> list[Style]:
        return [s for s in self.chain(style) if s.kind == "table"]

    def conditions(self, style: str | None) -> dict[str, tuple[dict, dict, xml.Node | None]]:
        """Of each part of a table what the style and those it is based on state; cell properties are those of the nearest."""
        out: dict[str, tuple[dict, dict, xml.Node | None]] = {}
        for s in self.table_chain(style):
            for part, (p, r, cell) in s.conditions.items():
                under = out.get(part, ({}, {}, None))
                out[part] = (under[0] | p, under[1] | r, cell or under[2])
        return out

    def chain(self, style: str | None) -> list[Style]:
        """The style and what it is based on, root first; a missing style or a circle ends the way."""
        out: list[Style] = []
        while style in self.by_id and all(s.id != style for s in out):
            out.append(self.by_id[style])
            style = out[-1].based_on
        return out[::-1]


#: Names of a paragraph's border sides; width of a rule that states none, in eighths of a point.
SIDES = {"top": "top", "left": "left", "start": "left", "bottom": "bottom", "right": "right", "end": "right", "between": "inside_h"}
RULE_EIGHTHS = 4


def borders_of(t: xml.Tree, n: xml.Node | None, sides: dict[str, str] = SIDES) -> dict[str, Rule]:
    """Side -> rule of what states one."""
    found = [(sides.get(c.name.rsplit(":", 1)[-1]), rule_of(t, c)) for c in (t.children(n) if n else [])]
    return {side: rule for side, rule in found if side and rule}


#: Names of a table's border sides.
TABLE_SIDES = {"top": "top", "left": "left", "start": "left", "bottom": "bottom", "right": "right", "end": "right", "insideH": "inside_h", "insideV": "inside_v"}
#: The look of a table that states none, and its bits.
LOOK, FIRST_ROW, LAST_ROW, FIRST_COLUMN, LAST_COLUMN, NO_ROW_BANDS, NO_COLUMN_BANDS = 0x1E0, 0x20, 0x40, 0x80, 0x100, 0x200, 0x400


def parts_of(look: int, row: int, rows: int, column: int, columns: int) -> list[str]:
    """The parts of a table that a cell belongs to, in the order in which later ones win."""
    edge = lambda bit, at, n: bool(look & bit) and at == n
    first_row, last_row = edge(FIRST_ROW, row, 0), edge(LAST_ROW, row, rows - 1)
    first_col, last_col = edge(FIRST_COLUMN, column, 0), edge(LAST_COLUMN, column, columns - 1)
    band = lambda off, at, first, kind: [] if off else [f"band{1 + (at - bool(first)) % 2}{kind}"]
    bands = band(look & NO_ROW_BANDS or first_row or last_row, row, look & FIRST_ROW, "Horz") + band(look & NO_COLUMN_BANDS or first_col or last_col, column, look & FIRST_COLUMN, "Vert")
    return bands + [name for name, on in (("firstCol", first_col), ("lastCol", last_col), ("lastRow", last_row), ("firstRow", first_row)) if on]


def list_of(t: xml.Tree, n: xml.Node | None) -> tuple[str | None, int | None]:
    p = t.child(n, "numPr")
    level = number(t, t.child(p, "ilvl"), "val")
    return t.attribute(t.child(p, "numId"), "val"), None if level is None else int(level)


def read_styles(content: str | None) -> Styles:
    if content is None:
        return Styles(run={"size": 22.0})
    t = xml.parse(content)
    out = Styles(run={"size": float(UNSTATED_SIZE), "family": UNSTATED_FAMILY}, tree=t)
    for d in t.elements("docDefaults"):
        out.paragraph = paragraph_properties(t, t.child(t.child(d, "pPrDefault"), "pPr"))
        out.run |= run_properties(t, t.child(t.child(d, "rPrDefault"), "rPr"))
    for s in t.elements("style"):
        id_, kind = t.attribute(s, "styleId", ""), t.attribute(s, "type", "paragraph")
        p = t.child(s, "pPr")
        out.by_id[id_] = Style(id_, t.attribute(t.child(s, "name"), "val", ""), kind, t.attribute(t.child(s, "basedOn"), "val"), paragraph_properties(t, p), run_properties(t, t.child(s, "rPr")), list_of(t, p), t.child(s, "tblPr"))
        for c in t.children(s, "tblStylePr"):
            out.by_id[id_].conditions[t.attribute(c, "type", "")] = (paragraph_properties(t, t.child(c, "pPr")), run_properties(t, t.child(c, "rPr")), t.child(c, "tcPr"))
        if t.attribute(s, "default") in ("1", "true"):
            out.default[kind] = id_
    return out


# ---- lists


@dataclass(frozen=True)
class Level:
    start: int
    format: str
    text: str
    restart: int | None
    left: float | None
    hanging: float | None
    suffix: str = "tab"  # space, nothing
    justification: str = "left"
    family: str | None = None


@dataclass
class Lists:
    abstract: dict[str, dict[int, Level]] = field(default_factory=dict)
    instance: dict[str, str] = field(default_factory=dict)
    override: dict[tuple[str, int], Level | None] = field(default_factory=dict)
    begin: dict[tuple[str, int], int] = field(default_factory=dict)

    def level(self, num: str, i: int) -> Level | None:
        return self.override.get((num, i)) or self.abstract.get(self.instance.get(num, ""), {}).get(i)


def read_level(t: xml.Tree, n: xml.Node) -> Level:
    value = lambda name: t.attribute(t.child(n, name), "val")
    indent = t.child(t.child(n, "pPr"), "ind")
    restart = value("lvlRestart")
    return Level(int(value("start") or 1), value("numFmt") or "decimal", value("lvlText") or "", None if restart is None else int(restart), number(t, indent, "left"), number(t, indent, "hanging"), value("suff") or "tab", {"right": "right", "end": "right", "center": "center"}.get(value("lvlJc") or "", "left"), t.attribute(t.child(t.child(n, "rPr"), "rFonts"), "ascii"))


def read_lists(content: str | None) -> Lists:
    out = Lists()
    if content is None:
        return out
    t = xml.parse(content)
    for a in t.elements("abstractNum"):
        out.abstract[t.attribute(a, "abstractNumId", "")] = {int(t.attribute(n, "ilvl", "0")): read_level(t, n) for n in t.children(a, "lvl")}
    for n in t.elements("num"):
        id_ = t.attribute(n, "numId", "")
        out.instance[id_] = t.attribute(t.child(n, "abstractNumId"), "val", "")
        for o in t.children(n, "lvlOverride"):
            i = int(t.attribute(o, "ilvl", "0"))
            if (own := t.child(o, "lvl")) is not None:
                out.override[id_, i] = read_level(t, own)
            if (begin := t.attribute(t.child(o, "startOverride"), "val")) is not None:
                out.begin[id_, i] = int(begin)
    return out


class Counters:
    """Where each list stands. Instances of one abstract list count on together."""

    def __init__(self, lists: Lists):
        self.lists, self.at, self.used = lists, {}, set()

    def marker(self, num: str, i: int) -> str:
        level = self.lists.level(num, i)
        if level is None:
            return ""
        if level.format in ("bullet", "none"):
            return level.text
        counts = self.at.setdefault(self.lists.instance.get(num, num), {})
        if (num, i) in self.lists.begin and (num, i) not in self.used:
            self.used.add((num, i))
            counts[i] = self.lists.begin[num, i] - 1
        counts[i] = counts.get(i, level.start - 1) + 1
        for deeper in [d for d in counts if d > i]:
            below = self.lists.level(num, deeper)
            if below is None or below.restart != 0:
                del counts[deeper]
        out = level.text
        for k in range(9, 0, -1):
            if f"%{k}" in out:
                other = self.lists.level(num, k - 1)
                out = out.replace(f"%{k}", shown(counts.get(k - 1, other.start if other else 1), other.format if other else level.format))
        return out


# ---- the body


@dataclass
class Document:
    sections: list[Section]
    markers: dict[int, str]
    styles_of: list[str | None]
    notes: list[tuple[str, str]]

    @property
    def blocks(self) -> list:
        return [b for s in self.sections for b in s.blocks]

    @property
    def geometry(self) -> Geometry:
        return self.sections[-1].geometry


#: Numerals that page numbers and fields can ask for.
PAGE_NUMERALS = {"lowerRoman": "lowerRoman", "upperRoman": "upperRoman", "lowerLetter": "lowerLetter", "upperLetter": "upperLetter", "roman": "lowerRoman", "ROMAN": "upperRoman", "alphabetic": "lowerLetter", "ALPHABETIC": "upperLetter"}


def field_of(instruction: str) -> tuple[str | None, str | None]:
    """(page or pages, how it is written) of a field's instruction; other fields are None."""
    words = instruction.split()
    kind = {"PAGE": "page", "NUMPAGES": "pages"}.get(words[0].upper()) if words else None
    written = [PAGE_NUMERALS[w] for a, w in zip(words, words[1:], strict=False) if a == "\\*" and w in PAGE_NUMERALS]
    return kind, written[0] if written else None


class Reader:
    def __init__(self, styles: Styles, lists: Lists, parts: dict[str, str] | None = None, footnotes: str | None = None, endnotes: str | None = None, settings: str | None = None, faces: dict[tuple[str, bool, bool], Face] | None = None, media: dict[str, tuple[bytes, str]] | None = None):
        """parts: content of headers and footers by relationship id. media: content and type of pictures by the same. faces: by family (in lower case), bold, italic; what is missing is set in the monospaced face."""
        self.media, self.floats = media or {}, []
        self.faces, self.lent = faces or {}, ({}, {})  # paragraph and run properties that a table's style lends to its cells
        self.styles, self.lists, self.counters = styles, lists, Counters(lists)
        self.parts, self.bodies = parts or {}, {"footnote": footnotes, "endnote": endnotes}
        self.notes: list[tuple[str, str]] = []
        self.markers: dict[int, str] = {}
        self.numbers: dict[str, dict[str, int]] = {"footnote": {}, "endnote": {}}  # by first reference
        t = xml.parse(settings) if settings else None
        root = t.nodes[next(n.id for n in t.nodes if n.kind == "element")] if t else None
        self.even_odd = bool(t and toggle(t, root, "evenAndOddHeaders"))
        step = number(t, t.child(root, "defaultTabStop"), "val") if t else None
        self.step = 48.0 if step is None else step * TWIP

    def note(self, kind: str, detail: str) -> None:
        if (kind, detail) not in self.notes:
            self.notes.append((kind, detail))

    def read(self, content: str) -> Document:
        t = self.t = xml.parse(content)
        body = next(t.elements("body"), None)
        blocks, names, ends = [], [], []
        for n in self.through(body) if body else []:
            kind = n.name.rsplit(":", 1)[-1]
            if kind == "p":
                for p, style in self.paragraph(n, len(blocks)):
                    blocks.append(p)
                    names.append(style)
                if (end := t.child(t.child(n, "pPr"), "sectPr")) is not None:
                    ends.append((len(blocks), end))
            elif kind == "tbl":
                blocks.append(self.table(n))
                names.append(None)
            elif kind == "sectPr":
                ends.append((len(blocks), n))
            else:
                self.note("not read", kind)
        self.contextual(blocks, names)
        if not ends or ends[-1][0] < len(blocks):
            ends.append((len(blocks), None))
        sections, at, refs = [], 0, {"header": {}, "footer": {}}
        for end, n in ends:
            for kind, known in refs.items():  # what a section does not state it has from the one before
                known |= {t.attribute(r, "type", "default"): t.attribute(r, "id", "") for r in (t.children(n, f"{kind}Reference") if n else [])}
            if sections and n is not None and t.attribute(t.child(n, "type"), "val") == "continuous":
                self.note("continuous section", "goes on in the one before")
                sections[-1].blocks += blocks[at:end]
            else:
                sections.append(self.section(n, blocks[at:end], refs))
            at = end
        notes = self.note_blocks("footnote")
        for s in sections:
            s.notes = notes
        sections[-1].blocks += [b for _, bs in sorted(self.note_blocks("endnote").items()) for b in bs]
        return Document(sections, self.markers, names, self.notes)

    def section(self, n: xml.Node | None, blocks: list, refs: dict[str, dict[str, str]]) -> Section:
        t = self.t
        numbers, lines, margins = t.child(n, "pgNumType"), t.child(n, "lnNumType"), t.child(n, "pgMar")
        start = number(t, numbers, "start")
        s = Section(blocks, geometry_of(t, n), t.attribute(t.child(n, "type"), "val", "nextPage"), None if start is None else int(start), PAGE_NUMERALS.get(t.attribute(numbers, "fmt", ""), "decimal"))
        s.title_page, s.even_odd = bool(toggle(t, n, "titlePg")) if n else False, self.even_odd
        s.header_at, s.footer_at = ((number(t, margins, k) or 0) * TWIP for k in ("header", "footer"))
        s.headers, s.footers = ({k: self.inner(self.parts[r]) for k, r in refs[kind].items() if r in self.parts} for kind in ("header", "footer"))
        for kind in ("header", "footer"):
            for r in refs[kind].values():
                if r not in self.parts:
                    self.note("missing part", r)
        if borders := borders_of(t, edge := t.child(n, "pgBorders")):
            s.border_from = "page" if t.attribute(edge, "offsetFrom") == "page" else "text"
            s.border, s.border_rules = {side: standoff(rule) for side, rule in borders.items()}, borders
        if lines is not None:
            s.line_numbers = LineNumbers(t.attribute(lines, "restart", "newPage"), int(number(t, lines, "start") or 0), int(number(t, lines, "countBy") or 1), LINE_NUMBER_GAP if number(t, lines, "distance") is None else number(t, lines, "distance") * TWIP)
        return s

    def inner(self, content: str, root: xml.Node | None = None, t: xml.Tree | None = None) -> list:
        """Blocks of another part; its lists count on with the body's."""
        outer = self.t
        self.t = t or xml.parse(content)
        root = root or next(n for n in self.t.nodes if n.kind == "element")
        out = []
        for n in self.through(root):
            kind = n.name.rsplit(":", 1)[-1]
            if kind == "p":
                out += [p for p, _ in self.paragraph(n, -1)]
            elif kind == "tbl":
                out.append(self.table(n))
        self.markers.pop(-1, None)
        self.t = outer
        return out

    def note_blocks(self, kind: str) -> dict[int, list]:
        """Number -> blocks of the notes that are referred to; references without a note are reported."""
        if not self.numbers[kind]:
            return {}
        out: dict[int, list] = {}
        t = xml.parse(self.bodies[kind]) if self.bodies[kind] else None
        by_id = {t.attribute(n, "id"): n for n in t.elements(kind)} if t else {}
        for id_, n in list(self.numbers[kind].items()):
            if id_ not in by_id:
                self.note(f"missing {kind}", id_)
                continue
            self.inside = self.mark(kind, n)
            out[n] = self.inner("", by_id[id_], t)
        return out

    def mark(self, kind: str, n: int) -> str:
        return str(n) if kind == "footnote" else shown(n, "lowerRoman")

    def through(self, n: xml.Node) -> Iterator[xml.Node]:
        """Children, those of content controls in their place."""
        for c in self.t.children(n):
            kind = c.name.rsplit(":", 1)[-1]
            if kind == "sdt":
                inner = self.t.child(c, "sdtContent")
                if inner is not None:
                    yield from self.through(inner)
            elif kind in ("ins", "moveTo", "smartTag", "hyperlink"):
                yield from self.through(c)
            elif kind in ("del", "moveFrom"):
                self.note("revision", kind)
            else:
                yield c

    def paragraph(self, n: xml.Node, at: int) -> list[tuple[Paragraph, str | None]]:
        """The paragraph, in as many parts as page breaks in it make."""
        t, p = self.t, self.t.child(n, "pPr")
        style = t.attribute(t.child(p, "pStyle"), "val")
        style = style if style in self.styles.by_id else self.styles.default.get("paragraph")
        chain = self.styles.chain(style)
        props, run = self.styles.paragraph | self.lent[0], self.styles.run | self.lent[1]
        num, level, marker = None, None, None
        for s in chain:
            props |= s.paragraph
            run |= s.run
            num, level = s.num[0] or num, s.num[1] if s.num[1] is not None else level
        own_num, own_level = list_of(t, p)
        num, level = own_num or num, own_level if own_level is not None or own_num else level
        info = self.lists.level(num, level or 0) if num and num != "0" else None
        if info:
            props |= stated(left=info.left, first=None if info.hanging is None else -info.hanging)
            self.markers[at] = marker = self.counters.marker(num, level or 0)
        elif num and num != "0":
            self.note("unknown list", num)
        props |= paragraph_properties(t, p)
        if chain and chain[-1].name.lower().startswith("heading ") and chain[-1].name[8:] in tuple("123456789") and "before" not in props and "after" not in props:
            props |= {"before": HEADING_BEFORE, "after": HEADING_AFTER}
        outer, self.floats = self.floats, []
        parts = self.runs(n, run)
        floats, self.floats = self.floats, outer
        out = []
        for k, runs in enumerate(parts):
            s = pixels(props, self.step)
            if props.get("line") and props.get("rule", "auto") == "auto":  # a multiple of single spacing, in 240ths
                s |= {"line_height": natural(runs or [self.run("", run)])[0] * props["line"] / 240, "line_rule": "auto"}
            if floats and not k:
                s["floats"] = floats
            if marker and not k:
                self.place_marker(s, info, self.run(marker, run | ({"family": info.family} if info.family else {})))
            if borders := borders_of(t, t.child(p, "pBdr")):  # stated on the paragraph itself only
                s["borders"] = borders
            if k:
                s |= {"before": 0.0, "indent_first": 0.0, "break_before": True}
            if k < len(parts) - 1:
                s |= {"after": 0.0, "keep_next": False}
            out.append((Paragraph(runs or [self.run("", run)], s), style))
        return out

    def place_marker(self, s: dict, level: Level, run: Run) -> None:
        """Puts a list's marker beside the paragraph of style s, and its text behind it: at the stop that a tab leads to, after a space, or at once."""
        indent, hanging = s["indent_left"], max(0.0, -s["indent_first"])
        width = Text([run]).sums[-1]
        left = indent - hanging - {"right": width, "center": width / 2}.get(level.justification, 0.0)
        behind = left + width
        if level.suffix == "tab":
            tabs = s.get("tabs") or Tabs((), self.step)
            stops = [x.at for x in tabs.stops if x.at >= behind] or [math.ceil(behind / self.step) * self.step if self.step > 0 else behind]
            begin = min([*stops, *([indent] if indent >= behind else [])])
        else:
            begin = max(indent, behind + (Text([replace(run, text=" ")]).sums[-1] if level.suffix == "space" else 0.0))
        s["marker"] = (run, indent - left)
        s["indent_first"] = math.floor((begin - indent) / TWIP + 0.5) * TWIP

    def runs(self, n: xml.Node, base: dict) -> list[list[Run]]:
        t, parts, state, instruction = self.t, [[]], "", ""
        runs = []
        for r in self.through(n):
            kind = r.name.rsplit(":", 1)[-1]
            if kind == "fldSimple":
                simple = field_of(t.attribute(r, "instr", ""))
                inner = [c for c in self.through(r) if c.name.rsplit(":", 1)[-1] == "r"]
                runs += [(c, simple if k == 0 and simple[0] else None) for k, c in enumerate(inner) if k == 0 or not simple[0]]
            elif kind == "r":
                runs.append((r, None))
        for r, simple in runs:
            own = t.child(r, "rPr")
            props = dict(base)
            for s in self.styles.chain(t.attribute(t.child(own, "rStyle"), "val")):
                props |= s.run
            props |= run_properties(t, own)
            if props.get("hidden"):
                continue
            text = ""
            if simple:
                self.add(parts[-1], "1", props, field=simple[0], numeral=simple[1])
                continue
            for c in t.children(r):
                kind = c.name.rsplit(":", 1)[-1]
                if kind == "fldChar":
                    state = t.attribute(c, "fldCharType", "")
                    if state == "begin":
                        instruction = ""
                    elif state == "separate" and field_of(instruction)[0]:
                        field, numeral = field_of(instruction)
                        self.add(parts[-1], "1", props, field=field, numeral=numeral)
                elif kind == "instrText":
                    instruction += t.value(c)
                elif kind == "t":
                    # what a page field showed last is left out: it is shown anew
                    if state in ("", "end") or (state == "separate" and not field_of(instruction)[0]):
                        text += t.value(c)
                elif kind in ("footnoteReference", "endnoteReference"):
                    what = kind.removesuffix("Reference")
                    n_ = self.numbers[what].setdefault(t.attribute(c, "id", ""), len(self.numbers[what]) + 1)
                    self.add(parts[-1], text, props)
                    text = ""
                    self.add(parts[-1], self.mark(what, n_), props | {"script": "superscript"}, note=n_ if what == "footnote" else None)
                elif kind in ("footnoteRef", "endnoteRef"):
                    text += getattr(self, "inside", "")
                elif kind == "sym":
                    code = int(t.attribute(c, "char", "20"), 16)
                    text += chr(code - 0xF000 if 0xF000 <= code <= 0xF0FF else code)
                elif kind == "br" and t.attribute(c, "type") == "page":
                    self.add(parts[-1], text, props)
                    text = ""
                    parts.append([])
                elif kind in ("br", "cr"):
                    text += "\n"
                elif kind in ("tab", "noBreakHyphen", "softHyphen"):
                    text += {"tab": "\t", "noBreakHyphen": "‑", "softHyphen": "­"}[kind]
                elif kind in ("drawing", "pict"):
                    found = self.drawing(c) if kind == "drawing" else self.vml(c)
                    if isinstance(found, Picture):
                        self.add(parts[-1], text, props)
                        text = ""
                        parts[-1].append(replace(self.run(OBJECT, props), picture=found))
                    elif found:
                        self.floats.append(found)
                    else:
                        self.note("not drawn", kind)
                elif kind == "object":
                    self.note("not drawn", kind)
            self.add(parts[-1], text, props)
        return parts

    def run(self, text: str, props: dict, scale: float = 1.0, **what) -> Run:
        """A run of a text as its properties say."""
        size, script = props["size"] * HALF_POINT, props.get("script")
        bold, italic, family = bool(props.get("bold")), bool(props.get("italic")), props.get("family")
        rise = (props.get("position") or 0) * HALF_POINT + {"superscript": size * SUPER_RISE, "subscript": -size * SUB_DROP}.get(script, 0.0)
        look = Look(props.get("color"), props.get("highlight"), props.get("underline"), props.get("strike"), family, bold, italic)
        face = self.faces.get(((family or "").strip().lower(), bold, italic), MONO)
        return Run(text, size * (SCRIPT if script in ("superscript", "subscript") else 1.0) * scale, face, (props.get("spacing") or 0) * TWIP, bool(props.get("kerned")), look=look, rise=rise, **what)

    def add(self, runs: list[Run], text: str, props: dict, **what) -> None:
        if not text:
            return
        if what or not (props.get("caps") or props.get("small_caps")):
            runs.append(self.run(text, props, **what))
        elif props.get("caps"):
            runs.append(self.run(text.upper(), props))
        else:
            for small, letters in groupby(text, lambda c: c != c.upper()):
                runs.append(self.run("".join(letters).upper(), props, SMALL_CAPS if small else 1.0))

    # ---- pictures and boxes of text

    def within(self, n: xml.Node | None, name: str) -> xml.Node | None:
        """The first element of a name anywhere under a node."""
        return next(self.t.elements(name, n.id), None) if n else None

    def picture(self, id_: str | None, width: float, height: float, description: str | None) -> Picture | None:
        if id_ is not None and id_ not in self.media:
            self.note("missing picture", id_)
        return Picture(width, height, *self.media[id_], description) if id_ in self.media else None

    def box_blocks(self, n: xml.Node | None) -> list:
        """Blocks of a box of text, none without one."""
        content, floats = self.within(n, "txbxContent"), self.floats
        out = self.inner("", content, self.t) if content else []
        self.floats = floats
        return out

    def drawing(self, n: xml.Node) -> Picture | Float | None:
        t = self.t
        frame = t.child(n, "inline") or t.child(n, "anchor")
        extent = t.child(frame, "extent")
        width, height = ((number(t, extent, k) or 0) * EMU for k in ("cx", "cy"))
        picture = self.picture(t.attribute(self.within(frame, "blip"), "embed"), width, height, t.attribute(t.child(frame, "docPr"), "descr"))
        if frame is None or not frame.name.endswith("anchor"):
            return picture
        blocks = [] if picture else self.box_blocks(frame)
        if not picture and not blocks:
            return None
        body = self.within(frame, "bodyPr")
        inset = tuple((INSETS[k] if number(t, body, k) is None else number(t, body, k)) * EMU for k in INSETS)

        def position(name: str, default: str) -> tuple[str, float, str | None]:
            p = t.child(frame, name)
            off, align = t.child(p, "posOffset"), t.child(p, "align")
            start = RELATIVE.get(t.attribute(p, "relativeFrom", ""), default)
            return start, float(t.value(off) or 0) * EMU if off else 0.0, t.value(align).strip() if align else None

        clear = tuple((number(t, frame, k) or 0) * EMU for k in ("distL", "distT", "distR", "distB"))
        return Float(width, height, picture, blocks, inset, position("positionH", "column"), position("positionV", "column")[:2], clear, t.child(frame, "wrapNone") is None, (t.attribute(frame, "behindDoc") or "0") in ("1", "true"))

    def vml(self, n: xml.Node) -> Picture | None:
        """An older picture, of the size that its shape's style states."""
        shape = self.within(n, "shape") or self.within(n, "rect")
        style = dict(x.split(":", 1) for x in self.t.attribute(shape, "style", "").replace(" ", "").split(";") if ":" in x)
        return self.picture(self.t.attribute(self.within(n, "imagedata"), "id"), css_px(style.get("width")), css_px(style.get("height")), self.t.attribute(shape, "alt"))

    def table(self, n: xml.Node) -> Table:
        t, p = self.t, self.t.child(n, "tblPr")
        style, outer = t.attribute(t.child(p, "tblStyle"), "val"), self.lent
        chain = self.styles.table_chain(style)
        levels = [(self.styles.tree, s.table) for s in chain] + [(t, p)]
        self.lent = tuple({k: v for s in chain for k, v in getattr(s, kind).items()} for kind in ("paragraph", "run"))
        conditions = self.styles.conditions(style)
        try:
            look = int(t.attribute(t.child(p, "tblLook"), "val", ""), 16)
        except ValueError:
            look = LOOK
        grid = [number(t, c, "w") or 0.0 for c in t.children(t.child(n, "tblGrid"), "gridCol")] if t.child(n, "tblGrid") else []
        width = t.child(p, "tblW")
        kind, asked = t.attribute(width, "type", ""), number(t, width, "w")
        rows, found = [r for r in self.through(n) if r.name.rsplit(":", 1)[-1] == "tr"], []
        for r in rows:
            rp, cells = t.child(r, "trPr"), []
            for c in (c for c in self.through(r) if c.name.rsplit(":", 1)[-1] == "tc"):
                cells.append(self.cell(c, [conditions[k] for k in parts_of(look, len(found), len(rows), len(cells), len(grid)) if k in conditions]))
            height = t.child(rp, "trHeight")
            stated_height = number(t, height, "val")
            found.append(Row(cells, toggle(t, rp, "tblHeader") or False, toggle(t, rp, "cantSplit") or False, None if stated_height is None else stated_height * TWIP, t.attribute(height, "hRule") == "exact"))
        self.markers.pop(-1, None)
        self.lent = outer
        margins = [CELL_MARGIN, CELL_MARGIN, 0.0, 0.0]
        for tree, level in levels:
            own = margins_of(tree, tree.child(level, "tblCellMar")) if tree else {}
            margins = [own.get(side, m) for side, m in zip(MARGINS, margins, strict=True)]
        for r in found:
            for c in r.cells:
                if c.margins:  # what a cell does not state is its table's
                    c.margins = tuple((m if own is None else own) * TWIP for own, m in zip(c.margins, margins, strict=True))
        borders: dict[str, Rule] = {}
        for tree, level in levels:
            borders |= borders_of(tree, tree.child(level, "tblBorders"), TABLE_SIDES) if tree else {}
        indent = t.child(p, "tblInd")
        return Table(
            found, [w * TWIP for w in self.column_widths(rows, grid, asked if kind == "dxa" else None)], tuple(m * TWIP for m in margins), borders, color_of(t, t.child(p, "shd"), "fill"),
            preferred=asked * TWIP if kind == "dxa" and asked else None, fraction=asked / 5000 if kind == "pct" and asked else None,
            alignment={"center": "center", "right": "right", "end": "right"}.get(t.attribute(t.child(p, "jc"), "val", ""), "left"),
            indent=None if indent is None else (number(t, indent, "w") or 0) * TWIP if t.attribute(indent, "type", "dxa") == "dxa" else 0.0,
        )

    def cell(self, n: xml.Node, applying: list[tuple[dict, dict, xml.Node | None]]) -> Cell:
        """A cell; applying: what the parts of the table that it belongs to lend it, the last one winning."""
        t, p, outer = self.t, self.t.child(n, "tcPr"), self.lent
        for paragraph, run, _ in applying:
            self.lent = (self.lent[0] | paragraph, self.lent[1] | run)
        blocks, names = [], []
        for b in self.through(n):
            kind = b.name.rsplit(":", 1)[-1]
            if kind == "p":
                for x, style in self.paragraph(b, -1):
                    blocks.append(x)
                    names.append(style)
            elif kind == "tbl":
                blocks.append(self.table(b))
                names.append(None)
        self.contextual(blocks, names)
        self.lent = outer
        borders, fill, styles = {}, None, self.styles.tree
        for tree, props in [*((styles, cell) for _, _, cell in applying), (t, p)]:
            if props is not None:
                borders |= borders_of(tree, tree.child(props, "tcBorders"), TABLE_SIDES)
                fill = color_of(tree, tree.child(props, "shd"), "fill") or fill
        margins, merge = margins_of(t, t.child(p, "tcMar")), t.child(p, "vMerge")
        merged = None if merge is None else "restart" if t.attribute(merge, "val") == "restart" else "continue"
        return Cell(blocks, int(number(t, t.child(p, "gridSpan"), "val") or 1), merged, t.attribute(t.child(p, "vAlign"), "val", "top"), tuple(margins.get(side) for side in MARGINS) if margins else None, borders, fill)

    def column_widths(self, rows: list[xml.Node], grid: list[float], table: float | None) -> list[float]:
        """Widths of columns in twips: the grid's, then those that spanning cells ask for, shared as the columns were, then those of single cells; the last one wins."""
        t, asked = self.t, []
        for r in rows:
            column = 0
            for c in (c for c in self.through(r) if c.name.rsplit(":", 1)[-1] == "tc"):
                p = t.child(c, "tcPr")
                span, w = max(1, int(number(t, t.child(p, "gridSpan"), "val") or 1)), t.child(p, "tcW")
                kind, value = t.attribute(w, "type", "dxa"), number(t, w, "w")
                if kind == "pct" and value is not None and table is not None:
                    value = math.floor(table * value / 5000 + 0.5)
                if w is not None and value is not None and kind != "dxa" and table is None:
                    self.note("width of a cell", kind)
                elif value and value > 0:
                    asked.append((span, column, value))
                column += span
        widths = dict(enumerate(grid))
        for span, column, value in sorted(asked, key=lambda a: a[0] == 1):
            over = [widths.get(column + k, 0.0) for k in range(span)]
            for k, w in enumerate(over):
                widths[column + k] = value * w / sum(over) if sum(over) > 0 else value / span
        return [widths.get(k, 0.0) for k in range(max(widths, default=-1) + 1)]

    def contextual(self, blocks: list, names: list[str | None]) -> None:
        """Spaces beside a paragraph of the same style fall away where a paragraph asks for it."""
        for i, b in enumerate(blocks):
            if isinstance(b, Paragraph) and b.style.get("contextual"):
                same = lambda j: 0 <= j < len(blocks) and isinstance(blocks[j], Paragraph) and names[j] == names[i]  # noqa: B023, E731
                b.style |= ({"before": 0.0} if same(i - 1) else {}) | ({"after": 0.0} if same(i + 1) else {})


#: Pixels of a unit of drawings; where they are placed from; what a box of text keeps inside of itself; pixels of units of style sheets.
EMU = 96 / 914400
RELATIVE = {"column": "column", "character": "column", "margin": "margin", "leftMargin": "margin", "rightMargin": "margin", "insideMargin": "margin", "outsideMargin": "margin", "page": "page", "paragraph": "paragraph", "line": "paragraph", "topMargin": "margin", "bottomMargin": "margin"}
INSETS = {"lIns": 91440, "tIns": 45720, "rIns": 91440, "bIns": 45720}
CSS = {"": 1.0, "px": 1.0, "pt": 96 / 72, "pc": 16.0, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4}


def css_px(length: str | None) -> float:
    """A style sheet's length in pixels; 0 if it is none."""
    m = re.fullmatch(r"(-?[0-9.]+)([a-z]*)", (length or "").strip().lower())
    return float(m[1]) * CSS[m[2]] if m and m[2] in CSS and m[1].count(".") < 2 and m[1].strip("-.") else 0.0


#: Sides of a cell's margins, in the kernel's order.
MARGINS = ("left", "right", "top", "bottom")


def margins_of(t: xml.Tree, n: xml.Node | None) -> dict[str, float]:
    """Side -> margin in twips, of the sides that are stated."""
    sides = {side: t.child(n, side) for side in MARGINS} if n is not None else {}
    return {side: 0.0 if t.attribute(c, "type") == "nil" else number(t, c, "w") for side, c in sides.items() if number(t, c, "w") is not None}


def pixels(p: dict, step: float = 48.0) -> dict:
    """Properties in twips as the kernel's style in pixels."""
    px = lambda k: p.get(k, 0) * TWIP
    style = {"before": px("before"), "after": px("after"), "indent_left": px("left"), "indent_right": px("right"), "indent_first": px("first"), "break_before": p.get("page_break", False), "keep_lines": p.get("keep_lines", False), "keep_next": p.get("keep_next", False), "alignment": p.get("alignment"), "contextual": p.get("contextual", False)}
    if p.get("widow") is not None:
        style["widow"] = p["widow"]
    if p.get("line") and p.get("rule") in ("exact", "atLeast"):
        style |= {"line_height": px("line"), "line_rule": p["rule"]}
    if p.get("stops") is not None or step != 48.0:
        style["tabs"] = Tabs(tuple(Stop(at * TWIP, kind, leader) for at, kind, leader in p.get("stops") or ()), step)
    return style


def geometry_of(t: xml.Tree, n: xml.Node | None) -> Geometry:
    size, m, cols = t.child(n, "pgSz"), t.child(n, "pgMar"), t.child(n, "cols")
    get = lambda node, name, default: default if number(t, node, name) is None else number(t, node, name)
    left = get(m, "left", PAGE_MARGIN) + get(m, "gutter", 0)
    right = get(m, "right", PAGE_MARGIN)
    width = get(size, "w", PAGE_WIDTH)
    count, gap = int(get(cols, "num", 1)), get(cols, "space", 720)
    columns = ()
    own = t.children(cols, "col") if cols is not None and t.attribute(cols, "equalWidth") in ("0", "false") else []
    if own:  # each of its own width, with its own space behind it
        at, found = left, []
        for c in own:
            found.append((at * TWIP, get(c, "w", 0) * TWIP))
            at += get(c, "w", 0) + get(c, "space", 0)
        columns = tuple(found)
    elif count > 1:
        each = (width - left - right - gap * (count - 1)) / count
        columns = tuple(((left + k * (each + gap)) * TWIP, each * TWIP) for k in range(count))
    return Geometry(width * TWIP, get(size, "h", PAGE_HEIGHT) * TWIP, abs(get(m, "top", PAGE_MARGIN)) * TWIP, abs(get(m, "bottom", PAGE_MARGIN)) * TWIP, left * TWIP, right * TWIP, columns)


def open_word(raw: bytes, faces: dict[tuple[str, bool, bool], Face] | None = None) -> Document:
    """A document from its package; BadPackage or BadXml if it cannot be read."""
    by_name = {p.name: p for p in opc.read_parts(raw)}

    def related(source: str, kind: str) -> str | None:
        rels = by_name.get(opc.relationship_part(source))
        found = [r[2] for r in opc.relationships_of(rels.content(), source) if r[1] == kind and not r[3]] if rels else []
        return found[0] if found else None

    main = related("", "officeDocument")
    if main is None or main not in by_name:
        raise opc.BadPackage("no main part" if main is None else f"{main} is missing")
    text = lambda name: by_name[name].content().decode("utf-8-sig") if name in by_name else None
    rels = by_name.get(opc.relationship_part(main))
    furniture = {r[0]: text(r[2]) for r in opc.relationships_of(rels.content(), main) if r[1] in ("header", "footer") and not r[3] and r[2] in by_name} if rels else {}
    media = {r[0]: (by_name[r[2]].content(), opc.PICTURES.get(r[2].rsplit(".", 1)[-1].lower(), "application/octet-stream")) for r in opc.relationships_of(rels.content(), main) if r[1] == "image" and not r[3] and r[2] in by_name} if rels else {}
    found = {k: text(related(main, k)) for k in ("styles", "numbering", "footnotes", "endnotes", "settings")}
    return Reader(read_styles(found["styles"]), read_lists(found["numbering"]), furniture, found["footnotes"], found["endnotes"], found["settings"], faces, media).read(text(main))


def pages_of(document: Document) -> list[Page]:
    return layout_sections(document.sections)


PLACED = "doc string, page int, layer string, block int, line int, text string, marker string, x_milli long, y_milli long, height_milli long, error string"
_PLACED = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
OPERATIONS = "doc string, page int, z int, layer string, kind string, x double, y double, x2 double, y2 double, width double, height double, size double, text string, color string, style string, family string, bold boolean, italic boolean, kerned boolean, media string, content binary, error string"
_OPERATIONS = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.float64()] * 7, *[pa.string()] * 4, *[pa.bool_()] * 3, pa.string(), pa.binary(), pa.string())
#: Rows of a batch that a task hands on.
ROWS_AT_ONCE = 20_000


def laid_out(packages: DataFrame, make: Callable[[str, Document], Iterator[tuple]], schema: str, kinds: tuple) -> DataFrame:
    """The rows that make gives of each package (doc, content), where the package is; one that cannot be read gives a row with its error, the last column."""
    ship(packages.sparkSession)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        for b in batches:
            for doc, raw in zip(b.column("doc").to_pylist(), b.column("content"), strict=True):
                try:
                    rows += make(doc, open_word(raw.as_py() or b""))
                except (opc.BadPackage, xml.BadXml) as e:
                    rows.append((doc, *[None] * (len(kinds) - 2), str(e)))
                if len(rows) >= ROWS_AT_ONCE:
                    yield batch()
                    rows = []
        yield batch()

    return packages.select("doc", "content").mapInArrow(run, schema)


def _lines(doc: str, d: Document) -> list[tuple]:
    first, rows, whole = [0], [], {}
    for s in d.sections:
        first.append(first[-1] + len(s.blocks))
    for n, page in enumerate(pages_of(d)):
        for layer, block, line, p in shown_lines(page):
            if id(p.source) not in whole:
                whole[id(p.source)] = (p.source, "".join(r.text for r in p.source.runs))
            text = text_between(whole[id(p.source)][1], p.line.start, p.line.end)
            rows.append((doc, n, layer, block + first[page.section] if layer in ("line", "row") else block, line, text, p.marker and p.marker[0].text, milli(p.x), milli(p.y), milli(p.height), None))
        rows += [(doc, n, "number", k, None, str(number), None, milli(right), milli(y), None, None) for k, (number, right, y) in enumerate(page.line_numbers)]
    return rows


def word_lines(packages: DataFrame) -> DataFrame:
    """Every line of text of each package (doc, content), placed: of the body, of tables (the row in place of the line), headers, footers and notes, and the numbers beside lines (their right edge and baseline)."""
    return laid_out(packages, _lines, PLACED, _PLACED)


def _operations(doc: str, d: Document) -> Iterator[tuple]:
    painter = Painter()
    for n, page in enumerate(pages_of(d)):
        s = d.sections[page.section]
        sheet = Op("page", "page", 0.0, 0.0, width=s.geometry.width, height=s.geometry.height)
        for z, o in enumerate([sheet, *painter.page(page, s)]):
            yield (doc, n, z, o.layer, o.kind, o.x, o.y, o.x2, o.y2, o.width, o.height, o.size, o.text, o.color, o.style, o.family, o.bold, o.italic, o.kerned, o.media, o.content, None)


def word_operations(packages: DataFrame) -> DataFrame:
    """The draw operations of every page of each package (doc, content), z counting in paint order; the first of each page, of kind page, is its sheet."""
    return laid_out(packages, _operations, OPERATIONS, _OPERATIONS)
