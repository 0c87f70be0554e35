"""Sections to pages: numbering, blank pages, headers and footers with fields, footnotes, line numbers, page borders. Plain Python."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from leafmill.operators.lines import Paragraph
from leafmill.operators.pages import Geometry, Page, Pager, PlacedLine, Table, stack
from leafmill.operators.pages import RULE_GAP as RULE_GAP


@dataclass
class LineNumbers:
    restart: str = "newPage"  # newPage, newSection, continuous
    start: int = 0
    by: int = 1
    distance: float = 0.0


@dataclass
class Section:
    blocks: list
    geometry: Geometry
    start: str = "nextPage"  # evenPage, oddPage
    first_number: int | None = None
    numerals: str = "decimal"
    headers: dict[str, list] = field(default_factory=dict)  # default, first, even -> blocks
    footers: dict[str, list] = field(default_factory=dict)
    title_page: bool = False
    even_odd: bool = False
    header_at: float = 0.0
    footer_at: float = 0.0
    notes: dict[int, list] = field(default_factory=dict)
    line_numbers: LineNumbers | None = None
    border_from: str | None = None  # page, text
    border: dict[str, float] = field(default_factory=dict)  # side -> gap to the rule's centre
    border_rules: dict = field(default_factory=dict)  # side -> rule
    number_size: float = 16.0  # of line numbers


def shown(n: int, style: str) -> str:
    from leafmill.functions.text import _ROMAN

    if style in ("lowerLetter", "upperLetter"):
        s = chr(97 + (n - 1) % 26) * ((n - 1) // 26 + 1) if n > 0 else ""
    elif style in ("lowerRoman", "upperRoman"):
        s = "m" * (n // 1000) + "".join(row[n // place % 10] for row, place in zip(_ROMAN, (100, 10, 1), strict=True)) if n > 0 else ""
    else:
        return str(n)
    return s.upper() if style.startswith("upper") else s


def with_fields(blocks: list, number: int, total: int, numerals: str) -> list:
    """Blocks with what their fields stand for; a section's numerals hold for page numbers only, a field's own for either."""
    out = []
    for b in blocks:
        if isinstance(b, Paragraph) and any(r.field for r in b.runs):
            b = Paragraph([replace(r, text=shown(number if r.field == "page" else total, r.numeral or (numerals if r.field == "page" else "decimal"))) if r.field else r for r in b.runs], b.style)
        out.append(b)
    return out


def counts_pages(blocks: list) -> bool:
    return any(isinstance(b, Paragraph) and any(r.field == "pages" for r in b.runs) for b in blocks)


def variant(s: Section, furniture: dict[str, list], index: int, number: int) -> list:
    """The furniture of a page: the first page's own, then the even pages', else the default; one that is asked for and not there is the default."""
    if s.title_page and index == 0:
        return furniture.get("first", furniture.get("default", []))
    if s.even_odd and number % 2 == 0:
        return furniture.get("even", furniture.get("default", []))
    return furniture.get("default", [])


def moved(lines: list[PlacedLine], x: float, y: float) -> list[PlacedLine]:
    return [p.moved(x, y) for p in lines]


def place_notes(pager: Pager, pages: list[Page]) -> None:
    """Each page's footnotes from its foot up; what does not fit goes on on the next page, and on pages of their own at the end."""
    g, owed = pager.g, []
    width = g.width - g.left - g.right
    at = 0
    while at < len(pages) or owed:
        if at == len(pages):
            pages.append(Page(limits=pager.limits_of(at)))
        page = pages[at]
        top, foot = page.limits
        for n in page.notes:
            owed += stack(pager.note_blocks.get(n, []), width)[0]
        used = max([top, *(p.y + p.height for p in page.lines), *(r.y + r.height for r in page.rows)])
        room = max(0.0, foot - used) - pager.separator(page.notes[0] if page.notes else None)
        taken, height = 0, 0.0
        while taken < len(owed) and (taken == 0 or height + owed[taken].height <= room):
            height += owed[taken].height
            taken += 1
        if taken:
            y = foot - height
            page.rule = y - RULE_GAP
            for p in owed[:taken]:
                page.footnotes += moved([replace(p, y=0.0)], g.left, y)
                y += p.height
        owed = owed[taken:]
        at += 1


def limits_of(s: Section, first: int, total: int):
    """Where the text of each page of a section may begin and must end: the margins, or a header or footer that is taller."""
    g, heights = s.geometry, {}

    def height(furniture: dict[str, list], k: int) -> float:
        blocks = variant(s, furniture, k, first + k)
        if blocks and id(blocks) not in heights:
            heights[id(blocks)] = stack(with_fields(blocks, first + k, total, s.numerals), g.width - g.left - g.right)[2]
        return heights[id(blocks)] if blocks else 0.0

    def limits(k: int) -> tuple[float, float]:
        head, foot = height(s.headers, k), height(s.footers, k)
        return max(g.top, s.header_at + head) if head else g.top, min(g.height - g.bottom, g.height - s.footer_at - foot) if foot else g.height - g.bottom

    return limits


def _run(sections: list[Section], widow: bool, total: int | None) -> list[Page]:
    pages: list[Page] = []
    for k, s in enumerate(sections):
        even_next = len(pages) % 2 == 1
        if k and ((s.start == "evenPage" and not even_next) or (s.start == "oddPage" and even_next)):
            pages.append(Page(number=len(pages) + 1, section=k - 1))
        first = len(pages) + 1 if s.first_number is None else s.first_number
        body = with_fields(s.blocks, first, total or 1, s.numerals) if total or any(isinstance(b, Paragraph) and any(r.field for r in b.runs) for b in s.blocks) else s.blocks
        pager = Pager(body, s.geometry, widow, s.notes, limits_of(s, first, total or 1))
        laid = pager.run()
        if s.notes:
            place_notes(pager, laid)
        for i, page in enumerate(laid):
            page.number, page.section = first + i, k
            pages.append(page)
        if s.border_from:
            for page in laid:
                page.border = border_box(s)
    for k, s in enumerate(sections):
        own = [p for p in pages if p.section == k]
        for i, page in enumerate(own):
            g = s.geometry
            width, count = g.width - g.left - g.right, total or len(pages)
            for blocks, at, keep in ((variant(s, s.headers, i, page.number), lambda h, s=s: s.header_at, page.header), (variant(s, s.footers, i, page.number), lambda h, s=s, g=g: g.height - s.footer_at - h, page.footer)):
                if blocks:
                    lines, rows, height = stack(with_fields(blocks, page.number, count, s.numerals), width)
                    keep += moved(lines, g.left, at(height))
                    page.furniture_rows += [replace(r, x=r.x + g.left, y=r.y + at(height)) for r in rows]
    return pages


def border_box(s: Section) -> tuple[float, float, float, float]:
    """(left, top, right, bottom): inward from the paper's edge, or outward from the text's."""
    g, gap = s.geometry, lambda side: s.border.get(side, 0.0)
    if s.border_from == "page":
        return gap("left"), gap("top"), g.width - gap("right"), g.height - gap("bottom")
    return g.left - gap("left"), g.top - gap("top"), g.width - g.right + gap("right"), g.height - g.bottom + gap("bottom")


def number_lines(pages: list[Page], sections: list[Section]) -> None:
    """Numbers beside the lines of sections that ask for them; suppressed lines are not counted."""
    count, before = 0, -1
    for page in pages:
        n = sections[page.section].line_numbers
        if n and (n.restart == "newPage" or (n.restart == "newSection" and page.section != before)):
            count = 0
        before = page.section
        if not n:
            continue
        blocks = sections[page.section].blocks
        for p in page.lines:
            b = blocks[p.block]
            if not isinstance(b, Table) and b.get("no_number", False):
                continue
            count += 1
            if (n.start + count) % n.by == 0:
                page.line_numbers.append((n.start + count, sections[page.section].geometry.left - n.distance, p.y + p.baseline))


def layout_sections(sections: list[Section], widow: bool = True) -> list[Page]:
    """All pages of a document. A second pass runs only if the number of pages is shown and was not known in the first."""
    pages = _run(sections, widow, None)
    everywhere = [b for s in sections for b in s.blocks]
    if counts_pages(everywhere):
        pages = _run(sections, widow, len(pages))
    number_lines(pages, sections)
    return pages
