from leafmill.operators.lines import Paragraph, Run
from leafmill.operators.pages import Geometry, Table, paginate
from leafmill.operators.sections import LineNumbers, Section, layout_sections, variant
from tests.test_pages import PAGE, TEN, cell, para, words
from leafmill.operators.pages import Row

STYLE = {"line_height": 10.0, "line_rule": "exact"}


def noted(text, *notes):
    return Paragraph([Run(text, 1.0, TEN), *[Run("x", 1.0, TEN, note=n) for n in notes]], STYLE)


def test_footnotes_take_room_at_the_foot_of_their_page():
    blocks = [noted("abcdefghi", 1), para(words(4))]
    pages = layout_sections([Section(blocks, PAGE, notes={1: [para("note")]})], widow=False)
    # a line of the note and one that its rule stands on leave three lines
    assert [len(p.lines) for p in pages] == [3, 2]
    assert [(p.line.start, p.y) for p in pages[0].footnotes] == [(0, 40.0)] and pages[0].rule < 40 and not pages[1].footnotes


def test_a_line_moves_with_its_note():
    blocks = [para(words(3)), noted("abcdefghi", 1)]
    pages = layout_sections([Section(blocks, PAGE, notes={1: [para(words(2))]})], widow=False)
    assert [len(p.lines) for p in pages] == [3, 1] and len(pages[1].footnotes) == 2


def test_long_notes_run_on():
    pages = layout_sections([Section([noted("a", 1), para("b")], PAGE, notes={1: [para(words(12))]})], widow=False)
    assert sum(len(p.footnotes) for p in pages) == 12 and len(pages) > 2
    assert all(p.y + p.height <= 50.0 for page in pages for p in page.footnotes)


def page_field(kind, numeral=None):
    return Run("?", 1.0, TEN, field=kind, numeral=numeral)


def shown_text(section, page, which):
    from leafmill.operators.sections import with_fields

    furniture = getattr(section, which)
    return furniture and with_fields(furniture["default"], page.number, 3, section.numerals)[0].runs


def test_furniture_numbers_and_variants():
    head = [Paragraph([page_field("page"), Run(" of ", 1.0, TEN), page_field("pages")], STYLE)]
    s = Section([para(words(11))], Geometry(10.0, 70.0, 10, 10), headers={"default": head}, footers={"default": [para("f")]}, footer_at=2.0, numerals="lowerRoman")
    pages = layout_sections([s], widow=False)
    assert [p.number for p in pages] == [1, 2, 3] and all(p.header and p.footer for p in pages)
    assert pages[0].footer[0].y == 58.0 and pages[0].header[0].y == 0.0
    assert [r.text for r in shown_text(s, pages[1], "headers")] == ["ii", " of ", "3"]
    v = Section([], PAGE, headers={"default": ["d"], "first": ["f"]}, title_page=True, even_odd=True)
    assert [variant(v, v.headers, i, n) for i, n in ((0, 1), (1, 2), (2, 3))] == [["f"], ["d"], ["d"]]


def test_sections_begin_on_the_pages_they_ask_for():
    sections = [Section([para("a")], PAGE), Section([para("b")], PAGE, start="oddPage"), Section([para("c")], PAGE, start="evenPage"), Section([para("d")], PAGE, first_number=7)]
    pages = layout_sections(sections)
    assert [(p.section, p.number, len(p.lines)) for p in pages] == [(0, 1, 1), (0, 2, 0), (1, 3, 1), (2, 4, 1), (3, 7, 1)]


def test_line_numbers():
    quiet = Paragraph([Run("q", 1.0, TEN)], STYLE | {"no_number": True})
    s = Section([para(words(3)), quiet, para(words(4))], PAGE, line_numbers=LineNumbers("newPage", 0, 2, 1.0))
    pages = layout_sections([s], widow=False)
    assert [[n for n, _, _ in p.line_numbers] for p in pages] == [[2, 4], [2]]
    s.line_numbers = LineNumbers("continuous", 10, 1, 1.0)
    assert [[n for n, _, _ in p.line_numbers] for p in layout_sections([s], widow=False)] == [[11, 12, 13, 14], [15, 16, 17]]


def test_borders_of_pages():
    g = Geometry(100.0, 200.0, 10, 20, 30, 40)
    assert layout_sections([Section([para("a")], g, border_from="text", border={"left": 1.0, "top": 2.0})])[0].border == (29.0, 8.0, 60.0, 180.0)
    assert layout_sections([Section([para("a")], g, border_from="page", border={"right": 5.0})])[0].border == (0.0, 0.0, 95.0, 200.0)


def test_a_body_that_shows_the_number_of_pages_is_laid_out_again():
    body = Paragraph([page_field("pages"), Run(" pages", 1.0, TEN)], STYLE)
    pages = layout_sections([Section([body, para(words(9))], PAGE)], widow=False)
    assert len(pages) == 2 and pages[0].lines[0].line.width == 7.0


def test_sections_of_tables():
    t = Table([Row([cell("a")]) for _ in range(6)], [10.0])
    assert [len(p.rows) for p in layout_sections([Section([t], PAGE)])] == [len(p.rows) for p in paginate([t], PAGE)] == [5, 1]
