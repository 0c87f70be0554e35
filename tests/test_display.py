import pytest

from leafmill.operators.display import Painter, leader_count, shown_lines
from leafmill.operators.lines import Look, Paragraph, Run, Stop, Tabs
from leafmill.operators.pages import Cell, Geometry, Row, Rule, Table, edges_of, measure_table
from leafmill.operators.sections import Section, layout_sections
from leafmill.sources.word import HALF_POINT, SUB_DROP, SUPER_RISE, TWIP, open_word, pages_of, word_lines, word_operations
from tests.test_pages import TEN, cell, para, words
from tests.test_word import W, body, docx, p, read, reader

WIDE = Geometry(100.0, 200.0, 10, 10, 10, 10)


def ops_of(blocks, **section):
    s = Section(blocks, WIDE, **section)
    return [o for page in layout_sections([s], widow=False) for o in Painter().page(page, s)]


def brief(ops, *fields):
    return [tuple(getattr(o, f) for f in fields) for o in ops]


def test_runs_are_drawn_one_after_the_other():
    look = Look(color="#112233", highlight="#FFFF00", underline=("double", None), strike="single")
    ops = ops_of([Paragraph([Run("ab ", 1.0, TEN), Run("cd", 1.0, TEN, look=look), Run("e", 1.0, TEN, rise=3.0)], {"line_height": 10.0, "line_rule": "exact"})])
    assert brief((o for o in ops if o.kind == "text"), "text", "x", "y", "color") == [("ab ", 10.0, 18.0, None), ("cd", 13.0, 18.0, "#112233"), ("e", 15.0, 15.0, None)]
    rect = next(o for o in ops if o.kind == "rect")
    assert (rect.x, rect.y, rect.width, rect.height, rect.color) == (13.0, 10.0, 2.0, 10.0, "#FFFF00") and ops.index(rect) == 1
    rules = [o for o in ops if o.kind == "line"]
    assert len(rules) == 3 and all((r.x, r.x2, r.color) == (13.0, 15.0, "#112233") for r in rules) and rules[0].y < rules[1].y and rules[2].y < 18.0


def test_justified_words_stand_by_themselves():
    ops = ops_of([para("abcde fgh " * 40, alignment="justify")])
    first = [o for o in ops if o.y == 18.0]
    assert [o.text for o in first[:3]] == ["abcde", "fgh", "abcde"] and first[-1].x + 3 == pytest.approx(90.0)


def test_tabs_and_leaders():
    tabs = Tabs((Stop(20.0, "left", "dot"), Stop(50.0, "right")))
    ops = ops_of([Paragraph([Run("a\tb\tcd", 1.0, TEN)], {"line_height": 10.0, "line_rule": "exact", "tabs": tabs})])
    assert brief(ops, "text", "x") == [("a", 10.0), ("." * 19, 11.0), ("b", 30.0), ("cd", 58.0)]
    assert [leader_count(k, 2.6) for k in ("dot", "hyphen", "underscore")] == [2, 3, 3] and leader_count("hyphen", 0.9) == 0


def test_a_shared_edge_is_one_rule():
    black, red = Rule(1.0), Rule(3.0, 0.0, "#FF0000", "dashed")
    t = Table([Row([cell("a"), cell("b")]), Row([Cell([para("c")], borders={"top": red}), cell("d")])], [30.0, 30.0], borders=dict.fromkeys(("top", "left", "bottom", "right", "inside_h", "inside_v"), black))
    edges, room = edges_of(t)
    assert room == [1.0, 3.0, 1.0]
    assert edges[0][0] == {"top": black, "left": black, "right": black, "bottom": red} and edges[0][1] == {"top": black, "right": black, "bottom": black}
    ops = ops_of([t])
    assert sum(o.kind == "line" for o in ops) == 2 + 4 + 2 + 4 and sum(o.color == "#FF0000" for o in ops) == 1
    assert [o.text for o in ops if o.kind == "text"] == ["a", "b", "c", "d"]


def test_merged_and_filled_cells():
    t = Table([Row([Cell([para("a")], merge="restart", fill="#EEEEEE"), cell("b")]), Row([Cell([], merge="continue"), cell("c")])], [30.0, 30.0], fill="#DDDDDD", borders={"inside_h": 2.0, "bottom": 2.0})
    rects = [o for o in ops_of([t]) if o.kind == "rect"]
    assert [(r.color, r.height) for r in rects] == [("#EEEEEE", 22.0), ("#DDDDDD", 10.0), ("#DDDDDD", 10.0)]
    assert "bottom" not in measure_table(t)[0][1].cells[0].edges


def test_a_split_row_keeps_inner_tables_once():
    inner = Table([Row([cell("i")])], [20.0])
    t = Table([Row([Cell([para(words(6)), inner])])], [30.0])
    s = Section([t], Geometry(30.0, 50.0))
    pages = layout_sections([s], widow=False)
    assert [[p.source.runs[0].text[:1] for *_, p in shown_lines(page)] for page in pages] == [["a", "a"], ["i"]] or sum(p.source.runs[0].text == "i" for page in pages for *_, p in shown_lines(page)) == 1


def test_a_tall_header_moves_the_body():
    s = Section([para("a")], WIDE, headers={"default": [para(words(40))]}, footers={"default": [para("f")]}, header_at=5.0, footer_at=30.0)
    page = layout_sections([s], widow=False)[0]
    assert page.lines[0].y == 5.0 + 10.0 * len(page.header) > 10.0 and page.limits[1] == 200.0 - 30.0 - 10.0


def test_paint_order_of_a_page():
    s = dict(headers={"default": [para("h")]}, notes={1: [para("n")]}, border_from="text", border={"left": 1.0}, border_rules={"left": Rule(2.0)})
    noted = Paragraph([Run("t", 1.0, TEN, note=1)], {"line_height": 10.0, "line_rule": "exact", "borders": {"top": Rule(1.0, 2.0)}})
    t = Table([Row([cell("r")])], [30.0])
    assert [o.layer for o in ops_of([t, noted], **s)] == ["header", "row", "line", "box", "box", "note", "note"]


# ---- the reader


def test_run_properties():
    rpr = "<w:rFonts w:ascii='Serif'/><w:b/><w:i/><w:color w:val='FF0000'/><w:highlight w:val='yellow'/><w:u w:val='dotDash' w:color='00FF00'/><w:dstrike/><w:kern w:val='20'/><w:position w:val='6'/><w:sz w:val='20'/>"
    r = body(p("x", rpr=rpr)).blocks[0].runs[0]
    assert r.look == Look("#FF0000", "#FFFF00", ("dashed", "#00FF00"), "double", "Serif", True, True) and r.kerned and r.rise == 6 * HALF_POINT
    up, down = (body(p("x", rpr=f"<w:sz w:val='20'/><w:vertAlign w:val='{k}script'/>")).blocks[0].runs[0] for k in ("super", "sub"))
    assert up.rise == pytest.approx(20 * HALF_POINT * SUPER_RISE) and down.rise == pytest.approx(-20 * HALF_POINT * SUB_DROP)
    off = body(p("x", rpr="<w:color w:val='auto'/><w:u w:val='none'/><w:shd w:fill='auto'/><w:kern w:val='0'/>")).blocks[0].runs[0]
    assert off.look == Look("#000000", family=off.look.family) and not off.kerned


LEVEL = "<w:abstractNum w:abstractNumId='0'><w:lvl w:ilvl='0'><w:numFmt w:val='decimal'/><w:lvlText w:val='%1.'/>{}<w:pPr><w:ind w:left='{}' w:hanging='360'/></w:pPr></w:lvl></w:abstractNum><w:num w:numId='1'><w:abstractNumId w:val='0'/></w:num>"


@pytest.mark.parametrize(("more", "left", "begin"), [("", 720, 720), ("<w:suff w:val='nothing'/>", 720, 720), ("<w:lvlJc w:val='right'/>", 720, 720), ("", 360, 360)])
def test_markers_take_room(more, left, begin):
    d = body(p("item", "<w:numPr><w:ilvl w:val='0'/><w:numId w:val='1'/></w:numPr>"), numbering=LEVEL.format(more, left))
    line, margin = pages_of(d)[0].lines[0], d.geometry.left
    run, x = line.marker
    assert run.text == "1." and line.x == pytest.approx(margin + begin * TWIP, abs=0.1)
    width = 2 * 1229 / 2048 * run.size
    assert x == pytest.approx(margin + (left - 360) * TWIP - (width if "right" in more else 0.0))


def test_a_wide_marker_moves_its_text_to_a_stop():
    level = LEVEL.format("<w:suff w:val='tab'/>", 360).replace("%1.", "%1. and more")
    line = pages_of(body(p("item", "<w:numPr><w:numId w:val='1'/></w:numPr>"), numbering=level))[0].lines[0]
    assert (line.x - 96.0) % 48.0 == pytest.approx(0.0, abs=0.1) and line.x > line.marker[1] + 80


TABLE_STYLES = (
    "<w:style w:type='table' w:styleId='A'><w:name w:val='A'/><w:rPr><w:i/></w:rPr><w:tblPr><w:tblBorders><w:top w:val='single' w:sz='8'/><w:insideV w:val='dashed' w:sz='4' w:color='00FF00'/></w:tblBorders><w:tblCellMar><w:left w:w='100'/><w:top w:w='50'/></w:tblCellMar></w:tblPr></w:style>"
    "<w:style w:type='table' w:styleId='B'><w:name w:val='B'/><w:basedOn w:val='A'/><w:tblPr><w:tblCellMar><w:top w:w='70'/></w:tblCellMar></w:tblPr><w:tblStylePr w:type='firstRow'><w:rPr><w:b/></w:rPr><w:tcPr><w:shd w:fill='CCCCCC'/><w:tcBorders><w:bottom w:val='single' w:sz='24'/></w:tcBorders></w:tcPr></w:tblStylePr><w:tblStylePr w:type='band2Horz'><w:tcPr><w:shd w:fill='EEEEEE'/></w:tcPr></w:tblStylePr></w:style>"
)


def test_table_styles():
    row = lambda own="": f"<w:tr><w:tc>{own}{p()}</w:tc><w:tc>{p()}</w:tc></w:tr>"
    inner = "<w:tbl><w:tblPr><w:tblStyle w:val='B'/><w:tblLook w:val='0020'/><w:tblInd w:w='200'/></w:tblPr><w:tblGrid><w:gridCol w:w='1000'/><w:gridCol w:w='1000'/></w:tblGrid>{}</w:tbl>"
    t = body(inner.format(row() + row("<w:tcPr><w:shd w:fill='123456'/><w:tcMar><w:left w:w='10'/><w:right w:w='0' w:type='nil'/></w:tcMar></w:tcPr>") + row()), TABLE_STYLES).blocks[0]
    assert t.margins == pytest.approx((100 * TWIP, 115 * TWIP, 70 * TWIP, 0.0)) and t.indent == 200 * TWIP
    assert t.borders == {"top": Rule(8 / 8 * 96 / 72), "inside_v": Rule(4 / 8 * 96 / 72, 0.0, "#00FF00", "dashed")}
    assert [[c.fill for c in r.cells] for r in t.rows] == [["#CCCCCC", "#CCCCCC"], ["#123456", None], ["#EEEEEE", "#EEEEEE"]]
    assert t.rows[0].cells[0].borders == {"bottom": Rule(4.0)} and t.rows[1].cells[0].margins == pytest.approx((10 * TWIP, 0.0, 70 * TWIP, 0.0))
    runs = [r.cells[0].blocks[0].runs[0].look for r in t.rows]
    assert [(x.bold, x.italic) for x in runs] == [(True, True), (False, True), (False, True)]
    assert not body(p(), TABLE_STYLES).blocks[0].runs[0].look.italic


def test_column_widths():
    tc = lambda w, span=1, kind="dxa": f"<w:tc><w:tcPr><w:tcW w:w='{w}' w:type='{kind}'/><w:gridSpan w:val='{span}'/></w:tcPr>{p()}</w:tc>"
    table = "<w:tbl><w:tblPr>{}</w:tblPr><w:tblGrid><w:gridCol w:w='100'/><w:gridCol w:w='300'/><w:gridCol w:w='50'/></w:tblGrid>{}</w:tbl>"
    widths = lambda rows, props="": [round(w / TWIP) for w in body(table.format(props, "".join(f"<w:tr>{r}</w:tr>" for r in rows))).blocks[0].widths]
    assert widths([tc(0)]) == [100, 300, 50]
    assert widths([tc(800, 2) + tc(60)]) == [200, 600, 60]
    assert widths([tc(90) + tc(0), tc(800, 2)]) == [90, 600, 50]
    assert widths([tc(2500, 1, "pct")], "<w:tblW w:w='1000' w:type='dxa'/>") == [500, 300, 50] and widths([tc(2500, 1, "pct")]) == [100, 300, 50]


def test_columns_of_their_own_widths_and_page_borders():
    d = read(reader(), p("x") + "<w:sectPr><w:pgMar w:left='600' w:right='600'/><w:pgBorders w:offsetFrom='page'><w:top w:val='double' w:sz='8' w:space='4'/></w:pgBorders><w:cols w:equalWidth='0'><w:col w:w='1000' w:space='200'/><w:col w:w='3000'/></w:cols></w:sectPr>")
    assert [round(c / TWIP) for pair in d.geometry.columns for c in pair] == [600, 1000, 1800, 3000]
    s = d.sections[0]
    assert s.border_rules["top"].style == "double" and pages_of(d)[0].border[1] == pytest.approx((4 + 0.5) * 96 / 72)


def test_all_layers_of_a_package(spark):
    inner = p("body") + "<w:tbl><w:tblGrid><w:gridCol w:w='3000'/></w:tblGrid><w:tr><w:tc>" + p("cell") + "<w:tbl><w:tblGrid><w:gridCol w:w='900'/></w:tblGrid><w:tr><w:tc>" + p("inner") + "</w:tc></w:tr></w:tbl>" + p("") + "</w:tc></w:tr></w:tbl>" + "<w:sectPr><w:lnNumType w:countBy='1'/></w:sectPr>"
    docs = spark.createDataFrame([("a", bytearray(docx(inner))), ("b", bytearray(b"x"))], "doc string, content binary")
    rows = word_lines(docs).collect()
    assert [(r["layer"], r["text"]) for r in rows if r["doc"] == "a" and r["text"]] == [("row", "cell"), ("row", "inner"), ("line", "body"), ("number", "1")]
    ops = word_operations(docs).orderBy("z").collect()
    assert [o["text"] for o in ops if o["kind"] == "text"] == ["cell", "inner", "body", "1"] and sum(o["error"] is not None for o in ops) == 1
    assert next(o for o in ops if o["kind"] == "page")["width"] == pytest.approx(11906 * TWIP)


def test_faces_measure_their_runs():
    from leafmill.operators.lines import Face

    wide = Face(em=10, advance=20, ascent=8, descent=2)
    one, two = (pages_of(open_word(docx(p("ab", rpr="<w:rFonts w:ascii='Wide'/><w:sz w:val='20'/>")), faces))[0].lines[0].line.width for faces in (None, {("wide", False, False): wide}))
    assert two == pytest.approx(4 * 20 * HALF_POINT) != one and W


# ---- pictures, boxes of text, floats

NAMES = "xmlns:wp='wp' xmlns:a='a' xmlns:r='r' xmlns:wps='wps'"
EMUS = 9525  # of a pixel


def drawing(kind, inner, more="", cx=50, cy=30):
    return f"<w:r><w:drawing {NAMES}><wp:{kind} {more}><wp:extent cx='{cx * EMUS}' cy='{cy * EMUS}'/><wp:docPr descr='a &quot;b&quot;'/>{inner}</wp:{kind}></w:drawing></w:r>"


def with_picture(inner):
    from tests.test_sources import REL, RELS, archive

    return archive(
        ("_rels/.rels", RELS.format(REL.format("r", "officeDocument", "word/document.xml", ""))),
        ("word/_rels/document.xml.rels", RELS.format(REL.format("pic", "image", "media/one.png", ""))),
        ("word/media/one.png", "png bytes"),
        ("word/document.xml", f"<w:document {W}><w:body>{inner}</w:body></w:document>"),
    )


BLIP = "<a:blip r:embed='pic'/>"


def test_inline_pictures_stand_on_the_baseline():
    d = open_word(with_picture(f"<w:p><w:r><w:t>a</w:t></w:r>{drawing('inline', BLIP)}<w:r><w:t>b</w:t></w:r></w:p>"))
    page = pages_of(d)[0]
    ops = list(Painter().page(page, d.sections[0]))
    assert [o.kind for o in ops] == ["text", "image", "text"]
    image, letter = ops[1], 22 * HALF_POINT * 1229 / 2048
    assert (image.width, image.height, image.text, image.media, image.content) == (50.0, 30.0, 'a "b"', "image/png", b"png bytes")
    assert image.y + image.height == pytest.approx(page.lines[0].y + page.lines[0].baseline) and ops[2].x == pytest.approx(96 + letter + 50)
    assert page.lines[0].height > 30.0


def test_missing_pictures_are_reported():
    d = open_word(with_picture(f"<w:p>{drawing('inline', BLIP.replace('pic', 'no'))}</w:p>" + p("x")))
    assert ("missing picture", "no") in d.notes and ("not drawn", "drawing") in d.notes


def test_text_flows_beside_floats():
    place = "<wp:positionH relativeFrom='column'><wp:posOffset>0</wp:posOffset></wp:positionH><wp:positionV relativeFrom='paragraph'><wp:posOffset>0</wp:posOffset></wp:positionV>"
    inner = f"<w:p>{drawing('anchor', place + BLIP, f'distR={chr(39)}{10 * EMUS}{chr(39)}', 200, 40)}<w:r><w:t>{'word ' * 120}</w:t></w:r></w:p>"
    page = pages_of(open_word(with_picture(inner)))[0]
    f = page.floats[0]
    assert (f.x, f.y, f.of.width) == (96.0, 96.0, 200.0) and f.of.clear == (0.0, 0.0, 10.0, 0.0)
    xs = [(w.x, f.meets(w.y, w.height)) for w in page.lines]
    assert all(x == pytest.approx(306.0 if near else 96.0) for x, near in xs) and {n for _, n in xs} == {True, False}
    over = pages_of(open_word(with_picture(inner.replace("<wp:extent", "<wp:wrapNone/><wp:extent"))))[0]
    assert all(w.x == 96.0 for w in over.lines)


def test_floats_go_with_their_paragraph_and_align():
    place = "<wp:positionH relativeFrom='page'><wp:align>right</wp:align></wp:positionH><wp:positionV relativeFrom='page'><wp:posOffset>0</wp:posOffset></wp:positionV>"
    size = "<w:sectPr><w:pgSz w:w='6000' w:h='4000'/></w:sectPr>"
    d = open_word(with_picture(p("a ") * 7 + f"<w:p>{drawing('anchor', place + BLIP, 'behindDoc=' + repr('1'))}<w:r><w:t>last</w:t></w:r></w:p>" + size))
    pages = pages_of(d)
    last = next(k for k, page in enumerate(pages) if page.floats)
    assert last == len(pages) - 1 > 0 and pages[last].floats[0].x == pytest.approx(6000 * TWIP - 50)
    ops = list(Painter().page(pages[last], d.sections[0]))
    assert ops[0].kind == "image" and ops[-1].text == "last"


def test_boxes_of_text(spark):
    box = f"<wps:txbx><w:txbxContent>{p('boxed text')}</w:txbxContent></wps:txbx><wps:bodyPr lIns='0' tIns='{10 * EMUS}'/>"
    raw = with_picture(f"<w:p>{drawing('anchor', box, '', 200, 60)}<w:r><w:t>body</w:t></w:r></w:p>")
    f = pages_of(open_word(raw))[0].floats[0]
    assert (f.lines[0].x, f.lines[0].y) == (96.0, 106.0) and f.of.inset == pytest.approx((0.0, 10.0, 9.6, 4.8))
    docs = spark.createDataFrame([("a", bytearray(raw))], "doc string, content binary")
    assert sorted((r["layer"], r["text"]) for r in word_lines(docs).collect()) == [("float", "boxed text"), ("line", "body")]


def test_pictures_in_svg(spark):
    from leafmill.operators.render import word_svg

    docs = spark.createDataFrame([("a", bytearray(with_picture(f"<w:p>{drawing('inline', BLIP)}</w:p>")))], "doc string, content binary")
    svg = word_svg(word_operations(docs)).first()["svg"]
    assert 'aria-label="a &quot;b&quot;" preserveAspectRatio="xMidYMid meet" href="data:image/png;base64,cG5nIGJ5dGVz"/>' in svg


def test_older_pictures_and_lengths():
    from leafmill.sources.word import css_px

    d = open_word(with_picture("<w:p><w:r><w:pict xmlns:v='v' xmlns:r='r'><v:shape style='width:36pt; height:1in' alt='old'><v:imagedata r:id='pic'/></v:shape></w:pict></w:r></w:p>"))
    image = d.blocks[0].runs[0].picture
    assert (image.width, image.height, image.description) == (48.0, 96.0, "old")
    assert [css_px(x) for x in ("2.54cm", "-10", "1x", None, "..")] == [pytest.approx(96.0), -10.0, 0.0, 0.0, 0.0]
