import pytest

from leafmill.operators.lines import Paragraph
from leafmill.operators.pages import Rule, Table
from leafmill.sources.word import HALF_POINT, TWIP, Counters, Reader, open_word, pages_of, read_lists, read_styles, word_lines
from tests.test_sources import REL, RELS, archive

W = 'xmlns:w="w"'


def body(inner, styles=None, numbering=None):
    return Reader(read_styles(styles and f"<w:styles {W}>{styles}</w:styles>"), read_lists(numbering and f"<w:numbering {W}>{numbering}</w:numbering>")).read(f"<w:document {W}><w:body>{inner}</w:body></w:document>")


def p(text="x", ppr="", rpr=""):
    return f"<w:p><w:pPr>{ppr}</w:pPr><w:r><w:rPr>{rpr}</w:rPr><w:t>{text}</w:t></w:r></w:p>"


def test_text_of_runs():
    inner = "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:noBreakHyphen/><w:softHyphen/><w:sym w:char='F041'/></w:r><w:ins><w:r><w:t>in</w:t></w:r></w:ins><w:del><w:r><w:delText>out</w:delText></w:r></w:del><w:sdt><w:sdtContent><w:r><w:t>ctl</w:t></w:r></w:sdtContent></w:sdt><w:r><w:rPr><w:vanish/></w:rPr><w:t>hid</w:t></w:r></w:p>"
    d = body(inner)
    assert "".join(r.text for r in d.blocks[0].runs) == "a\tb\n‑­Ainctl" and ("revision", "del") in d.notes


def test_style_chain_defaults_and_explicit_off():
    styles = "<w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val='24'/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:type='paragraph' w:styleId='A'><w:name w:val='A'/><w:pPr><w:keepNext/><w:spacing w:before='200'/></w:pPr></w:style><w:style w:type='paragraph' w:styleId='B' w:default='1'><w:name w:val='B'/><w:basedOn w:val='A'/><w:pPr><w:keepNext w:val='0'/></w:pPr><w:rPr><w:sz w:val='30'/></w:rPr></w:style>"
    b = body(p(), styles).blocks[0]
    assert (b.style["keep_next"], b.style["before"], b.runs[0].size) == (False, 200 * TWIP, 30 * HALF_POINT)
    assert body(p("x", "<w:pStyle w:val='A'/>"), styles).blocks[0].style["keep_next"]
    circle = "<w:style w:type='paragraph' w:styleId='A'><w:basedOn w:val='B'/></w:style><w:style w:type='paragraph' w:styleId='B'><w:basedOn w:val='A'/></w:style>"
    assert body(p("x", "<w:pStyle w:val='A'/>"), circle).blocks[0].runs[0].size == 20 * HALF_POINT
    assert body(p()).blocks[0].runs[0].size == 22 * HALF_POINT


def test_headings_have_spaces_only_if_none_is_stated():
    h = "<w:style w:type='paragraph' w:styleId='H'><w:name w:val='heading 1'/>{}</w:style>"
    assert body(p("x", "<w:pStyle w:val='H'/>"), h.format("")).blocks[0].style["before"] == 240 * TWIP
    assert body(p("x", "<w:pStyle w:val='H'/>"), h.format("<w:pPr><w:spacing w:after='0'/></w:pPr>")).blocks[0].style["before"] == 0


def test_hanging_wins_and_sides_have_two_names():
    s = body(p("x", "<w:ind w:start='100' w:end='50' w:firstLine='20' w:hanging='40'/>")).blocks[0].style
    assert (s["indent_left"], s["indent_right"], s["indent_first"]) == (100 * TWIP, 50 * TWIP, -40 * TWIP)


def test_page_breaks_part_a_paragraph():
    d = body("<w:p><w:pPr><w:spacing w:before='20' w:after='40'/></w:pPr><w:r><w:t>a</w:t><w:br w:type='page'/><w:t>b</w:t></w:r></w:p>")
    assert [(b.runs[0].text, b.style["before"], b.style["after"], b.style["break_before"]) for b in d.blocks] == [("a", 20 * TWIP, 0.0, False), ("b", 0.0, 40 * TWIP, True)]
    assert len(pages_of(d)) == 2


def test_caps():
    assert [(r.text, r.size) for r in body(p("aBc", rpr="<w:smallCaps/><w:sz w:val='20'/>")).blocks[0].runs] == [("A", 16 * HALF_POINT), ("B", 20 * HALF_POINT), ("C", 16 * HALF_POINT)]
    assert body(p("aBc", rpr="<w:caps/>")).blocks[0].runs[0].text == "ABC"


LISTS = "<w:abstractNum w:abstractNumId='0'>" + "".join(f"<w:lvl w:ilvl='{i}'><w:start w:val='1'/><w:numFmt w:val='{f}'/><w:lvlText w:val='{t}'/></w:lvl>" for i, (f, t) in enumerate([("decimal", "%1."), ("lowerLetter", "%1.%2"), ("upperRoman", "%3)")])) + "</w:abstractNum><w:num w:numId='1'><w:abstractNumId w:val='0'/></w:num><w:num w:numId='2'><w:abstractNumId w:val='0'/></w:num><w:num w:numId='3'><w:abstractNumId w:val='0'/><w:lvlOverride w:ilvl='0'><w:startOverride w:val='7'/></w:lvlOverride></w:num>"


@pytest.mark.parametrize(
    ("steps", "want"),
    [
        ([(1, 0), (2, 0), (1, 0), (2, 0)], ["1.", "2.", "3.", "4."]),
        ([(1, 0), (1, 1), (1, 1), (1, 0), (1, 1)], ["1.", "1.a", "1.b", "2.", "2.a"]),
        ([(1, 0), (3, 0), (3, 0), (1, 0)], ["1.", "7.", "8.", "9."]),
        ([(1, 1), (1, 2), (1, 2)], ["1.a", "I)", "II)"]),
        ([(9, 0)], [""]),
    ],
)
def test_markers(steps, want):
    c = Counters(read_lists(f"<w:numbering {W}>{LISTS}</w:numbering>"))
    assert [c.marker(str(n), i) for n, i in steps] == want


def test_lists_in_the_body():
    item = "<w:numPr><w:ilvl w:val='{}'/><w:numId w:val='1'/></w:numPr>"
    d = body(p("a", item.format(0)) + p("b", item.format(1)) + p("none") + p("c", item.format(0)), numbering=LISTS)
    assert d.markers == {0: "1.", 1: "1.a", 3: "2."}


def test_tables():
    d = body("<w:tbl><w:tblPr><w:tblW w:w='2500' w:type='pct'/><w:jc w:val='center'/></w:tblPr><w:tblGrid><w:gridCol w:w='1000'/><w:gridCol w:w='2000'/></w:tblGrid><w:tr><w:trPr><w:tblHeader/><w:trHeight w:val='300' w:hRule='exact'/></w:trPr><w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr>" + p() + "</w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge w:val='restart'/></w:tcPr>" + p() + "</w:tc><w:tc>" + p() + "</w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr>" + p() + "</w:tc><w:tc>" + p() + "</w:tc></w:tr></w:tbl>")
    t = d.blocks[0]
    assert isinstance(t, Table) and t.rows[0].header and t.rows[0].exact and t.rows[0].height == 300 * TWIP and t.fraction == 0.5
    assert t.rows[0].cells[0].span == 2 and t.rows[1].cells[0].merge == "restart" and t.rows[2].cells[0].merge == "continue"
    assert len(pages_of(d)[0].rows) == 3


def test_geometry_and_contextual_spacing():
    d = body(p("a", "<w:contextualSpacing/><w:spacing w:before='100' w:after='100'/>") + p("b") + "<w:sectPr><w:pgSz w:w='12000' w:h='9000'/><w:pgMar w:left='600' w:right='600' w:gutter='200'/><w:cols w:num='2' w:space='400'/></w:sectPr>")
    assert [round(c / TWIP) for pair in d.geometry.columns for c in pair] == [800, 5100, 6300, 5100]
    assert isinstance(d.blocks[0], Paragraph) and (d.blocks[0].style["before"], d.blocks[0].style["after"]) == (100 * TWIP, 0.0)


def docx(inner):
    return archive(
        ("_rels/.rels", RELS.format(REL.format("r", "officeDocument", "word/document.xml", ""))),
        ("word/_rels/document.xml.rels", RELS.format(REL.format("n", "numbering", "numbering.xml", ""))),
        ("word/document.xml", f"<w:document {W}><w:body>{inner}</w:body></w:document>"),
        ("word/numbering.xml", f"<w:numbering {W}>{LISTS}</w:numbering>"),
    )


def test_packages_to_lines(spark):
    docs = spark.createDataFrame([("a", bytearray(docx(p("first", "<w:numPr><w:numId w:val='1'/></w:numPr>") + p("second " * 40)))), ("b", bytearray(b"x")), ("c", bytearray(docx("<w:p>")))], "doc string, content binary")
    rows = word_lines(docs).orderBy("doc", "page", "block", "line").collect()
    a = [r for r in rows if r["doc"] == "a"]
    assert (a[0]["text"], a[0]["marker"]) == ("first", "1.") and "".join(r["text"] for r in a[1:]) == "second " * 40
    assert {r["doc"]: bool(r["error"]) for r in rows} == {"a": False, "b": True, "c": True}
    assert open_word(docx(p())).blocks


def reader(**parts):
    wrap = {"footnotes": "footnotes", "endnotes": "endnotes", "settings": "settings"}
    known = {k: f"<w:{v} {W}>{parts.pop(k)}</w:{v}>" for k, v in wrap.items() if k in parts}
    return Reader(read_styles(None), read_lists(None), {k: f"<w:hdr {W}>{v}</w:hdr>" for k, v in parts.items()}, **known)


def read(r, inner):
    return r.read(f"<w:document {W} xmlns:r='r'><w:body>{inner}</w:body></w:document>")


def test_sections_inherit_furniture():
    sect = "<w:sectPr>{}</w:sectPr>"
    ref = "<w:headerReference w:type='{}' r:id='{}'/>"
    d = read(reader(a=p("A"), b=p("B"), settings="<w:evenAndOddHeaders/>"), "<w:p><w:pPr>" + sect.format(ref.format("default", "a") + ref.format("first", "b") + "<w:titlePg/>") + "</w:pPr><w:r><w:t>one</w:t></w:r></w:p>" + p("two") + sect.format("<w:type w:val='oddPage'/><w:pgNumType w:fmt='lowerRoman' w:start='5'/>" + ref.format("even", "zz")))
    one, two = d.sections
    assert [sorted(s.headers) for s in d.sections] == [["default", "first"], ["default", "first"]] and one.title_page and not two.title_page and two.even_odd
    assert (two.start, two.first_number, two.numerals) == ("oddPage", 5, "lowerRoman") and ("missing part", "zz") in d.notes
    assert [(q.section, q.number) for q in pages_of(d)] == [(0, 1), (0, 2), (1, 5)]


def test_continuous_sections_go_on():
    d = read(reader(), "<w:p><w:pPr><w:sectPr/></w:pPr></w:p>" + p("x") + "<w:sectPr><w:type w:val='continuous'/></w:sectPr>")
    assert len(d.sections) == 1 and len(d.blocks) == 2


def test_notes_number_by_first_reference():
    ref = "<w:p><w:r><w:t>t</w:t><w:footnoteReference w:id='{}'/><w:endnoteReference w:id='1'/></w:r></w:p>"
    d = read(reader(footnotes="<w:footnote w:id='7'><w:p><w:r><w:footnoteRef/><w:t> seven</w:t></w:r></w:p></w:footnote><w:footnote w:id='3'>" + p("three") + "</w:footnote>", endnotes="<w:endnote w:id='1'>" + p("end") + "</w:endnote>"), ref.format(7) + ref.format(3) + ref.format(7) + ref.format(9))
    assert [[r.text for r in b.runs] for b in d.blocks[:4]] == [["t", "1", "i"], ["t", "2", "i"], ["t", "1", "i"], ["t", "3", "i"]]
    assert {k: v[0].runs[0].text for k, v in d.sections[0].notes.items()} == {1: "1 seven", 2: "three"} and d.blocks[4].runs[0].text == "end"
    assert ("missing footnote", "9") in d.notes and len(pages_of(d)[0].footnotes) == 2


def test_fields():
    complex_ = "<w:r><w:fldChar w:fldCharType='begin'/></w:r><w:r><w:instrText> PAGE \\* roman </w:instrText></w:r><w:r><w:fldChar w:fldCharType='separate'/></w:r><w:r><w:t>9</w:t></w:r><w:r><w:fldChar w:fldCharType='end'/></w:r>"
    d = read(reader(), f"<w:p>{complex_}<w:r><w:t>/</w:t></w:r><w:fldSimple w:instr='NUMPAGES'><w:r><w:t>9</w:t></w:r></w:fldSimple><w:fldSimple w:instr='DATE'><w:r><w:t>today</w:t></w:r></w:fldSimple></w:p>")
    assert [(r.text, r.field, r.numeral) for r in d.blocks[0].runs] == [("1", "page", "lowerRoman"), ("/", None, None), ("1", "pages", None), ("today", None, None)]


def test_line_numbers_and_tab_step():
    d = read(reader(settings="<w:defaultTabStop w:val='360'/>"), p("a") + "<w:sectPr><w:lnNumType w:countBy='2' w:restart='continuous'/></w:sectPr>")
    assert d.sections[0].line_numbers.by == 2 and d.blocks[0].style["tabs"].step == 360 * TWIP


def test_borders_of_a_paragraph():
    b = body(p("x", "<w:pBdr><w:top w:val='single' w:sz='8' w:space='3'/><w:bottom w:val='nil'/><w:between w:val='single'/></w:pBdr>")).blocks[0].style["borders"]
    assert b == {"top": Rule(96 / 72, 4.0), "inside_h": Rule(0.5 * 96 / 72, 0.0)}


def test_auto_line_spacing_is_a_multiple_of_single_spacing():
    single, double = (pages_of(open_word(docx(p("a", f'<w:spacing w:line="{n}" w:lineRule="auto"/>'))))[0].lines[0] for n in (240, 480))
    plain = pages_of(open_word(docx(p("a"))))[0].lines[0]
    assert single.height == pytest.approx(plain.height) and double.height == pytest.approx(2 * plain.height)
    unnamed = pages_of(open_word(docx(p("a", '<w:spacing w:line="360"/>'))))[0].lines[0]
    assert unnamed.height == pytest.approx(1.5 * plain.height)
