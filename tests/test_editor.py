import json

import pytest

from leafmill.operators.editor import block, editor_starts, position, position_of_row, starts_of
from leafmill.operators.flow import ADVANCE, SMALL
from leafmill.operators.lines import Look
from leafmill.operators.pages import vertical_spans

BASE = {"lineHeightPx": 20.0}
STYLE = {"fontFamily": "Calibri", "fontSizePx": 16.0} | BASE


def text(t, at=None, **more):
    return {"spans": [{"text": t, "at": at}], **more}


def test_spans_take_their_style_from_the_block_and_the_flow():
    p = block({"spans": [{"text": "a"}, {"text": "b", "bold": False, "fontSizePx": 20, "fontFamily": "Serif"}], "style": {"bold": True, "spaceAfterPx": 7, "keepWithNext": True, "indentFirstLinePx": 3, "borders": {"top": {"widthPx": 2, "colorHex": "#FF0000"}}}}, STYLE, {})
    assert [(r.size, r.look) for r in p.runs] == [(16.0, Look(family="Calibri", bold=True)), (20.0, Look(family="Serif"))]
    assert (p.style["after"], p.style["keep_next"], p.style["indent_first"], p.style["line_height"], p.style["borders"]["top"].color) == (7, True, 3, 20.0, "#FF0000")
    empty = block({"spans": []}, STYLE, {})
    assert [(r.text, r.size) for r in empty.runs] == [("", 16.0)]


def test_pages_begin_at_positions():
    lines = ["abcdefghij klmnopqrs "] * 7  # 20 columns: each is a line
    items = [{"spans": [{"text": "".join(lines[:3]), "at": 100}, {"text": "".join(lines[3:]), "at": 500}]}, text("next", 900, pageBreakBefore=True)]
    n = len(lines[0])
    assert starts_of(items, SMALL, BASE, widow=False) == [(1, 0, 5 * n, None, 500 + 2 * n, True), (2, 1, 0, None, 900, False)]


@pytest.mark.parametrize(("item", "offset", "want"), [(text("abc", 5), 2, 7), (text("abc", 5), 3, 8), ({"spans": [], "at": 4}, 0, 4), (text("abc"), 1, None), ({"spans": [{"text": "a\U0001f600", "at": 1}, {"text": "b", "at": 50}]}, 3, 50), ({"spans": [{"text": "ab"}, {"text": "c", "at": 9}]}, 2, None)])
def test_positions(item, offset, want):
    assert position(item, offset) == want


def test_tables_and_row_spans():
    cell = lambda t, **more: {"blocks": [text(t, ord(t))], **more}
    t = {"rows": [{"cells": [cell("a", rowSpan=2, isHeader=True), cell("b", gridSpan=2, rowSpan=3, isHeader=True)]}, {"cells": []}, {"cells": [cell("c")], "heightPx": 50}, {"cells": [cell("d"), cell("e"), cell("f")], "repeatHeader": True}], "columnWidthsPx": [40, 40, 40], "cellPaddingPx": 2, "at": 7}
    made = block(t, STYLE, {})
    assert vertical_spans(made) == [[2, 3], [0, 0], [1, 0], [1, 1, 1]] and [r.header for r in made.rows] == [True, False, False, True]
    assert made.margins == (2.0,) * 4 and made.rows[2].height == 50
    assert [position_of_row(t, k) for k in range(5)] == [ord("a"), 7, ord("c"), ord("d"), None]
    rows = {"rows": [{"cells": [cell(c)]} for c in "abcdefg"], "columnWidthsPx": [ADVANCE * 20], "at": 1}
    assert starts_of([rows], SMALL, BASE) == [(1, 0, 0, 5, ord("f"), True)]


def test_documents(spark):
    docs = spark.createDataFrame([(1, json.dumps([text("a " * 200, 10)])), (2, None), (3, "no json"), (4, "{}"), (5, "[1]"), (None, "[]")], "doc_id long, items string")
    rows = editor_starts(docs, SMALL, BASE, widow=False).orderBy("page").collect()
    assert {r["doc_id"] for r in rows} == {1} and [(r["text_offset"], r["at"]) for r in rows] == [(100 * k, 10 + 100 * k) for k in range(1, 4)]
