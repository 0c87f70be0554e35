import os
import re
from pathlib import Path

import pytest

from leafmill.operators import archives, flow, render, tables
from leafmill.operators.pages import paginate
from leafmill.sources import fonts
from leafmill.streaming import inbox
from tests.test_word import docx, p

SF = "/root/testdata/sf0.001"
DEJAVU = Path("/usr/share/fonts/truetype/dejavu")


def test_conversation_pages_equal_the_kernel(spark):
    got = {(r["conv_id"], r["turn"]): r for r in flow.conversation_pages(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    assert len(got) == len(rows)
    for conv in {r["conv_id"] for r in rows}:
        turns = [r for r in rows if r["conv_id"] == conv]
        pages = [got[conv, r["turn"]]["first_page"] for r in turns]
        assert pages == sorted(pages)
        assert sum(got[conv, r["turn"]]["n_lines"] for r in turns) >= len(turns)


def test_svg_is_well_formed_and_in_paint_order(spark):
    ops = render.draw_ops(spark, SF).where("doc_id = 5 and page = 0").orderBy("z").collect()
    assert [o["z"] for o in ops] == list(range(len(ops))) and [o["layer"] for o in ops] == sorted(o["layer"] for o in ops)
    page = render.svg(render.page_ops(spark, SF).where("doc_id = 5"), 100.0, 50.5).orderBy("page").first()["svg"]
    from leafmill.sources.xml import parse

    t = parse(page)
    root = next(t.elements("svg"))
    assert t.attributes(root)["viewBox"] == "0 0 100 50.5" and len(list(t.elements("text"))) == sum(o["kind"] == "text" for o in ops)


def test_docx_read_keeps_every_character(spark):
    rows = {r["doc_id"]: r for r in archives.docx_read(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        blocks = r["text"].split("\n")
        got = rows[r["doc_id"]]
        assert got["n_chars"] == sum(map(len, blocks)) and got["n_blocks"] == len(blocks)


def test_sums_agree(spark):
    assert all(r["n_parts"] == r["n_intact"] == 3 for r in archives.crc32_parts(spark, SF).collect())


def test_layout_needs_no_shuffle_where_files_give_enough_partitions(spark, monkeypatch):
    monkeypatch.setattr(flow, "spread", lambda docs: docs)
    plan = flow.pages_per_document(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan)


def test_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a\n\nb")], "doc_id long, text string")
    rows = flow.placed_lines(docs).orderBy("doc_id", "block").collect()
    assert [(r["doc_id"], r["block"], r["start"], r["end"]) for r in rows] == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 1), (3, 1, 0, 0), (3, 2, 0, 1)]
    assert flow.placed_lines(docs.limit(0)).count() == 0


def test_tables_of_keys(spark):
    rows = spark.createDataFrame([(1, k, "v") for k in range(6)], "id long, k int, v string")
    got = tables.placed_rows(rows, "id", ["k"], ["k", "v"], ["k", "v"]).orderBy("page", "y_milli").collect()
    assert [(r["row"], r["page"], r["repeated"]) for r in got] == [(0, 0, False), (1, 0, False), (2, 0, False), (3, 0, False), (4, 0, False), (0, 1, True), (5, 1, False), (6, 1, False)]


@pytest.mark.skipif(not (DEJAVU / "DejaVuSans.ttf").exists(), reason="no font at hand")
def test_fonts(spark):
    raw = (DEJAVU / "DejaVuSans.ttf").read_bytes()
    f = fonts.parse(raw)
    assert f.em == 2048 and f.family == "DejaVu Sans" and f.advance(ord("A")) == 1401 and f.glyph(0x2011) and f.glyph(0xE0041) == 0
    assert f.pairs[f.glyph(ord("A")), f.glyph(ord("V"))] < 0
    face = f.face("AV ")
    from leafmill.operators.lines import Paragraph, Run, Text

    kerned = Text([Run("AVA", 16.0, face, kerned=True)]).width(0, 3)
    assert kerned < Text([Run("AVA", 16.0, face)]).width(0, 3)
    assert paginate([Paragraph([Run("AV", 16.0, face)])], flow.SMALL)[0].lines[0].height == pytest.approx(f.em and (f.ascent - f.descent + f.gap) * 16 / f.em)
    files = spark.createDataFrame([("sans", bytearray(raw)), ("bad", bytearray(b"no"))], "font string, content binary")
    rows = {r["font"]: r for r in fonts.metrics(files).collect()}
    assert rows["sans"]["em"] == 2048 and rows["bad"]["error"]
    good = files.where("font = 'sans'")
    texts = spark.createDataFrame([(1, "sans", "AA b"), (2, "sans", "\U000e0041")], "id long, font string, text string")
    got = {r["id"]: (r["advance"], r["n_missing"]) for r in fonts.advance_of(texts, fonts.glyphs(good)).collect()}
    assert got == {1: (2 * 1401 + f.advance(32) + f.advance(ord("b")), 0), 2: (0, 1)}
    assert fonts.kern_pairs(good, "AV").count() > 0


def test_faces_resolve_by_alias_and_default(spark):
    families = spark.createDataFrame([("Serif", ["Times"], {"regular": "s.ttf", "bold": "sb.ttf"}), ("Sans", ["Arial", "Helvetica"], {"regular": "n.ttf"})], "family string, aliases array<string>, files map<string,string>")
    asked = spark.createDataFrame([(" arial ", False, False), ("TIMES", True, False), ("Times", True, True), ("Nowhere", True, False)], "family string, bold boolean, italic boolean")
    got = {(r["family"], r["bold"], r["italic"]): (r["shipped"], r["file"]) for r in fonts.resolved_faces(asked, families, "Sans").collect()}
    assert got == {(" arial ", False, False): ("Sans", "n.ttf"), ("TIMES", True, False): ("Serif", "sb.ttf"), ("Times", True, True): ("Serif", "s.ttf"), ("Nowhere", True, False): ("Sans", "n.ttf")}


def test_an_inbox_is_read_once(spark, tmp_path):
    box = tmp_path / "in"
    os.makedirs(box)
    (box / "a.docx").write_bytes(docx(p("first")))
    (box / "b.docx").write_bytes(b"broken")
    paths = (f"file://{box}", f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    inbox.start(spark, *paths, once=True).awaitTermination(120)
    (box / "c.docx").write_bytes(docx(p("second")))
    inbox.start(spark, *paths, once=True).awaitTermination(120)
    rows = spark.read.parquet(paths[1]).collect()
    assert sorted(r["text"] or "" for r in rows) == ["", "first", "second"] and sum(r["error"] is not None for r in rows) == 1


def test_continues_without_a_restart_are_cells_of_their_own(spark):
    from leafmill.operators.relational import merge_spans

    kinds = ["continue", "continue", "restart", "continue", "continue", None, "continue", "restart", "restart"]
    rows = spark.createDataFrame([(1, k, m) for k, m in enumerate(kinds)], "id long, k int, merge string")
    got = [r["cell"] for r in merge_spans(rows, "id", ["k"], "merge").orderBy("k").collect()]
    assert got == [1, 2, 3, 3, 3, 4, 5, 6, 7]


def test_styles_resolve_in_their_own_document(spark):
    from leafmill.operators.relational import cascade

    rows = [(1, "a", None, 10, None), (1, "b", "a", None, True), (1, "c", "b", 30, None), (2, "b", "c", None, None), (2, "c", "b", 7, None), (2, "d", "gone", None, False), (3, "a", "a", None, None)]
    style = spark.createDataFrame(rows, "doc_id int, id string, based_on string, size int, bold boolean")
    got = {(r["doc_id"], r["id"]): (r["depth"], r["size"], r["bold"]) for r in cascade(style, ["size", "bold"]).collect()}
    assert got == {(1, "a"): (0, 10, None), (1, "b"): (1, 10, True), (1, "c"): (2, 30, True), (2, "b"): (1, 7, None), (2, "c"): (1, 7, None), (2, "d"): (0, None, False), (3, "a"): (0, None, None)}


def test_relational_operators_take_any_columns(spark):
    from leafmill.operators import placement, relational

    p = spark.createDataFrame([("d", 1, "s", 5, 9), ("d", 2, "s", 7, 3), ("d", 3, None, 1, 1), ("d", 4, None, 1, 1)], "doc string, k int, style string, b int, a int")
    assert [(r["added"], r["gap"]) for r in relational.gaps(p, "doc", ["k"], "b", "a").orderBy("k").collect()] == [(5, 5), (0, 9), (0, 3), (0, 1)]
    assert [(r["b"], r["a"]) for r in relational.beside_same(p, "doc", ["k"], "style", "b", "a").orderBy("k").collect()] == [(5, 0), (0, 3), (1, 1), (1, 1)]
    refs = spark.createDataFrame([("d", 1, "z"), ("d", 2, "y"), ("d", 3, "z"), ("e", 1, "y")], "doc string, at int, note string")
    assert {(r["doc"], r["note"]): (r["number"], r["n_references"]) for r in relational.numbered(refs, "doc", ["at"], "note").collect()} == {("d", "z"): (1, 2), ("d", "y"): (2, 1), ("e", "y"): (1, 1)}
    t = spark.createDataFrame([(1, 50.0, 80.0, None, "center", None), (2, 50.0, None, 0.5, "left", 4.0), (3, 0.0, 10.0, None, "right", None)], "id int, own double, preferred double, fraction double, alignment string, indent double")
    assert [(r["width"], r["scale"], r["left_edge"]) for r in relational.fitted(t, "own", "preferred", "fraction", "alignment", "indent", 100.0).orderBy("id").collect()] == [(80.0, 1.6, 10.0), (50.0, 1.0, 4.0), (0.0, 1.0, 100.0)]
    cells = spark.createDataFrame([("t", r, c, 3 if (r, c) == (1, 0) else None, None) for r in range(2) for c in range(2)], "t string, r int, c int, up int, none int")
    from pyspark.sql import functions as F

    got = placement.resolved_edges(cells, "t", "r", "c", {"top": "up", "bottom": "none", "left": "none", "right": "none"}, dict.fromkeys(("top", "bottom", "left", "right"), F.lit(2)), {"h": F.lit(1), "v": F.lit(1)})
    assert sorted(tuple(x)[1:] for x in got.collect()) == [(0, 0, 2, 3, 2, 1), (0, 1, 2, 1, None, 2), (1, 0, None, 2, 2, 1), (1, 1, None, 2, None, 2)]
