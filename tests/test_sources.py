import io
import struct
import zipfile

import pytest

from leafmill.sources import opc, xml

ODD = """<?xml version='1.0'?>
<!-- a > b --><w:root xmlns:w = "u"\tone='a"b' two="c'd&amp;&#x41;"  ><w:e/><w:f  />
 text &lt;&#65; <![CDATA[<raw> & ]]><?pi x?><w:g a="1">t<w:h>u</w:h>v</w:g ></w:root>
"""


def test_every_node_has_its_span():
    t = xml.parse(ODD)
    assert xml.edited(t, []) == ODD
    tops = [n for n in t.nodes if n.parent == -1]
    assert "".join(ODD[n.start : n.end] for n in tops) == ODD
    g = next(t.elements("g"))
    assert t.value(g) == "tuv" and t.attributes(next(t.elements("root")))["two"] == "c'd&A"
    assert t.value(next(t.elements("root"))).strip().startswith("text <A <raw> & ")


def test_edits_change_their_own_spans():
    t = xml.parse(ODD)
    g, e, root = next(t.elements("g")), next(t.elements("e")), next(t.elements("root"))
    out = xml.edited(t, [xml.Edit(g.id, "a", '2"'), xml.Edit(e.id, None, "<"), xml.Edit(root.id, "one", None), xml.Edit(g.id, "b", "new")])
    assert out == ODD.replace('a="1"', 'a="2&quot;" b="new"').replace("<w:e/>", "<w:e>&lt;</w:e>").replace("\tone='a\"b'", "")


@pytest.mark.parametrize("bad", ["<a>", "<a></b>", "<a b='1' b='2'/>", "<a>&nope;</a>", "<a>& </a>", "<a/><b/>", "text", "<a b=1/>", "<!DOCTYPE a [<!ENTITY x 'y'>]><a/>", ""])
def test_malformed(bad):
    with pytest.raises(xml.BadXml):
        xml.parse(bad)


def test_where_it_is_wrong():
    with pytest.raises(xml.BadXml, match="line 2, column 3"):
        xml.parse("<a>\n  </b></a>")


def archive(*entries, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in entries:
            z.writestr(name, content)
        z.comment = comment
    return out.getvalue()


def test_parts_agree_with_another_reader():
    raw = archive(("a.xml", "x" * 500), ("dir/", ""), ("dir/é.bin", b"\x00\x01"), comment=b"c" * 300)
    parts = opc.read_parts(raw)
    assert [(p.name, p.content()) for p in parts] == [("a.xml", b"x" * 500), ("dir/é.bin", b"\x00\x01")]
    again = opc.write_parts(parts)
    with zipfile.ZipFile(io.BytesIO(again)) as z:
        assert z.testzip() is None and z.read("dir/é.bin") == b"\x00\x01" and z.namelist() == ["a.xml", "dir/é.bin"]


def test_refusals():
    raw = archive(("a", "content " * 40))
    at = raw.index(b"PK\x01\x02")
    change = lambda offset, value: raw[: at + offset] + struct.pack("<H", value) + raw[at + offset + 2 :]
    for bad, why in ((b"", "end record"), (raw[: len(raw) // 2], "end record"), (change(8, 1), "encrypted"), (change(10, 12), "method")):
        with pytest.raises(opc.BadPackage, match=why):
            opc.read_parts(bad)
    p = opc.read_parts(raw)[0]
    with pytest.raises(opc.BadPackage):
        opc.Part(p.name, p.method, p.crc ^ 1, p.size, p.data).content()


@pytest.mark.parametrize(("source", "target", "want"), [("word/document.xml", "styles.xml", "word/styles.xml"), ("word/document.xml", "../x/./y.xml", "x/y.xml"), ("word/document.xml", "/word/z.xml", "word/z.xml"), ("", "word/document.xml", "word/document.xml")])
def test_targets(source, target, want):
    assert opc.resolved(source, target) == want


RELS = '<Relationships xmlns="r">{}</Relationships>'
REL = '<Relationship Id="{}" Type="http://x/{}" Target="{}"{}/>'


def package(text="hello"):
    return archive(
        ("_rels/.rels", RELS.format(REL.format("r1", "officeDocument", "word/document.xml", ""))),
        ("word/_rels/document.xml.rels", RELS.format(REL.format("i1", "image", "media/a.PNG", "") + REL.format("h1", "header", "header1.xml", "") + REL.format("x", "image", "http://e", ' TargetMode="External"'))),
        ("word/document.xml", f"<d>{text}</d>"),
        ("word/header1.xml", "<h/>"),
        ("word/media/a.PNG", b"\x89PNG"),
    )


def test_packages_as_tables(spark):
    docs = spark.createDataFrame([("one", bytearray(package())), ("bad", bytearray(b"no archive")), ("none", None)], "doc string, content binary")
    parts = opc.parts(docs)
    assert {(r["doc"], r["error"] is None) for r in parts.collect()} == {("one", True), ("bad", False), ("none", False)}
    links = opc.relationships(parts)
    assert [tuple(r) for r in opc.main_part(links).collect()] == [("one", "word/document.xml")]
    assert [tuple(r) for r in opc.media(parts, links).collect()] == [("one", "i1", "word/media/a.PNG", "image/png")]
    assert [tuple(r) for r in opc.furniture(parts, links).collect()] == [("one", "h1", "header", "word/header1.xml")]
    whole = opc.contents(parts.where("error is null"))
    assert all(r["intact"] for r in whole.collect())
    found = xml.nodes(whole.where("name like '%.xml'")).where("name = 'word/document.xml'").orderBy("node").collect()
    assert [(r["kind"], r["element"], r["start"], r["end"]) for r in found] == [("element", "d", 0, 12), ("text", None, 3, 8)]


def test_saving_keeps_stored_bytes(spark):
    raw = package()
    docs = spark.createDataFrame([("one", bytearray(raw))], "doc string, content binary")
    new = spark.createDataFrame([("one", "word/document.xml", bytearray(b"<d>new</d>")), ("one", "no/such", bytearray(b"x"))], "doc string, name string, content binary")
    out = opc.read_parts(bytes(opc.saved(opc.parts(docs), new).first()["content"]))
    before = {p.name: p for p in opc.read_parts(raw)}
    assert [p.name for p in out] == list(before)
    for p in out:
        assert p.content() == b"<d>new</d>" if p.name == "word/document.xml" else p.data == before[p.name].data
