"""Packages made from documents, read back and laid out: the sources end to end on tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.flow import documents, spread
from leafmill.operators.render import word_svg
from leafmill.plans.session import ship
from leafmill.sources import opc, word, xml

_RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
_TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>'
_BODY = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'


#: Packages of a batch that a task hands on.
AT_ONCE = 200


def made_packages(docs: DataFrame) -> DataFrame:
    """(doc, content): each document as a package of one paragraph a line."""

    def parts(text: str) -> dict[str, str]:
        return {"[Content_Types].xml": _TYPES, "_rels/.rels": _RELS, "word/document.xml": _BODY.format("".join(map(_paragraph, text.split("\n"))))}

    return packed(docs.select("doc_id", "text"), lambda text: parts(text or ""))


def packed(docs: DataFrame, make: Callable[..., dict[str, str]]) -> DataFrame:
    """(doc, content): the package of the parts that make gives of each row (doc_id and what make is given)."""
    ship(docs.sparkSession)
    given = docs.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[str, bytes]] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([d for d, _ in made], pa.string()), pa.array([c for _, c in made], pa.binary())], ["doc", "content"])
        for b in batches:
            for doc, *values in zip(*(b.column(c).to_pylist() for c in ("doc", *given)), strict=True):
                made.append((doc, opc.write_parts([opc.stored(name, content.encode()) for name, content in make(*values).items()])))
                if len(made) >= AT_ONCE:
                    yield batch()
                    made = []
        yield batch()

    return spread(docs.select(F.col("doc_id").cast("string").alias("doc"), *given)).mapInArrow(run, "doc string, content binary")


def _paragraph(text: str, style: str = "", behind: str = "") -> str:
    return f'<w:p>{style}<w:r><w:t xml:space="preserve">{xml.escape(text)}</w:t></w:r>{behind}</w:p>'


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
_RICH_RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{_LINKS}{kind}" Target="{target}"/>' for i, kind, target in (("h", "header", "header1.xml"), ("f", "footer", "footer1.xml"), ("s", "styles", "styles.xml"), ("n", "footnotes", "footnotes.xml"))) + "</Relationships>"
#: A table style with rules all round, a filled first row in bold red, and every other row below it filled; a paragraph style of blue, underlined text.
_STYLES = f"""<w:styles {_W}><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>
<w:style w:type="paragraph" w:styleId="Marked"><w:name w:val="Marked"/><w:basedOn w:val="Normal"/><w:rPr><w:color w:val="0000FF"/><w:u w:val="single"/></w:rPr></w:style>
<w:style w:type="table" w:styleId="Base"><w:name w:val="Base"/><w:tblPr><w:tblBorders>{"".join(f'<w:{side} w:val="single" w:sz="8"/>' for side in ("top", "left", "bottom", "right", "insideH", "insideV"))}</w:tblBorders></w:tblPr></w:style>
<w:style w:type="table" w:styleId="Bands"><w:name w:val="Bands"/><w:basedOn w:val="Base"/><w:tblStylePr w:type="firstRow"><w:rPr><w:b/><w:color w:val="FF0000"/></w:rPr><w:tcPr><w:shd w:fill="CCCCCC"/></w:tcPr></w:tblStylePr><w:tblStylePr w:type="band1Horz"><w:tcPr><w:shd w:fill="EEEEEE"/></w:tcPr></w:tblStylePr></w:style></w:styles>"""


def rich_packages(docs: DataFrame) -> DataFrame:
    """(doc, content): documents as packages with a table (a header row and up to three others), styled paragraphs, a header, a footer with the page's number and a footnote."""

    def parts(text: str | None, lang: str | None, source: str | None, n_rows: int) -> dict[str, str]:
        cells = lambda *texts: "<w:tr>" + "".join(f"<w:tc>{_paragraph(t)}</w:tc>" for t in texts) + "</w:tr>"
        rows = cells("field", "value") + "".join(cells(*r) for r in [("lang", lang or ""), ("source", source or ""), ("rows", str(n_rows))][:n_rows])
        table = f'<w:tbl><w:tblPr><w:tblStyle w:val="Bands"/><w:tblLook w:val="0020"/></w:tblPr><w:tblGrid><w:gridCol w:w="3000"/><w:gridCol w:w="3000"/></w:tblGrid>{rows}</w:tbl>'
        lines = (text or "").split("\n")
        mark = '<w:r><w:footnoteReference w:id="1"/></w:r>'
        body = "".join(_paragraph(t, '<w:pPr><w:pStyle w:val="Marked"/></w:pPr>' if k == 0 else "", mark if k == len(lines) - 1 else "") for k, t in enumerate(lines))
        end = '<w:sectPr><w:headerReference w:type="default" r:id="h"/><w:footerReference w:type="default" r:id="f"/></w:sectPr>'
        return {
            "[Content_Types].xml": _TYPES, "_rels/.rels": _RELS, "word/_rels/document.xml.rels": _RICH_RELS, "word/styles.xml": _STYLES,
            "word/document.xml": f"<w:document {_W}><w:body>{table}{body}{end}</w:body></w:document>",
            "word/header1.xml": f"<w:hdr {_W}>{_paragraph('from ' + (source or ''))}</w:hdr>",
            "word/footer1.xml": f'<w:ftr {_W}><w:p><w:r><w:t xml:space="preserve">page </w:t></w:r><w:fldSimple w:instr="PAGE"><w:r><w:t>0</w:t></w:r></w:fldSimple></w:p></w:ftr>',
            "word/footnotes.xml": f'<w:footnotes {_W}><w:footnote w:id="1">{_paragraph("in " + (lang or ""))}</w:footnote></w:footnotes>',
        }

    return packed(docs.select("doc_id", "text", "lang", "source", (F.col("doc_id") % 4).cast("int").alias("n_rows")), parts)


def crc32_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages made from documents: how many parts, how many whose size and sum agree with their content, and the bytes of the document's part."""
    parts = opc.contents(opc.parts(made_packages(documents(spark, sf_dir))))
    return parts.groupBy(F.col("doc").cast("long").alias("doc_id")).agg(F.count("*").alias("n_parts"), F.count_if("intact").alias("n_intact"), F.sum(F.when(F.col("name") == "word/document.xml", F.octet_length("content"))).alias("document_bytes"))


_EMPTY = len(_BODY.format(""))
_EACH = len(_paragraph(""))
CRC_SQL = f"""
WITH b AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t FROM documents)
SELECT doc_id, CAST(3 AS BIGINT) AS n_parts, CAST(3 AS BIGINT) AS n_intact, CAST({_EMPTY} + sum({_EACH} + strlen(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))) AS BIGINT) AS document_bytes FROM b GROUP BY doc_id"""


def zip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages saved with a new document part (the text's hash) and read again: how many parts, how many are intact, and the new part's text."""
    docs = documents(spark, sf_dir)
    new = docs.select(F.col("doc_id").cast("string").alias("doc"), F.lit("word/document.xml").alias("name"), F.encode(F.concat(F.lit("<d>"), F.md5(F.coalesce("text", F.lit(""))), F.lit("</d>")), "utf-8").alias("content"))
    after = opc.contents(opc.parts(opc.saved(opc.parts(made_packages(docs)), new)))
    return after.groupBy(F.col("doc").cast("long").alias("doc_id")).agg(F.count("*").alias("n_parts"), F.count_if("intact").alias("n_intact"), F.max(F.when(F.col("name") == "word/document.xml", F.decode("content", "utf-8"))).alias("new_part"))


ROUNDTRIP_SQL = "SELECT doc_id, CAST(3 AS BIGINT) AS n_parts, CAST(3 AS BIGINT) AS n_intact, '<d>' || md5(coalesce(text, '')) || '</d>' AS new_part FROM documents"


def xml_string_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text under the root of each document part, from its node table: number of text nodes and total length."""
    parts = opc.contents(opc.parts(made_packages(documents(spark, sf_dir))).where("name = 'word/document.xml'"))
    nodes = xml.nodes(parts).where("error is null")
    return nodes.groupBy(F.col("doc").cast("long").alias("doc_id")).agg(F.count_if(F.col("element") == "w:p").alias("n_paragraphs"), F.count_if(F.col("kind") == "text").alias("n_texts"), F.sum(F.when(F.col("kind") == "text", F.col("end") - F.col("start")).otherwise(0)).alias("n_chars"))


VALUE_SQL = """
WITH b AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t FROM documents)
SELECT doc_id, count(*) AS n_paragraphs, count(CASE WHEN length(t) > 0 THEN 1 END) AS n_texts, CAST(sum(length(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))) AS BIGINT) AS n_chars FROM b GROUP BY doc_id"""


def docx_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packages made from documents, read and laid out on their own pages: paragraphs, shown characters, and whether lines and pages are at least as many as they must be."""
    lines = word.word_lines(made_packages(documents(spark, sf_dir))).where("layer = 'line'")
    got = lines.groupBy(F.col("doc").cast("long").alias("doc_id")).agg(F.countDistinct("block").alias("n_blocks"), F.count("*").alias("n_lines"), F.countDistinct("page").alias("n_pages"), F.sum(F.char_length("text")).alias("n_chars"))
    return got.select("doc_id", "n_blocks", "n_chars", (F.col("n_lines") >= F.col("n_blocks")).alias("lines_hold"), (F.col("n_pages") * 200 >= F.col("n_lines")).alias("pages_hold"))


READ_SQL = """
WITH b AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t FROM documents)
SELECT doc_id, count(*) AS n_blocks, CAST(sum(length(t)) AS BIGINT) AS n_chars, true AS lines_hold, true AS pages_hold FROM b GROUP BY doc_id"""


def docx_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text of packages with tables, headers, footers and notes, by layer: lines of the body and of notes in order, what each row, header and footer shows."""
    lines = word.word_lines(rich_packages(documents(spark, sf_dir))).where("error is null")
    joined = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda r: r["text"]), "")
    page = F.when(F.col("layer").isin("line", "note"), F.col("page")).otherwise(0)  # a row, header or footer is the same on each page, but for the number
    text = F.when(F.col("layer") == "footer", F.regexp_replace("text", "[0-9]+", "n")).otherwise(F.col("text"))
    one = lines.select("doc", "layer", page.alias("page"), "block", "line", F.when(F.col("layer") == "row", F.col("x_milli")).alias("x"), text.alias("text")).distinct()
    got = one.groupBy(F.col("doc").cast("long").alias("doc_id"), "layer").agg(joined(F.collect_list(F.struct("page", "block", "line", "x", "text"))).alias("shown"))
    return got.select("doc_id", "layer", F.when(F.col("layer") == "line", F.md5("shown")).otherwise(F.col("shown")).alias("shown"))


LAYERS_SQL = """
SELECT doc_id, 'line' AS layer, md5(replace(coalesce(text, ''), chr(10), '') || '1') AS shown FROM documents
UNION ALL SELECT doc_id, 'header', 'from ' || coalesce(source, '') FROM documents
UNION ALL SELECT doc_id, 'footer', 'page n' FROM documents
UNION ALL SELECT doc_id, 'note', 'in ' || coalesce(lang, '') FROM documents
UNION ALL SELECT doc_id, 'row', 'fieldvalue' || CASE WHEN doc_id % 4 > 0 THEN 'lang' || coalesce(lang, '') ELSE '' END || CASE WHEN doc_id % 4 > 1 THEN 'source' || coalesce(source, '') ELSE '' END || CASE WHEN doc_id % 4 > 2 THEN 'rows3' ELSE '' END FROM documents"""


def docx_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is drawn of the tables of those packages: filled cells, rules, texts in the header row's bold red; and of the body, texts in its first paragraph's blue."""
    ops = word.word_operations(rich_packages(documents(spark, sf_dir)))
    row = F.col("layer") == "row"
    return ops.groupBy(F.col("doc").cast("long").alias("doc_id")).agg(
        F.count_if(row & (F.col("kind") == "rect") & (F.col("color") == "#CCCCCC")).alias("n_head_fills"),
        F.count_if(row & (F.col("kind") == "rect") & (F.col("color") == "#EEEEEE")).alias("n_band_fills"),
        F.count_if(row & (F.col("kind") == "line")).alias("n_rules"),
        F.count_if(row & (F.col("kind") == "text") & F.col("bold") & (F.col("color") == "#FF0000")).alias("n_head_texts"),
        F.md5(F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("layer") == "line") & (F.col("kind") == "text") & (F.col("color") == "#0000FF"), F.struct("page", "z", "text")))), lambda r: r["text"]), ""), F.lit(""))).alias("blue_md5"),
        F.count_if((F.col("layer") == "note") & (F.col("kind") == "line")).alias("n_note_rules"),
    )


#: Of r rows in two columns: a lower rule for each cell, an upper one for the first row's, a left one a row and a right one for each cell.
RULES_SQL = """
WITH r AS (SELECT doc_id, 1 + doc_id % 4 AS r, string_split(coalesce(text, ''), chr(10)) AS t FROM documents)
SELECT doc_id, CAST(2 AS BIGINT) AS n_head_fills, CAST(r // 2 * 2 AS BIGINT) AS n_band_fills, CAST(2 * r + 2 + r + 2 * r AS BIGINT) AS n_rules, CAST(2 AS BIGINT) AS n_head_texts,
  md5(t[1] || CASE WHEN len(t) = 1 THEN '1' ELSE '' END) AS blue_md5, CAST(1 AS BIGINT) AS n_note_rules FROM r"""


def docx_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of those packages as SVG: how many texts, and whether every page is one whole element with its footer's text."""
    pages = word_svg(word.word_operations(rich_packages(documents(spark, sf_dir))))
    whole = F.col("svg").rlike("^<svg [^>]*><rect [^>]*/>(<[a-z]+ [^>]*/>|<text [^>]*>[^<]*</text>)*</svg>$")
    footed = F.col("svg").contains(F.concat(F.lit(">page </text>"))) & F.col("svg").contains(F.concat(F.lit(">"), (F.col("page") + 1).cast("string"), F.lit("</text>")))
    return pages.groupBy(F.col("doc").cast("long").alias("doc_id")).agg((F.count("*") == F.max("page") + 1).alias("in_a_row"), F.min(whole).alias("whole"), F.min(footed).alias("footed"))


SVG_SQL = "SELECT doc_id, true AS in_a_row, true AS whole, true AS footed FROM documents"

QUERIES = {
    "crc32_parts": (crc32_parts, CRC_SQL),
    "zip_roundtrip": (zip_roundtrip, ROUNDTRIP_SQL),
    "xml_string_value": (xml_string_value, VALUE_SQL),
    "docx_read": (docx_read, READ_SQL),
    "docx_layers": (docx_layers, LAYERS_SQL),
    "docx_rules": (docx_rules, RULES_SQL),
    "docx_svg": (docx_svg, SVG_SQL),
}
