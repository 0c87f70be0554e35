"""Placed pages as draw operations and SVG, by joins and expressions.

A page's operations come in layers; z is their place in paint order. Strings are put together per page, so nothing
larger than a page is ever gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as fn
from leafmill.operators import flow

#: Layers in paint order.
LAYERS = ("header", "footer", "behind", "row", "line", "number", "box", "note", "front")
_OP = {"layer": "int", "ordinal": "long", "part": "int", "kind": "string", "x": "double", "y": "double", "x2": "double", "y2": "double", "width": "double", "height": "double", "size": "double", "text": "string", "color": "string", "style": "string", "family": "string", "bold": "boolean", "italic": "boolean", "kerned": "boolean"}


def one(layer: str, kind: str, **columns: Column) -> Column:
    """An operation of a layer as a struct; what is not stated is null."""
    stated = {"layer": F.lit(LAYERS.index(layer)), "kind": F.lit(kind)} | columns
    return F.struct(*[stated.get(c, F.lit(None)).cast(t).alias(c) for c, t in _OP.items()])


def several(rows: DataFrame, *operations: Column) -> DataFrame:
    """The operations of each row (doc_id, page) from one pass over the rows; null ones are none."""
    return rows.select("doc_id", "page", F.inline(F.array_compact(F.array(*operations))))


def painted(*layers: DataFrame) -> DataFrame:
    """All layers of all pages with z, from 0 on each page."""
    both = reduce(DataFrame.unionByName, layers)
    return both.withColumn("z", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("layer", "ordinal", "part", "kind")) - 1)


def element(pictures: bool = False) -> Column:
    """The SVG element of an operation; pictures have a type and content too."""
    n, a = fn.svg_number, lambda name, value: F.concat(F.lit(f' {name}="'), value, F.lit('"'))
    color = fn.xml_attribute(F.coalesce("color", F.lit("#000000")))
    dash = F.when(F.col("style") == "dashed", a("stroke-dasharray", F.concat(n(F.col("width") * 3), F.lit(","), n(F.col("width") * 2)))).when(F.col("style") == "dotted", a("stroke-dasharray", F.concat(n(F.col("width")), F.lit(","), n(F.col("width") * 2)))).otherwise("")
    on = lambda name: F.coalesce(F.col(name), F.lit(False))
    family = F.when(F.coalesce("family", F.lit("")) == "", "").otherwise(a("font-family", fn.xml_attribute(F.col("family"))))
    weight, slant = F.when(on("bold"), ' font-weight="bold"').otherwise(""), F.when(on("italic"), ' font-style="italic"').otherwise("")
    kerning = F.when(on("kerned"), ' style="font-kerning:normal"').otherwise(' style="font-kerning:none"')
    text = F.concat(F.lit("<text"), a("x", n(F.col("x"))), a("y", n(F.col("y"))), family, a("font-size", n(F.col("size"))), weight, slant, a("fill", color), kerning, F.lit(' xml:space="preserve">'), fn.xml_text(F.coalesce("text", F.lit(""))), F.lit("</text>"))
    rect = F.concat(F.lit("<rect"), a("x", n(F.col("x"))), a("y", n(F.col("y"))), a("width", n(F.col("width"))), a("height", n(F.col("height"))), a("fill", color), F.lit("/>"))
    line = F.concat(F.lit("<line"), a("x1", n(F.col("x"))), a("y1", n(F.col("y"))), a("x2", n(F.col("x2"))), a("y2", n(F.col("y2"))), a("stroke", color), a("stroke-width", n(F.col("width"))), dash, F.lit("/>"))
    if not pictures:
        return F.when(F.col("kind") == "text", text).when(F.col("kind") == "rect", rect).otherwise(line)
    label = F.when(F.col("text").isNull(), "").otherwise(a("aria-label", fn.xml_attribute(F.col("text"))))
    source = F.concat(F.lit("data:"), F.col("media"), F.lit(";base64,"), F.base64("content"))
    # base64 writes lines; an attribute has none
    image = F.concat(F.lit("<image"), a("x", n(F.col("x"))), a("y", n(F.col("y"))), a("width", n(F.col("width"))), a("height", n(F.col("height"))), label, F.lit(' preserveAspectRatio="xMidYMid meet"'), a("href", F.regexp_replace(source, "[\\r\\n]", "")), F.lit("/>"))
    return F.when(F.col("kind") == "text", text).when(F.col("kind") == "rect", rect).when(F.col("kind") == "image", image).otherwise(line)


def _sheet(width: Column, height: Column, background: str | None) -> tuple[Column, Column]:
    """(the opening tag, the paper)."""
    w, h = fn.svg_number(width), fn.svg_number(height)
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), w, F.lit('" height="'), h, F.lit('" viewBox="0 0 '), w, F.lit(" "), h, F.lit('">'))
    paper = F.concat(F.lit('<rect width="'), w, F.lit('" height="'), h, F.lit('" fill="'), fn.xml_attribute(F.lit(background)), F.lit('"/>')) if background else F.lit("")
    return head, paper


def svg(operations: DataFrame, width: float, height: float, background: str | None = "#ffffff") -> DataFrame:
    """One SVG text for each page, from its operations in any order."""
    in_order = F.array_sort(F.collect_list(F.struct("layer", "ordinal", "part", "kind", element().alias("e"))))
    body = F.array_join(F.transform(in_order, lambda s: s["e"]), "")
    head, paper = _sheet(F.lit(width), F.lit(height), background)
    return operations.groupBy("doc_id", "page").agg(F.concat(head, paper, body, F.lit("</svg>")).alias("svg"))


def word_svg(operations: DataFrame, background: str | None = "#ffffff") -> DataFrame:
    """(doc, page, svg): one SVG text for each page of packages, from the operations of `word_operations`."""
    rows = operations.where("error is null")
    of_page = F.col("kind") == "page"
    in_order = F.array_sort(F.collect_list(F.when(~of_page, F.struct("z", element(pictures=True).alias("e")))))
    body = F.array_join(F.transform(in_order, lambda s: s["e"]), "")
    head, paper = _sheet(F.max(F.when(of_page, F.col("width"))), F.max(F.when(of_page, F.col("height"))), background)
    return rows.groupBy("doc", "page").agg(F.concat(head, paper, body, F.lit("</svg>")).alias("svg"))


def lines_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placed lines with the text that they show."""
    return flow.placed_lines(flow.documents(spark, sf_dir), widow=False, shown=True)


def text_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text operations of the lines of documents, with what they show."""
    rows = lines_with_text(spark, sf_dir).where("width_milli > 0")
    return several(rows, one("line", "text", ordinal=F.col("block").cast("long"), part=F.col("line"), x=F.col("x_milli") / 1000, y=F.col("y_milli") / 1000 + 16, size=F.lit(16.0), text=F.col("shown")))


def svg_text_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SVG element of every line of every document."""
    return text_ops(spark, sf_dir).select("doc_id", "page", F.col("ordinal").alias("block"), F.col("part").alias("line"), F.md5(element()).alias("element_md5"))


TEXT_SQL = flow._LINES_SQL + r"""
SELECT doc_id, page, CAST(block AS BIGINT) AS block, line,
  md5('<text x="10" y="' || CAST(26 + n % 5 * 20 AS VARCHAR) || '" font-size="16" fill="#000000" style="font-kerning:none" xml:space="preserve">' || replace(replace(replace(got, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</text>') AS element_md5
FROM (SELECT *, CAST((row_number() OVER w - 1) // 5 AS INTEGER) AS page, row_number() OVER w - 1 AS n FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY block, line)) WHERE length(rtrim(got, ' ')) > 0"""


def page_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operations of the pages of documents, from one layout: a rule above a footer with the page's number, the lines, a mark at each block's first line."""
    number = F.when(F.col("doc_id") % 2 == 1, fn.roman(F.col("page") + 1)).otherwise((F.col("page") + 1).cast("string"))
    first = F.col("on_page") == 0
    return several(
        lines_with_text(spark, sf_dir),
        F.when(first, one("footer", "text", ordinal=F.lit(1), x=F.lit(10.0), y=F.lit(119.0), size=F.lit(8.0), text=F.concat(number, F.lit(" of "), F.col("n_pages").cast("string")))),
        F.when(first, one("footer", "line", ordinal=F.lit(0), x=F.lit(10.0), y=F.lit(112.0), x2=F.lit(202.0), y2=F.lit(112.0), width=F.lit(0.5), style=F.lit("dotted"))),
        F.when(F.col("width_milli") > 0, one("line", "text", ordinal=F.col("block"), part=F.col("line"), x=F.col("x_milli") / 1000, y=F.col("y_milli") / 1000 + 16, size=F.lit(16.0), text=F.col("shown"))),
        F.when(F.col("line") == 0, one("number", "rect", ordinal=F.col("block"), x=F.lit(4.0), y=F.col("y_milli") / 1000, width=F.lit(2.0), height=F.lit(20.0), color=F.lit("#cccccc"))),
    )


#: The same operations from the lines that the SQL breaks: k is the line's place in its document.
_OPS_SQL = flow._LINES_SQL + f""", k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block, line) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM lines),
p AS (SELECT *, CAST(k // 5 AS INTEGER) AS page, k // 5 + 1 AS number, CAST(ceil(n / 5.0) AS BIGINT) AS n_pages, 10 + k % 5 * 20 AS y FROM k),
ops AS (
  SELECT doc_id, page, {LAYERS.index("footer")} AS layer, CAST(1 AS BIGINT) AS ordinal, 0 AS part, 'text' AS kind, 10.0 AS x, 119.0 AS y, CASE WHEN doc_id % 2 = 1 THEN {flow._roman_sql("number")} ELSE CAST(number AS VARCHAR) END || ' of ' || CAST(n_pages AS VARCHAR) AS t,
    '<text x="10" y="119" font-size="8" fill="#000000" style="font-kerning:none" xml:space="preserve">' AS a, '</text>' AS z FROM p WHERE k % 5 = 0
  UNION ALL SELECT doc_id, page, {LAYERS.index("footer")}, 0, 0, 'line', 10, 112, NULL, '<line x1="10" y1="112" x2="202" y2="112" stroke="#000000" stroke-width="0.5" stroke-dasharray="0.5,1"/>', '' FROM p WHERE k % 5 = 0
  UNION ALL SELECT doc_id, page, {LAYERS.index("line")}, block, line, 'text', 10, y + 16, got, '<text x="10" y="' || CAST(y + 16 AS VARCHAR) || '" font-size="16" fill="#000000" style="font-kerning:none" xml:space="preserve">', '</text>' FROM p WHERE length(rtrim(got, ' ')) > 0
  UNION ALL SELECT doc_id, page, {LAYERS.index("number")}, block, 0, 'rect', 4, y, NULL, '<rect x="4" y="' || CAST(y AS VARCHAR) || '" width="2" height="20" fill="#cccccc"/>', '' FROM p WHERE line = 0),
e AS (SELECT *, a || coalesce(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '') || z AS e, row_number() OVER (PARTITION BY doc_id, page ORDER BY layer, ordinal, part, kind) - 1 AS place FROM ops)"""
DRAW_SQL = _OPS_SQL + """
SELECT doc_id, page, CAST(place AS INTEGER) AS z, layer, kind, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, t AS text FROM e"""
SVG_SQL = _OPS_SQL + """, s AS (SELECT doc_id, page, '<svg xmlns="http://www.w3.org/2000/svg" width="212.031" height="120" viewBox="0 0 212.031 120"><rect width="212.031" height="120" fill="#ffffff"/>' || string_agg(e, '' ORDER BY place) || '</svg>' AS svg FROM e GROUP BY doc_id, page)
SELECT doc_id, page, CAST(length(svg) AS BIGINT) AS n_chars, md5(svg) AS svg_md5 FROM s"""


def draw_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations of the pages of documents, in paint order."""
    return painted(page_ops(spark, sf_dir)).select("doc_id", "page", "z", "layer", "kind", "x", "y", "text")


def svg_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and hash of each page's SVG."""
    pages = svg(page_ops(spark, sf_dir), flow.SMALL.width, flow.SMALL.height)
    return pages.select("doc_id", "page", F.char_length("svg").cast("long").alias("n_chars"), F.md5("svg").alias("svg_md5"))


def leader_count(leader: Column, exact: Column) -> Column:
    """How many glyphs fill a tab's span."""
    return F.when(leader.isin("underscore", "heavy"), F.floor(exact) + 1).when(leader.isin("hyphen", "middleDot"), F.when(exact < 1, 0).otherwise(F.floor(exact + 0.5))).otherwise(F.floor(exact))


def leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.explode(F.array(*map(F.lit, ("dot", "hyphen", "underscore", "middleDot", "heavy"))))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") / 8.0).alias("exact"), kinds.alias("leader"))
    return rows.select("p_partkey", "leader", leader_count(F.col("leader"), F.col("exact")).cast("long").alias("glyphs"))


LEADER_SQL = """SELECT p_partkey, leader, CAST(CASE WHEN leader IN ('underscore', 'heavy') THEN floor(e) + 1 WHEN leader IN ('hyphen', 'middleDot') THEN CASE WHEN e < 1 THEN 0 ELSE floor(e + 0.5) END ELSE floor(e) END AS BIGINT) AS glyphs
FROM (SELECT p_partkey, p_size / 8.0 AS e, unnest(['dot', 'hyphen', 'underscore', 'middleDot', 'heavy']) AS leader FROM part)"""

QUERIES = {
    "svg_text_ops": (svg_text_ops, TEXT_SQL),
    "draw_ops": (draw_ops, DRAW_SQL),
    "svg_pages": (svg_pages, SVG_SQL),
    "tab_leaders": (leaders, LEADER_SQL),
}
