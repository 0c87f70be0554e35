"""Look-ups of layout that are joins, intervals and carried values: floats, furniture, sections, cell formats, positions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators.relational import LINE_ORDER, table
from leafmill.plans.session import ship


# ---- lines beside floats


def free_interval(floats: Column, left: Column, width: Column, y: Column, height: Column) -> Column:
    """What floats (array of x, y, w, h, in order) leave of a column for a line: struct of left and width.

    Each float that the line meets leaves the wider side, the right one on a tie; one over the whole column leaves nothing.
    """
    zero = F.struct(left.cast("double").alias("left"), width.cast("double").alias("width"), F.lit(False).alias("shut"))

    def step(box: Column, f: Column) -> Column:
        meets = (y < f["y"] + f["h"]) & (y + height > f["y"]) & ~box["shut"]
        lower, upper = f["x"] - box["left"], box["left"] + box["width"] - f["x"] - f["w"]
        shut = F.struct(box["left"].alias("left"), F.lit(0.0).alias("width"), F.lit(True).alias("shut"))
        right = F.struct((f["x"] + f["w"]).alias("left"), upper.alias("width"), F.lit(False).alias("shut"))
        kept = F.struct(box["left"].alias("left"), lower.alias("width"), F.lit(False).alias("shut"))
        return F.when(~meets, box).when((lower <= 0) & (upper <= 0), shut).when(upper >= lower, right).otherwise(kept)

    return F.aggregate(floats, zero, step)


def lines_beside_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of a column 100 wide, each with two floats made from its numbers."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 100).cast("double").alias("y"), F.col("p_size").cast("double").alias("s"))
    one = F.struct((F.col("s") * 2 - 20).alias("x"), F.lit(10.0).alias("y"), F.lit(30.0).alias("w"), F.lit(40.0).alias("h"))
    two = F.struct((F.lit(90.0) - F.col("s")).alias("x"), F.lit(30.0).alias("y"), (F.col("s") + 20).alias("w"), F.lit(50.0).alias("h"))
    box = free_interval(F.array(one, two), F.lit(0.0), F.lit(100.0), F.col("y"), F.lit(12.0))
    return p.select("p_partkey", box["left"].alias("left_edge"), box["width"].alias("width"))


FLOATS_SQL = """
WITH p AS (SELECT p_partkey, CAST(p_partkey % 100 AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS s FROM part),
a AS (SELECT *, s * 2 - 20 AS x, y < 50 AND y + 12 > 10 AS meets FROM p),
b AS (SELECT *, x - 0 AS lower, 100 - x - 30 AS upper FROM a),
c AS (SELECT *, meets AND lower <= 0 AND upper <= 0 AS shut, CASE WHEN meets AND upper >= lower AND NOT (lower <= 0 AND upper <= 0) THEN x + 30 ELSE 0 END AS l,
  CASE WHEN NOT meets THEN 100 WHEN lower <= 0 AND upper <= 0 THEN 0 WHEN upper >= lower THEN upper ELSE lower END AS w FROM b),
d AS (SELECT *, NOT shut AND y < 80 AND y + 12 > 30 AS meets2, 90 - s - l AS lower2, l + w - (90 - s) - (s + 20) AS upper2 FROM c)
SELECT p_partkey, CAST(CASE WHEN meets2 AND NOT (lower2 <= 0 AND upper2 <= 0) AND upper2 >= lower2 THEN 110 ELSE l END AS DOUBLE) AS left_edge,
  CAST(CASE WHEN NOT meets2 THEN w WHEN lower2 <= 0 AND upper2 <= 0 THEN 0 WHEN upper2 >= lower2 THEN upper2 ELSE lower2 END AS DOUBLE) AS width FROM d
"""

# ---- furniture and sections: a customer's orders are sections of a document


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ref = lambda k: F.when(F.substring("o_orderpriority", 1, 1) == str(k), F.col("o_orderkey"))
    return o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("section"), ref(1).alias("d"), ref(2).alias("f"), ref(3).alias("e"), (F.col("o_orderkey") % 4 + 1).alias("n_pages"), F.when(F.col("o_orderkey") % 7 == 0, "evenPage").when(F.col("o_orderkey") % 7 == 1, "oddPage").otherwise("nextPage").alias("start"))


def inherited_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to headers carry over to the sections that state none, each variant by itself; a page without its variant takes the default."""
    w = Window.partitionBy("doc_id").orderBy("section")
    s = _sections(spark, sf_dir)
    default, first, even = (F.last(c, ignorenulls=True).over(w) for c in ("d", "f", "e"))
    s = s.select("doc_id", "section", default.alias("default_ref"), first.alias("own_first"), even.alias("own_even"))
    return s.select("doc_id", "section", "default_ref", F.coalesce("own_first", "default_ref").alias("first_ref"), F.coalesce("own_even", "default_ref").alias("even_ref"))


_SECTION_SQL = """s AS (SELECT o_custkey AS doc_id, o_orderkey AS section, CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN o_orderkey END AS d, CASE WHEN substr(o_orderpriority, 1, 1) = '2' THEN o_orderkey END AS f,
  CASE WHEN substr(o_orderpriority, 1, 1) = '3' THEN o_orderkey END AS e, o_orderkey % 4 + 1 AS n_pages, CASE o_orderkey % 7 WHEN 0 THEN 'evenPage' WHEN 1 THEN 'oddPage' ELSE 'nextPage' END AS start FROM orders)"""
FURNITURE_SQL = f"""
WITH {_SECTION_SQL},
c AS (SELECT doc_id, section, max(d) OVER w AS d, max(f) OVER w AS f, max(e) OVER w AS e FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY section))
SELECT doc_id, section, d AS default_ref, coalesce(f, d) AS first_ref, coalesce(e, d) AS even_ref FROM c
"""


def section_starts(sections: DataFrame) -> DataFrame:
    """(doc_id, section, first_page, blank) of sections (doc_id, section, start, n_pages): one that must begin on an even or odd page puts a blank page before it where it would not.

    Each page number hangs on the one before, so a document's sections stream through one task in order; none is gathered.
    """
    ship(sections.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, page = object(), 1
        for b in batches:
            firsts, blanks = [], []
            for d, start, n in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "n_pages")), strict=True):
                page, doc = page if d == doc else 1, d
                blank = (start == "evenPage" and page % 2 == 1) or (start == "oddPage" and page % 2 == 0)
                page += blank
                firsts.append(page)
                blanks.append(blank)
                page += n
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("section"), pa.array(firsts, pa.int64()), pa.array(blanks, pa.bool_())], ["doc_id", "section", "first_page", "blank"])

    rows = sections.select("doc_id", "section", "start", "n_pages").repartition("doc_id").sortWithinPartitions("doc_id", "section")
    return rows.mapInArrow(run, "doc_id long, section long, first_page long, blank boolean")


def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First physical page of each section."""
    return section_starts(_sections(spark, sf_dir))


PAGES_SQL = f"""
WITH RECURSIVE {_SECTION_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS k FROM s),
r AS (SELECT doc_id, section, k, n_pages, CASE WHEN start = 'evenPage' THEN 2 ELSE 1 END AS first_page, start = 'evenPage' AS blank FROM n WHERE k = 1
  UNION ALL SELECT n.doc_id, n.section, n.k, n.n_pages, r.first_page + r.n_pages + CASE WHEN (n.start = 'evenPage' AND (r.first_page + r.n_pages) % 2 = 1) OR (n.start = 'oddPage' AND (r.first_page + r.n_pages) % 2 = 0) THEN 1 ELSE 0 END,
    (n.start = 'evenPage' AND (r.first_page + r.n_pages) % 2 = 1) OR (n.start = 'oddPage' AND (r.first_page + r.n_pages) % 2 = 0) FROM r JOIN n ON n.doc_id = r.doc_id AND n.k = r.k + 1)
SELECT doc_id, section, CAST(first_page AS BIGINT) AS first_page, blank FROM r
"""


def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of every page: first pages of sections have their own, then even and other pages by number."""
    pages = section_pages(spark, sf_dir).join(_sections(spark, sf_dir).select("doc_id", "section", "n_pages"), ["doc_id", "section"])
    pages = pages.select("doc_id", "section", "first_page", F.explode(F.sequence(F.col("first_page"), F.col("first_page") + F.col("n_pages") - 1)).alias("page"))
    variant = F.when(F.col("page") == F.col("first_page"), F.col("first_ref")).when(F.col("page") % 2 == 0, F.col("even_ref")).otherwise(F.col("default_ref"))
    return pages.join(inherited_furniture(spark, sf_dir), ["doc_id", "section"]).select("doc_id", "section", "page", variant.alias("header"))


PAGE_FURNITURE_SQL = PAGES_SQL[: PAGES_SQL.rindex("SELECT")] + """, c AS (SELECT doc_id, section, max(d) OVER w AS d, max(f) OVER w AS f, max(e) OVER w AS e, n_pages AS n FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY section)),
g AS (SELECT r.doc_id, r.section, r.first_page, c.d, c.f, c.e, unnest(generate_series(CAST(r.first_page AS BIGINT), CAST(r.first_page + c.n - 1 AS BIGINT))) AS page FROM r JOIN c ON c.doc_id = r.doc_id AND c.section = r.section)
SELECT doc_id, section, page, CASE WHEN page = first_page THEN coalesce(f, d) WHEN page % 2 = 0 THEN coalesce(e, d) ELSE d END AS header FROM g"""

# ---- formats of cells

#: Conditional formats in the order in which later ones win.
CONDITIONS = ("band1Horz", "band2Horz", "band1Vert", "band2Vert", "firstCol", "lastCol", "lastRow", "firstRow")


def conditions(row: Column, n_rows: Column, column: Column, n_columns: Column, look: Column) -> Column:
    """The conditional formats of a cell that a table's look (bits 0x20 first row, 0x40 last row, 0x80 first column, 0x100 last column, 0x200 no row bands, 0x400 no column bands) turns on."""
    on = lambda bit: look.bitwiseAND(F.lit(bit)) != 0
    first_row, last_row, first_col, last_col = on(0x20) & (row == 0), on(0x40) & (row == n_rows - 1), on(0x80) & (column == 0), on(0x100) & (column == n_columns - 1)
    band_row = row - on(0x20).cast("int")
    band_col = column - on(0x80).cast("int")
    tests = {
        "band1Horz": ~on(0x200) & ~first_row & ~last_row & (F.pmod(band_row, F.lit(2)) == 0),
        "band2Horz": ~on(0x200) & ~first_row & ~last_row & (F.pmod(band_row, F.lit(2)) == 1),
        "band1Vert": ~on(0x400) & ~first_col & ~last_col & (F.pmod(band_col, F.lit(2)) == 0),
        "band2Vert": ~on(0x400) & ~first_col & ~last_col & (F.pmod(band_col, F.lit(2)) == 1),
        "firstCol": first_col, "lastCol": last_col, "lastRow": last_row, "firstRow": first_row,
    }
    return F.array_compact(F.array(*[F.when(tests[c], c) for c in CONDITIONS]))


def cell_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables of three columns: each cell's formats, and the one that wins."""
    by = Window.partitionBy("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.row_number().over(by.orderBy(*LINE_ORDER)) - 1).alias("row"), F.count("*").over(by).alias("n"))
    cells = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("column"))
    got = conditions(F.col("row"), F.col("n"), F.col("column"), F.lit(3), (F.col("l_orderkey") * 37 % 2048).cast("int"))
    return cells.select("l_orderkey", "row", "column", F.array_join(got, ",").alias("formats"), F.try_element_at(got, F.lit(-1)).alias("wins"))


CELLS_SQL = """
WITH r AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INTEGER) AS row, count(*) OVER (PARTITION BY l_orderkey) AS n, CAST(l_orderkey * 37 % 2048 AS INTEGER) AS look FROM lineitem),
c AS (SELECT *, unnest([0, 1, 2]) AS "column" FROM r),
b AS (SELECT *, (look & 32) <> 0 AND row = 0 AS fr, (look & 64) <> 0 AND row = n - 1 AS lr, (look & 128) <> 0 AND "column" = 0 AS fc, (look & 256) <> 0 AND "column" = 2 AS lc,
  (row + 2 - CASE WHEN (look & 32) <> 0 THEN 1 ELSE 0 END) % 2 AS br, ("column" + 2 - CASE WHEN (look & 128) <> 0 THEN 1 ELSE 0 END) % 2 AS bc FROM c),
t AS (SELECT *, (look & 512) = 0 AND NOT fr AND NOT lr AS rows_on, (look & 1024) = 0 AND NOT fc AND NOT lc AS cols_on FROM b)
SELECT l_orderkey, row, "column", concat_ws(',', CASE WHEN rows_on AND br = 0 THEN 'band1Horz' END, CASE WHEN rows_on AND br = 1 THEN 'band2Horz' END, CASE WHEN cols_on AND bc = 0 THEN 'band1Vert' END, CASE WHEN cols_on AND bc = 1 THEN 'band2Vert' END,
    CASE WHEN fc THEN 'firstCol' END, CASE WHEN lc THEN 'lastCol' END, CASE WHEN lr THEN 'lastRow' END, CASE WHEN fr THEN 'firstRow' END) AS formats,
  CASE WHEN fr THEN 'firstRow' WHEN lr THEN 'lastRow' WHEN lc THEN 'lastCol' WHEN fc THEN 'firstCol' WHEN cols_on AND bc = 1 THEN 'band2Vert' WHEN cols_on AND bc = 0 THEN 'band1Vert' WHEN rows_on AND br = 1 THEN 'band2Horz' WHEN rows_on AND br = 0 THEN 'band1Horz' END AS wins FROM t
"""


def resolved_edges(cells: DataFrame, key: str, row: str, column: str, sides: dict[str, str], outer: dict[str, Column], inside: dict[str, Column]) -> DataFrame:
    """The rules that each cell of a table draws, as widths: top (where its row opens the table), bottom, left and right.

    sides names the columns of a cell's own top, bottom, left and right rule; what a cell does not state is the table's
    outer rule at its edges and the inside one (h, v) elsewhere. Of two that meet the stronger stands, and the upper or
    left cell draws it. Rows and columns count from 0 without gaps.
    """
    below, behind = Window.partitionBy(key, column).orderBy(row), Window.partitionBy(key, row).orderBy(column)
    last = {row: F.lead(row).over(below).isNull(), column: F.lead(column).over(behind).isNull()}
    own = lambda side, edge, kind: F.coalesce(F.col(sides[side]), F.when(edge, outer[side]).otherwise(inside[kind]))
    cells = cells.withColumns({"__t": own("top", F.col(row) == 0, "h"), "__b": own("bottom", last[row], "h"), "__l": own("left", F.col(column) == 0, "v"), "__r": own("right", last[column], "v")})
    cells = cells.withColumns({"__under": F.lead("__t").over(below), "__next": F.lead("__l").over(behind)})
    drawn = {"top": F.when(F.col(row) == 0, F.col("__t")), "bottom": F.greatest("__b", "__under"), "left": F.when(F.col(column) == 0, F.col("__l")), "right": F.greatest("__r", "__next")}
    return cells.select(*[F.col(c) for c in (key, row, column)], *[v.alias(f"{k}_rule") for k, v in drawn.items()])


def cell_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables of three columns whose cells state some rules; widths of the rules that each cell draws."""
    by = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.row_number().over(by) - 1).alias("row"))
    cells = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("column"))
    states = lambda n: F.when((F.col("row") + F.col("column") * 2 + F.lit(n)) % 3 == 0, F.col("l_linenumber") + n)
    cells = cells.select("l_orderkey", "row", "column", *[states(k).alias(side) for k, side in enumerate(("top", "bottom", "left", "right"))])
    k = F.col("l_orderkey")
    outer = dict.fromkeys(("top", "bottom", "left", "right"), F.when(k % 2 == 0, 5))
    inside = {"h": F.when(k % 3 == 0, 2), "v": F.when(k % 5 == 0, 1)}
    return resolved_edges(cells, "l_orderkey", "row", "column", {side: side for side in outer}, outer, inside)


#: The same from joins: each cell with its neighbours by their places.
BORDERS_SQL = """
WITH r AS (SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INTEGER) AS row, CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS n FROM lineitem),
c AS (SELECT *, unnest([0, 1, 2]) AS "column" FROM r),
s AS (SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN 5 END AS o, CASE WHEN l_orderkey % 3 = 0 THEN 2 END AS h, CASE WHEN l_orderkey % 5 = 0 THEN 1 END AS v, (row + "column" * 2) % 3 AS m FROM c),
e AS (SELECT l_orderkey, row, "column", n, CASE WHEN m = 0 THEN l_linenumber WHEN row = 0 THEN o ELSE h END AS t, CASE WHEN m = 2 THEN l_linenumber + 1 WHEN row = n - 1 THEN o ELSE h END AS b,
  CASE WHEN m = 1 THEN l_linenumber + 2 WHEN "column" = 0 THEN o ELSE v END AS l, CASE WHEN m = 0 THEN l_linenumber + 3 WHEN "column" = 2 THEN o ELSE v END AS r FROM s)
SELECT e.l_orderkey, e.row, e."column", CASE WHEN e.row = 0 THEN e.t END AS top_rule, greatest(e.b, u.t) AS bottom_rule, CASE WHEN e."column" = 0 THEN e.l END AS left_rule, greatest(e.r, x.l) AS right_rule
FROM e LEFT JOIN e u ON u.l_orderkey = e.l_orderkey AND u."column" = e."column" AND u.row = e.row + 1 LEFT JOIN e x ON x.l_orderkey = e.l_orderkey AND x.row = e.row AND x."column" = e."column" + 1
"""

# ---- positions


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editor positions of offsets: a conversation is a block, its turns are spans that begin at 1000 times their turn; the offsets are every 97th character."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    spans = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").alias("n"))
    spans = spans.withColumn("begin", F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the offsets that fall into a span are made from the span: no range join
    first = F.ceil(F.col("begin") / 97) * 97
    last = F.col("begin") + F.col("n") - 1
    marks = spans.where((F.col("n") > 0) & (first <= last)).select("conv_id", "turn", "begin", F.explode(F.sequence(first, last, F.lit(97))).alias("text_offset"))
    return marks.select("conv_id", F.col("text_offset").cast("long").alias("text_offset"), (F.col("turn") * 1000 + F.col("text_offset") - F.col("begin")).cast("long").alias("at"))


POSITIONS_SQL = """
WITH s AS (SELECT conv_id, turn, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations),
t AS (SELECT conv_id, CAST(sum(n) AS BIGINT) AS total FROM s GROUP BY conv_id),
o AS (SELECT conv_id, unnest(generate_series(CAST(0 AS BIGINT), greatest(total - 1, -1), 97)) AS x FROM t WHERE total > 0)
SELECT o.conv_id, CAST(x AS BIGINT) AS text_offset, CAST(s.turn * 1000 + x - s.b AS BIGINT) AS at FROM o JOIN s ON s.conv_id = o.conv_id AND x >= s.b AND x < s.b + s.n
"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points of symbols given in hexadecimal: those of the private area F000 to F0FF lie 0xF000 lower."""
    n = (F.col("p_partkey") * 7 % 600 + 61300).cast("int")
    code = F.conv(F.hex(n), 16, 10).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(code.between(0xF000, 0xF0FF), code - 0xF000).otherwise(code).alias("code"))


SYMBOLS_SQL = "SELECT p_partkey, CASE WHEN n BETWEEN 61440 AND 61695 THEN n - 61440 ELSE n END AS code FROM (SELECT p_partkey, p_partkey * 7 % 600 + 61300 AS n FROM part)"

QUERIES = {
    "lines_beside_floats": (lines_beside_floats, FLOATS_SQL),
    "inherited_furniture": (inherited_furniture, FURNITURE_SQL),
    "section_pages": (section_pages, PAGES_SQL),
    "page_furniture": (page_furniture, PAGE_FURNITURE_SQL),
    "cell_conditions": (cell_conditions, CELLS_SQL),
    "cell_borders": (cell_borders, BORDERS_SQL),
    "positions": (positions, POSITIONS_SQL),
    "symbols": (symbols, SYMBOLS_SQL),
}
