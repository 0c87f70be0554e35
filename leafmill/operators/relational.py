"""Queries on styles, lists, tables and lines that windows and joins express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry, text, units


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit function over quantities of lineitem, as millionths rounded half up."""
    q = F.col("l_quantity")
    cols = [F.floor(f(q) * 1000000 + 0.5).cast("long").alias(name) for name, f in units.UNITS.items()]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *cols)


def _unit_sql() -> str:
    point, px = "(x * 72 / 96)", "({} * 96 / 72)"
    forms = {
        "twips_to_points": "x / 20", "twips_to_px": px.format("(x / 20)"), "points_to_px": px.format("x"), "px_to_points": "x * 72 / 96",
        "half_points_to_points": "x / 2", "half_points_to_px": px.format("(x / 2)"), "eighth_points_to_points": "x / 8", "eighth_points_to_px": px.format("(x / 8)"),
        "emu_to_points": "x / 12700", "emu_to_px": px.format("(x / 12700)"), "points_to_twips": "floor(x * 20 + 0.5)", "px_to_twips": f"floor({point} * 20 + 0.5)",
        "points_to_half_points": "floor(x * 2 + 0.5)", "px_to_half_points": f"floor({point} * 2 + 0.5)", "points_to_emu": "floor(x * 12700 + 0.5)", "px_to_emu": f"floor({point} * 12700 + 0.5)",
    }
    cols = ", ".join(f"CAST(floor(({f}) * 1000000 + 0.5) AS BIGINT) AS {n}" for n, f in forms.items())
    return f"SELECT l_orderkey, l_linenumber, {cols} FROM (SELECT l_orderkey, l_linenumber, l_quantity AS x FROM lineitem)"


def round_half_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed halves: where rounding half up and half away from zero part."""
    x = (F.col("p_size") - 25) / 2
    return table(spark, sf_dir, "part").select("p_partkey", units.half_up(x).cast("long").alias("half_up"), F.round(x).cast("long").alias("away"))


ROUND_SQL = "SELECT p_partkey, CAST(floor((p_size - 25) / 2.0 + 0.5) AS BIGINT) AS half_up, CAST(round((p_size - 25) / 2.0) AS BIGINT) AS away FROM part"


def numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    styles = F.explode(F.array(*map(F.lit, ("decimal", "lowerLetter", "upperLetter", "lowerRoman", "upperRoman"))))
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37 + F.col("p_partkey") % 60 - 30).cast("long").alias("n"), styles.alias("style"))
    return rows.select("p_partkey", "n", "style", text.numeral(F.col("n"), F.col("style")).alias("shown"))


NUMERALS_SQL = """
WITH n AS (SELECT p_partkey, CAST(p_size * 37 + p_partkey % 60 - 30 AS BIGINT) AS n, unnest(['decimal', 'lowerLetter', 'upperLetter', 'lowerRoman', 'upperRoman']) AS style FROM part),
low AS (SELECT *, CASE WHEN n < 1 THEN '' ELSE repeat(chr(CAST(97 + (n - 1) % 26 AS INTEGER)), CAST((n - 1) // 26 + 1 AS BIGINT)) END AS letter,
  CASE WHEN n < 1 THEN '' ELSE repeat('m', CAST(n // 1000 AS BIGINT))
    || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][CAST(n // 100 % 10 + 1 AS INTEGER)]
    || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][CAST(n // 10 % 10 + 1 AS INTEGER)]
    || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][CAST(n % 10 + 1 AS INTEGER)] END AS rom FROM n)
SELECT p_partkey, n, style, CASE style WHEN 'lowerLetter' THEN letter WHEN 'upperLetter' THEN upper(letter) WHEN 'lowerRoman' THEN rom WHEN 'upperRoman' THEN upper(rom) ELSE CAST(n AS VARCHAR) END AS shown FROM low
"""


def alignment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a measure of 40 units with quantities as widths, in each alignment; thousandths."""
    kinds = F.explode(F.array(*map(F.lit, ("left", "center", "right", "justify"))))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("w"), kinds.alias("alignment"), (F.col("l_linenumber") % 4).alias("gaps"), (F.col("l_returnflag") == "R").alias("last"), (F.col("l_linestatus") == "O").alias("broken"))
    a, w, k = F.lit(40.0), F.col("w"), F.col("alignment")
    thousandths = lambda x: units.half_up(x * 1000).cast("long")
    return rows.select("l_orderkey", "l_linenumber", "alignment", thousandths(geometry.line_offset(a, w, k)).alias("offset"), thousandths(geometry.word_spacing(a, w, k, F.col("gaps"), F.col("last"), F.col("broken"))).alias("spacing"))


ALIGNMENT_SQL = """
SELECT l_orderkey, l_linenumber, alignment,
  CAST(floor(CASE alignment WHEN 'center' THEN greatest(0, 40.0 - l_quantity) / 2 WHEN 'right' THEN greatest(0, 40.0 - l_quantity) ELSE 0 END * 1000 + 0.5) AS BIGINT) AS "offset",
  CAST(floor(CASE WHEN alignment = 'justify' AND l_returnflag <> 'R' AND l_linestatus <> 'O' AND l_linenumber % 4 > 0 THEN greatest(0, 40.0 - l_quantity) / (l_linenumber % 4) ELSE 0 END * 1000 + 0.5) AS BIGINT) AS spacing
FROM (SELECT *, unnest(['left', 'center', 'right', 'justify']) AS alignment FROM lineitem)
"""


def baseline_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.explode(F.array(*map(F.lit, ("auto", "exact", "atLeast", "grid"))))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rules.alias("rule"), F.col("l_quantity").alias("h"))
    got = geometry.baseline(F.col("rule"), F.col("h"), F.lit(20.0), F.lit(4.0))
    return rows.select("l_orderkey", "l_linenumber", "rule", units.half_up(got * 1000).cast("long").alias("baseline"))


BASELINE_SQL = """
SELECT l_orderkey, l_linenumber, rule, CAST(floor(CASE rule WHEN 'exact' THEN 0.8 * l_quantity WHEN 'grid' THEN greatest(0, (l_quantity - 20) / 2) + 16 WHEN 'atLeast' THEN l_quantity - 4 ELSE 16 END * 1000 + 0.5) AS BIGINT) AS baseline
FROM (SELECT *, unnest(['auto', 'exact', 'atLeast', 'grid']) AS rule FROM lineitem)
"""

def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of lines by every rule: quantities as natural heights, seven times the line number as what is stated; thousandths."""
    rules = F.explode(F.array(*map(F.lit, ("auto", "exact", "atLeast", "grid"))))
    stated = F.when(F.col("l_linenumber") % 3 != 0, (F.col("l_linenumber") * 7).cast("double"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rules.alias("rule"), F.col("l_quantity").alias("natural"), stated.alias("stated"))
    h = geometry.line_height(F.col("rule"), F.col("stated"), F.col("natural"), F.lit(20.0), F.lit(12.0))
    return rows.select("l_orderkey", "l_linenumber", "rule", units.half_up(h * 1000).cast("long").alias("height"))


BOXES_SQL = """
SELECT l_orderkey, l_linenumber, rule, CAST(floor(CASE WHEN s IS NULL OR s <= 0 THEN l_quantity WHEN rule = 'exact' THEN s WHEN rule = 'atLeast' THEN greatest(s, l_quantity)
  WHEN rule = 'grid' THEN greatest(s, ceil(l_quantity / 12) * 12) ELSE greatest(0, l_quantity + s - 20) END * 1000 + 0.5) AS BIGINT) AS height
FROM (SELECT *, CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber * 7.0 END AS s, unnest(['auto', 'exact', 'atLeast', 'grid']) AS rule FROM lineitem)
"""


def tab_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a tab goes from each part's size: stops at 10 and 25, then every 8."""
    x = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", geometry.next_stop(F.array(F.lit(10.0), F.lit(25.0)), F.lit(8.0), x).cast("long").alias("stop"))


STOPS_SQL = "SELECT p_partkey, CAST(CASE WHEN p_size < 10 THEN 10 WHEN p_size < 25 THEN 25 ELSE (p_size // 8 + 1) * 8 END AS BIGINT) AS stop FROM part"


def row_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables: the highest cell, a stated height as a floor or exactly."""
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("content"))
    stated = F.when(F.col("l_orderkey") % 4 != 0, F.lit(30.0))
    return o.select("l_orderkey", geometry.row_height(F.col("content"), stated, F.col("l_orderkey") % 2 == 0).cast("long").alias("height"))


HEIGHTS_SQL = "SELECT l_orderkey, CAST(CASE WHEN l_orderkey % 4 = 0 THEN max(l_quantity) WHEN l_orderkey % 2 = 0 THEN 30 ELSE greatest(max(l_quantity), 30) END AS BIGINT) AS height FROM lineitem GROUP BY l_orderkey"

# ---- tables: an order is a table, its lines are rows


#: Lines of an order come in this order; the line number alone is not unique in it.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _in_order(key: str, order: list[str]) -> Window:
    return Window.partitionBy(key).orderBy(*order)


def meeting_rules(rows: DataFrame, key: str, order: list[str], width: str, space: str) -> DataFrame:
    """Adds, of each row's lower rule against the next row's upper one: side (whose rule draws), rule (its width), standoff and room."""
    width_of_next = F.lead(width).over(_in_order(key, order))
    rows = rows.withColumn("__next", width_of_next).withColumn("side", geometry.stronger(F.col(width), F.col("__next")))
    rows = rows.withColumn("rule", F.when(F.col("side") == "earlier", F.col(width)).otherwise(F.when(F.col("side") == "later", F.col("__next"))))
    return rows.withColumns({"standoff": geometry.standoff(F.col("rule"), F.col(space)), "room": geometry.room(F.col("rule"), F.col(space))}).drop("__next")


def border_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables whose rows state rules."""
    own = F.when(F.col("l_returnflag") != "N", F.floor(F.col("l_quantity") / 10))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER, own.alias("own"), F.when(F.col("l_linestatus") == "F", 2.0).alias("gap"))
    rows = meeting_rules(rows, "l_orderkey", LINE_ORDER, "own", "gap")
    halves = lambda x: (x * 2).cast("long")
    return rows.select("l_orderkey", "l_linenumber", "side", F.col("rule").cast("long").alias("width"), halves(F.col("standoff")).alias("standoff_halves"), halves(F.col("room")).alias("room_halves"))


BORDER_SQL = """
WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN floor(l_quantity / 10) END AS own, CASE WHEN l_linestatus = 'F' THEN 2.0 ELSE 0 END AS space, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem),
p AS (SELECT *, lead(own) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nxt FROM r),
s AS (SELECT *, CASE WHEN own IS NULL AND nxt IS NULL THEN NULL WHEN nxt IS NULL THEN 'earlier' WHEN own IS NULL THEN 'later' WHEN own > nxt THEN 'earlier' ELSE 'later' END AS side FROM p),
w AS (SELECT *, CASE side WHEN 'earlier' THEN own WHEN 'later' THEN nxt END AS width FROM s)
SELECT l_orderkey, l_linenumber, side, CAST(width AS BIGINT) AS width, CAST(CASE WHEN width IS NULL THEN 0 ELSE (space + width / 2) * 2 END AS BIGINT) AS standoff_halves, CAST(CASE WHEN width IS NULL THEN 0 ELSE (space + width) * 2 END AS BIGINT) AS room_halves FROM w
"""


def merge_spans(rows: DataFrame, key: str, order: list[str], merge: str) -> DataFrame:
    """Adds cell: cells of one column of a table, counted from 1 in each key. A continue joins the restart above it, through other continues only; every other row is a cell of its own."""
    by = Window.partitionBy(key).orderBy(*order)
    kind = F.coalesce(F.col(merge), F.lit("none"))
    opener = F.last(F.when(kind != "continue", kind), ignorenulls=True).over(by)
    return rows.withColumn("__joins", (kind == "continue") & F.coalesce(opener == "restart", F.lit(False))).withColumn("cell", F.sum((~F.col("__joins")).cast("long")).over(by)).drop("__joins")


def vertical_merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a merged cell covers."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER, F.when(F.col("l_returnflag") == "R", "restart").when(F.col("l_returnflag") == "A", "continue").alias("merge"))
    return merge_spans(rows, "l_orderkey", LINE_ORDER, "merge").groupBy("l_orderkey", "cell").agg(F.min("l_linenumber").alias("first_row"), F.count("*").alias("row_span"))


#: Each continue looks up the nearest row above it that is none; the rows of one opener are one cell.
MERGE_SQL = """
WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem),
u AS (SELECT c.l_orderkey, c.k, max(o.k) AS above FROM r c JOIN r o ON o.l_orderkey = c.l_orderkey AND o.k < c.k AND o.f <> 'A' WHERE c.f = 'A' GROUP BY 1, 2),
j AS (SELECT u.l_orderkey, u.k, u.above FROM u JOIN r ON r.l_orderkey = u.l_orderkey AND r.k = u.above WHERE r.f = 'R'),
h AS (SELECT r.l_orderkey, r.l_linenumber, r.k, coalesce(j.above, r.k) AS head FROM r LEFT JOIN j ON j.l_orderkey = r.l_orderkey AND j.k = r.k)
SELECT l_orderkey, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY head) AS BIGINT) AS cell, min(l_linenumber) AS first_row, count(*) AS row_span FROM h GROUP BY l_orderkey, head
"""


def left_edges(columns: DataFrame, key: str, order: list[str], width: str) -> DataFrame:
    """Adds left_edge: the widths of the columns before."""
    before = _in_order(key, order).rowsBetween(Window.unboundedPreceding, -1)
    return columns.withColumn("left_edge", F.coalesce(F.sum(width).over(before), F.lit(0)))


def column_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as columns of a table."""
    columns = table(spark, sf_dir, "lineitem").withColumn("width", F.col("l_quantity").cast("long"))
    return left_edges(columns, "l_orderkey", LINE_ORDER, "width").select("l_orderkey", "l_linenumber", "width", F.col("left_edge").cast("long").alias("left_edge"))


OFFSETS_SQL = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS width, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_edge FROM lineitem"


def fitted(tables: DataFrame, own: str, preferred: str, fraction: str, alignment: str, indent: str, measure: Column | float) -> DataFrame:
    """Adds width, scale and left_edge of tables: their preferred width, else that share of the measure, else the grid's own; centred, at the right, or as far in as they say."""
    room = F.lit(measure) if isinstance(measure, float) else measure
    asked = F.coalesce(room * F.col(fraction), F.col(preferred))
    width = F.when((asked > 0) & (F.col(own) > 0), asked).otherwise(F.col(own))
    left = F.when(F.col(alignment) == "center", (room - F.col("width")) / 2).when(F.col(alignment) == "right", room - F.col("width")).otherwise(F.coalesce(F.col(indent), F.lit(0.0)))
    return tables.withColumn("width", width).withColumn("scale", F.when(F.col(own) > 0, F.col("width") / F.col(own)).otherwise(1.0)).withColumn("left_edge", left)


def table_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables of their quantities' widths in a measure of 120: odd ones want 100, every fourth a third of the measure; thousandths."""
    k = F.col("l_orderkey")
    tables = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("own"))
    align = F.element_at(F.array(*map(F.lit, ("left", "center", "right"))), (k % 3 + 1).cast("int"))
    tables = tables.withColumns({"preferred": F.when(k % 2 == 1, 100.0), "fraction": F.when(k % 4 == 0, 1 / 3), "alignment": align, "indent": F.when(k % 5 == 0, 7.0)})
    thousandths = lambda c: units.half_up(F.col(c) * 1000).cast("long").alias(c)
    return fitted(tables, "own", "preferred", "fraction", "alignment", "indent", 120.0).select("l_orderkey", "alignment", *map(thousandths, ("width", "scale", "left_edge")))


FIT_SQL = """
WITH f AS (SELECT l_orderkey, sum(l_quantity) AS own, CASE l_orderkey % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'center' ELSE 'right' END AS alignment FROM lineitem GROUP BY l_orderkey),
w AS (SELECT *, CASE l_orderkey % 4 WHEN 0 THEN 40.0 WHEN 1 THEN 100.0 WHEN 3 THEN 100.0 ELSE own END AS width FROM f)
SELECT l_orderkey, alignment, CAST(floor(width * 1000 + 0.5) AS BIGINT) AS width, CAST(floor(width / own * 1000 + 0.5) AS BIGINT) AS scale,
  CAST(floor(CASE alignment WHEN 'left' THEN CASE WHEN l_orderkey % 5 = 0 THEN 7 ELSE 0 END WHEN 'right' THEN 120 - width ELSE 60 - width / 2 END * 1000 + 0.5) AS BIGINT) AS left_edge FROM w
"""


def leading(rows: DataFrame, key: str, order: list[str], is_header: Column) -> DataFrame:
    """Adds leads: whether a row and all rows of its table before it are headers; they repeat on each page."""
    return rows.withColumn("leads", F.min(is_header.cast("int")).over(_in_order(key, order)) == 1)


def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables whose rows are headers where their flag is not N."""
    rows = leading(table(spark, sf_dir, "lineitem"), "l_orderkey", LINE_ORDER, F.col("l_returnflag") != "N")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n_rows"), F.count_if("leads").alias("n_header_rows"))


HEADER_SQL = """
WITH r AS (SELECT l_orderkey, min(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS lead_flag FROM lineitem)
SELECT l_orderkey, count(*) AS n_rows, CAST(sum(lead_flag) AS BIGINT) AS n_header_rows FROM r GROUP BY l_orderkey
"""

# ---- paragraphs: a turn of a conversation is a paragraph, its role the style


def gaps(paragraphs: DataFrame, key: str, order: list[str], before: str, after: str) -> DataFrame:
    """Adds gap and added: the larger of the space after the paragraph above and the own space before, and what of it the one above has not made already."""
    above = F.coalesce(F.lag(after).over(_in_order(key, order)), F.lit(0))
    return paragraphs.withColumns({"added": F.greatest(F.col(before) - above, F.lit(0)), "gap": F.greatest(F.col(before), above)})


def paragraph_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the spaces of their roles."""
    before = F.when(F.col("role") == "user", 10).when(F.col("role") == "system", 0).otherwise(20)
    after = F.when(F.col("role") == "user", 20).when(F.col("role") == "system", 12).otherwise(6)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", before.alias("before"), after.alias("after"))
    return gaps(rows, "conv_id", ["turn"], "before", "after").select("conv_id", "turn", "added", "gap")


GAPS_SQL = """
WITH r AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 10 WHEN 'system' THEN 0 ELSE 20 END AS b, CASE role WHEN 'user' THEN 20 WHEN 'system' THEN 12 ELSE 6 END AS a FROM conversations),
p AS (SELECT *, coalesce(lag(a) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS above FROM r)
SELECT conv_id, turn, greatest(b - above, 0) AS added, greatest(b, above) AS gap FROM p
"""


def beside_same(paragraphs: DataFrame, key: str, order: list[str], style: str, before: str, after: str) -> DataFrame:
    """Space before and after fall away beside a paragraph of the same style; a null style is like no other."""
    w = _in_order(key, order)
    same = lambda other: F.coalesce(other.over(w) == F.col(style), F.lit(False))
    return paragraphs.withColumns({before: F.when(same(F.lag(style)), 0).otherwise(F.col(before)), after: F.when(same(F.lead(style)), 0).otherwise(F.col(after))})


def contextual_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose style is their role, or body."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.length("text") % 3 == 0, "body").otherwise(F.col("role")).alias("style"), F.lit(10).alias("space_before"), F.lit(10).alias("space_after"))
    return beside_same(rows, "conv_id", ["turn"], "style", "space_before", "space_after")


CONTEXTUAL_SQL = """
WITH r AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 'body' ELSE role END AS style FROM conversations)
SELECT conv_id, turn, style, CASE WHEN lag(style) OVER w = style THEN 0 ELSE 10 END AS space_before, CASE WHEN lead(style) OVER w = style THEN 0 ELSE 10 END AS space_after
FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
"""


def style_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as styles based on regions, regions on one root: each property comes from the nearest style that states it."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    style = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("based_on"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey") + 10).alias("size"), F.when(F.col("n_nationkey") % 5 == 1, F.col("n_nationkey") % 2 == 0).alias("bold"))
    style = style.unionByName(region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("root").alias("based_on"), F.when(F.col("r_regionkey") % 2 == 0, F.col("r_regionkey") + 40).alias("size"), F.lit(None).cast("boolean").alias("bold")))
    style = style.unionByName(spark.createDataFrame([("root", None, 99, False)], "id string, based_on string, size int, bold boolean"))
    return cascade(style.withColumn("doc_id", F.lit(0)), ["size", "bold"]).drop("doc_id")


def cascade(style: DataFrame, properties: list[str]) -> DataFrame:
    """Resolves the properties of styles (doc_id, id, based_on, properties...) along the chains in their document. Null means not stated.

    A missing parent or a circle ends a chain. A chain stays in its document, so a document's styles are one map that each
    of them walks: one aggregate and no join, however long the chains; a document's styles are few.
    """
    fields = F.struct(*[F.col(p) for p in properties])
    known = style.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("based_on", fields.alias("own"))))).alias("styles"), F.collect_list("id").alias("ids"))
    each = known.select("doc_id", "styles", F.explode("ids").alias("id"))
    start = F.struct(F.array(F.col("id")).alias("seen"), F.lit(False).alias("ended"))

    def step(acc: Column, _: Column) -> Column:
        parent = F.try_element_at(F.col("styles"), F.element_at(acc["seen"], -1))["based_on"]
        ends = acc["ended"] | parent.isNull() | ~F.array_contains(F.map_keys("styles"), parent) | F.array_contains(acc["seen"], parent)
        return F.when(ends, F.struct(acc["seen"].alias("seen"), F.lit(True).alias("ended"))).otherwise(F.struct(F.array_append(acc["seen"], parent).alias("seen"), F.lit(False).alias("ended")))

    chain = F.aggregate(F.map_keys("styles"), start, step)["seen"]
    each = each.select("doc_id", "id", "styles", chain.alias("chain"))
    stated = lambda p: F.array_compact(F.transform("chain", lambda c: F.try_element_at(F.col("styles"), c)["own"][p]))
    return each.select("doc_id", "id", (F.size("chain") - 1).cast("long").alias("depth"), *[F.try_element_at(stated(p), F.lit(1)).alias(p) for p in properties])


CASCADE_SQL = """
WITH RECURSIVE style AS (
  SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS based_on, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey + 10 END AS size, CASE WHEN n_nationkey % 5 = 1 THEN n_nationkey % 2 = 0 END AS bold FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'root', CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey + 40 END, NULL FROM region
  UNION ALL SELECT 'root', NULL, 99, false),
chain AS (SELECT id, id AS at, 0 AS depth FROM style UNION ALL SELECT c.id, s.based_on, c.depth + 1 FROM chain c JOIN style s ON s.id = c.at WHERE s.based_on IS NOT NULL)
SELECT c.id, count(*) - 1 AS depth, arg_min(size, CASE WHEN size IS NOT NULL THEN c.depth END) AS size, arg_min(bold, CASE WHEN bold IS NOT NULL THEN c.depth END) AS bold
FROM chain c JOIN style s ON s.id = c.at GROUP BY c.id
"""

# ---- lists


def list_counters(steps: DataFrame, key: str, order: list[str], level: str, levels: int = 3) -> DataFrame:
    """Counters of multi-level lists (levels from 0): an item counts on at its level, and every deeper level begins anew.

    Adds n0, n1, ... up to the item's own level; null beyond it.
    """
    in_order = Window.partitionBy(key).orderBy(*order)
    out = steps
    for k in range(levels):
        # each item of a shallower level begins a new count
        out = out.withColumn(f"__reset{k}", F.sum((F.col(level) < k).cast("long")).over(in_order))
        within = Window.partitionBy(key, f"__reset{k}").orderBy(*order)
        # a level that is skipped over stands at one
        count = F.greatest(F.sum((F.col(level) == k).cast("long")).over(within), F.lit(1))
        out = out.withColumn(f"n{k}", F.when(F.col(level) >= k, count))
    return out.drop(*[f"__reset{k}" for k in range(levels)])


def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lists, their lines as items of levels 0 to 2: markers like `2.b.iv`."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER, F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("level"))
    n = list_counters(items, "l_orderkey", LINE_ORDER, "level")
    marker = F.concat_ws(".", F.col("n0").cast("string"), text.letters(F.col("n1")), text.roman(F.col("n2")))
    return n.select("l_orderkey", "l_linenumber", "level", marker.alias("marker"))


MARKERS_SQL = """
WITH i AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS level, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem),
r AS (SELECT *, sum(CASE WHEN level < 1 THEN 1 ELSE 0 END) OVER w AS r1, sum(CASE WHEN level < 2 THEN 1 ELSE 0 END) OVER w AS r2 FROM i WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)),
n AS (SELECT *, greatest(sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice), 1) AS n0,
  greatest(sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, r1 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice), 1) AS n1,
  greatest(sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, r2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice), 1) AS n2 FROM r)
SELECT l_orderkey, l_linenumber, level, CAST(n0 AS VARCHAR) || CASE WHEN level >= 1 THEN '.' || chr(CAST(96 + n1 AS INTEGER)) ELSE '' END
  || CASE WHEN level >= 2 THEN '.' || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][CAST(n2 // 10 % 10 + 1 AS INTEGER)] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][CAST(n2 % 10 + 1 AS INTEGER)] ELSE '' END AS marker FROM n
"""


def numbered(references: DataFrame, key: str, order: list[str], note: str) -> DataFrame:
    """(key, note, n_references, number): notes number by their first reference."""
    first = references.groupBy(key, note).agg(F.min(F.struct(*order)).alias("__first"), F.count("*").alias("n_references"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy("__first", note))).drop("__first")


def note_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as notes, an order's lines as their references; endnotes in lower roman."""
    found = numbered(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber"], "l_partkey")
    return found.select("l_orderkey", "l_partkey", "n_references", F.col("number").cast("long").alias("footnote"), text.roman(F.col("number")).alias("endnote"))


NOTES_SQL = """
WITH f AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS first_line, count(*) AS n_references FROM lineitem GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY first_line, l_partkey) AS n FROM f)
SELECT l_orderkey, l_partkey, n_references, CAST(n AS BIGINT) AS footnote, ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][CAST(n // 10 % 10 + 1 AS INTEGER)] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][CAST(n % 10 + 1 AS INTEGER)] AS endnote FROM n
"""

# ---- text


def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as XML text and attribute: lengths and hashes of the escaped strings, and the UTF-16 length of the text."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.xml_text(t)).alias("as_text"), F.md5(text.xml_attribute(t)).alias("as_attribute"), text.utf16_length(t).alias("utf16"))


ESCAPE_SQL = """
SELECT doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS as_text,
  md5(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '"', '&quot;'), chr(9), '&#9;'), chr(10), '&#10;'), chr(13), '&#13;')) AS as_attribute,
  CAST(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS BIGINT) AS utf16 FROM documents
""".replace("\\\\", "\\")


def text_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of each document's text on one line in a face of one advance (1229 units of 2048 an em): control characters and soft hyphens have none."""
    shown = F.char_length(F.regexp_replace("text", "[\\x{00}-\\x{1F}\\x{7F}\\x{AD}\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}]", ""))
    return table(spark, sf_dir, "documents").select("doc_id", shown.cast("long").alias("n_visible"), (shown * ADVANCE).cast("long").alias("advance"))


#: Fixed value: ten letters of 16 px in the monospaced face measure 96.015625 px, so one is 1229 of 2048 em.
ADVANCE = 1229
ADVANCE_SQL = r"""
SELECT doc_id, n AS n_visible, n * 1229 AS advance FROM (SELECT doc_id, CAST(length(regexp_replace(text, '[\x{00}-\x{1F}\x{7F}\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]', '', 'g')) AS BIGINT) AS n FROM documents)
"""

#: A break opportunity stands after a run of spaces, a hyphen or a dash, and at the end of a line that the author ended.
SEGMENT = "[^ \\t\\n\\x{2D}\\x{2010}\\x{2012}-\\x{2014}]*(?:\\n|\\t|\\x{2D}|[\\x{2010}\\x{2012}-\\x{2014}]| +)|[^ \\t\\n\\x{2D}\\x{2010}\\x{2012}-\\x{2014}]+"


def break_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbreakable segments of each document: how many, the widest without its trailing spaces, and how many end in spaces."""
    parts = F.regexp_extract_all("text", F.lit(SEGMENT), F.lit(0))
    seg = table(spark, sf_dir, "documents").select("doc_id", F.explode(parts).alias("s"))
    return seg.groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.max(F.char_length(F.rtrim(F.replace("s", F.lit("\n"), F.lit(""))))).cast("long").alias("widest"), F.count_if(F.col("s").endswith(" ")).alias("n_gaps"))


SEGMENT_SQL = r"""
WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \t\n\x{2D}\x{2010}\x{2012}-\x{2014}]*(?:\n|\t|\x{2D}|[\x{2010}\x{2012}-\x{2014}]| +)|[^ \t\n\x{2D}\x{2010}\x{2012}-\x{2014}]+')) AS s FROM documents)
SELECT doc_id, count(*) AS n_segments, CAST(max(length(rtrim(replace(s, chr(10), ''), ' '))) AS BIGINT) AS widest, count(CASE WHEN s LIKE '% ' THEN 1 END) AS n_gaps FROM s GROUP BY doc_id
"""


QUERIES = {
    "unit_conversions": (unit_conversions, _unit_sql()),
    "round_half_up": (round_half_up, ROUND_SQL),
    "numerals": (numerals, NUMERALS_SQL),
    "alignment_offsets": (alignment_offsets, ALIGNMENT_SQL),
    "baseline_offsets": (baseline_offsets, BASELINE_SQL),
    "line_boxes": (line_boxes, BOXES_SQL),
    "tab_stops": (tab_stops, STOPS_SQL),
    "row_heights": (row_heights, HEIGHTS_SQL),
    "border_conflict": (border_conflict, BORDER_SQL),
    "vertical_merge_spans": (vertical_merge_spans, MERGE_SQL),
    "column_offsets": (column_offsets, OFFSETS_SQL),
    "table_fit": (table_fit, FIT_SQL),
    "header_rows": (header_rows, HEADER_SQL),
    "paragraph_gaps": (paragraph_gaps, GAPS_SQL),
    "contextual_spacing": (contextual_spacing, CONTEXTUAL_SQL),
    "style_cascade": (style_cascade, CASCADE_SQL),
    "list_markers": (list_markers, MARKERS_SQL),
    "note_numbers": (note_numbers, NOTES_SQL),
    "xml_escape": (xml_escape, ESCAPE_SQL),
    "text_advance": (text_advance, ADVANCE_SQL),
    "break_opportunities": (break_opportunities, SEGMENT_SQL),
}
