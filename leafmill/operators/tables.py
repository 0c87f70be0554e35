"""Tables over pages, from rows of DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from leafmill.operators.flow import LINE, SIZE, SMALL, milli
from leafmill.operators.lines import Paragraph, Run
from leafmill.operators.pages import Cell, Row, Table, paginate
from leafmill.operators.relational import LINE_ORDER
from leafmill.plans.grouped import in_groups
from leafmill.plans.session import ship

ROWS = "doc_id long, row int, page int, repeated boolean, y_milli long, height_milli long"


def placed_rows(rows: DataFrame, key: str, order: list[str], cells: list[str], header: list[str]) -> DataFrame:
    """Each key's rows as one table with a header row that repeats on every page (row 0)."""
    ship(rows.sparkSession)
    style = {"line_height": LINE, "line_rule": "exact"}
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())
    width = (SMALL.width - 20) / len(cells)

    def cell(text) -> Cell:
        return Cell([Paragraph([Run(str(text), SIZE)], style)])

    def make(k, group: dict[str, list]) -> list[tuple]:
        body = [Row([cell(v) for v in r]) for r in zip(*[group[c] for c in cells], strict=True)]
        pages = paginate([Table([Row([cell(h) for h in header], header=True), *body], [width] * len(cells))], SMALL)
        return [(k, r.index, n, r.repeated, milli(r.y), milli(r.height)) for n, p in enumerate(pages) for r in p.rows]

    wanted = list(dict.fromkeys([key, *order, *cells]))
    return in_groups(rows.select(*wanted), key, order, make, [f.split()[0] for f in ROWS.split(", ")], kinds, ROWS)


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables of their lines: where each row comes, headers repeated."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *LINE_ORDER)
    return placed_rows(rows, "l_orderkey", LINE_ORDER, ["l_linenumber", "l_partkey"], ["n", "p"])


ORDER_SQL = """
WITH r AS (SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS row FROM lineitem),
p AS (SELECT doc_id, row, (row - 1) // 4 AS page, false AS repeated, 10000 + 20000 * (1 + (row - 1) % 4) AS y_milli FROM r)
SELECT doc_id, row, CAST(page AS INTEGER) AS page, repeated, CAST(y_milli AS BIGINT) AS y_milli, CAST(20000 AS BIGINT) AS height_milli FROM p
UNION ALL SELECT DISTINCT doc_id, 0, CAST(page AS INTEGER), page > 0, 10000, 20000 FROM p"""

QUERIES = {"order_tables": (order_tables, ORDER_SQL)}
