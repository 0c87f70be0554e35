"""The flow of documents over pages as DataFrames.

A document's layout is a fold over its own blocks, so it runs where the document's row is: no shuffle, no group, each
document in one Arrow batch row. Everything after the placed lines is joins, windows and aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as fn
from leafmill.operators.lines import MONO, Paragraph, Run
from leafmill.operators.pages import Geometry, page_starts, paginate
from leafmill.plans.grouped import in_groups
from leafmill.plans.session import ship

SIZE, LINE = 16.0, 20.0
ADVANCE = MONO.advance * SIZE / MONO.em
#: A page of 20 columns and 5 lines with margins of 10.
SMALL = Geometry(20 * ADVANCE + 20, 5 * LINE + 20, 10, 10, 10, 10)


def milli(x: float) -> int:
    return math.floor(x * 1000 + 0.5)


def paragraphs(text: str, style: dict) -> list[Paragraph]:
    return [Paragraph([Run(line, SIZE)], style) for line in text.split("\n")]


LINES = "doc_id long, page int, block int, line int, start long, end long, gaps int, broken boolean, width_milli long, x_milli long, y_milli long"


def placed_lines(docs: DataFrame, key: str = "doc_id", geometry: Geometry = SMALL, style: dict | None = None, widow: bool = True, shown: bool = False) -> DataFrame:
    """Every line of every document (key, text): page, block, offsets and place, and if its text is to be shown that, its place on the page, and how many pages there are. A null text is empty."""
    ship(docs.sparkSession)
    style = {"line_height": LINE, "line_rule": "exact"} | (style or {})
    schema = f"{LINES}, shown string, on_page int, n_pages int" if shown else LINES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                blocks = paragraphs(text or "", style)
                pages = paginate(blocks, geometry, widow)
                for n, page in enumerate(pages):
                    for k, p in enumerate(page.lines):
                        x = p.line
                        row = (doc_id, n, p.block, p.index, x.start, x.end, x.gaps, x.broken, milli(x.width), milli(p.x), milli(p.y))
                        rows.append((*row, text_between(blocks[p.block].runs[0].text, x.start, x.end), k, len(pages)) if shown else row)
                if len(rows) > 50_000:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.int64(), pa.int32(), pa.bool_(), *[pa.int64()] * 3, *[pa.string(), pa.int32(), pa.int32()] * shown]
        cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])

    return spread(docs.select(F.col(key).cast("long").alias("doc_id"), "text")).mapInArrow(run, schema)


def text_between(text: str, start: int, end: int) -> str:
    """The text between two UTF-16 offsets."""
    return text[start:end] if text.isascii() or max(text) <= "\uffff" else text.encode("utf-16-le")[2 * start : 2 * end].decode("utf-16-le")


def counted(docs: DataFrame, make: Callable[[str], tuple[int, int, int]], schema: str) -> DataFrame:
    """One row of numbers for each document, from its text."""
    ship(docs.sparkSession)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [make(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names) - 1)]], names)

    return spread(docs.select("doc_id", "text")).mapInArrow(run, schema)


def spread(docs: DataFrame) -> DataFrame:
    """Documents over all cores where their files give fewer partitions than that; of large tables nothing moves."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, lines and pages of each document on the small page, without widow control."""
    style = {"line_height": LINE, "line_rule": "exact"}

    def make(text: str) -> tuple[int, int, int]:
        blocks = paragraphs(text, style)
        pages = paginate(blocks, SMALL, widow=False)
        return len(blocks), sum(len(p.lines) for p in pages), len(pages)

    return counted(documents(spark, sf_dir), make, "doc_id long, n_blocks long, n_lines long, n_pages long")


#: Lines of documents on 20 columns: each step takes the longest start of what is left that ends at a space, after a hyphen or at the end; else 20 letters.
_LINES_SQL = r"""
WITH RECURSIVE blocks AS (
  SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS block, unnest(string_split(text, chr(10))) AS t FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
), step AS (
  SELECT doc_id, block, 0 AS line, 0 AS start, t AS rest, '' AS got FROM blocks
  UNION ALL
  SELECT doc_id, block, line + 1, start + CAST(length(part) AS INTEGER), substr(rest, length(part) + 1), part FROM (
    SELECT *, CASE WHEN length(spaced) = 0 AND length(hyphened) = 0 THEN substr(rest, 1, 20) WHEN length(hyphened) > length(rtrim(spaced, ' ')) THEN hyphened ELSE spaced END AS part
    FROM (SELECT *, regexp_extract(rest, '^.{0,20}( +|$)', 0) AS spaced, regexp_extract(rest, '^.{0,19}-', 0) AS hyphened FROM step) WHERE length(rest) > 0)
), lines AS (
  SELECT doc_id, block, line - 1 AS line, start - length(got) AS start, start AS "end", got FROM step WHERE line > 0
  UNION ALL SELECT doc_id, block, 0, 0, 0, '' FROM blocks WHERE length(t) = 0
)"""
PAGES_SQL = _LINES_SQL + """
SELECT doc_id, CAST(count(DISTINCT block) AS BIGINT) AS n_blocks, count(*) AS n_lines, CAST(ceil(count(*) / 5.0) AS BIGINT) AS n_pages FROM lines GROUP BY doc_id"""


def lines_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document on the small page, without widow control."""
    got = placed_lines(documents(spark, sf_dir), widow=False)
    return got.select("doc_id", "block", "line", "page", "start", "end", "width_milli", "y_milli")


LINES_SQL = _LINES_SQL + """
SELECT doc_id, block, line, CAST((row_number() OVER w - 1) // 5 AS INTEGER) AS page, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end",
  CAST(floor(length(rtrim(got, ' ')) * 9601.5625 + 0.5) AS BIGINT) AS width_milli, CAST(10000 + (row_number() OVER w - 1) % 5 * 20000 AS BIGINT) AS y_milli
FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY block, line)"""


def starts_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each page after the first begins."""
    ship(spark)
    style = {"line_height": LINE, "line_rule": "exact"}
    schema = "doc_id long, page int, block int, text_offset long, inside_block boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, s.page, s.block, s.offset, s.inside) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for s in page_starts(paginate(paragraphs(t or "", style), SMALL, widow=False))]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [f.split()[0] for f in schema.split(", ")])

    return spread(documents(spark, sf_dir).select("doc_id", "text")).mapInArrow(run, schema)


STARTS_SQL = _LINES_SQL + """
SELECT doc_id, CAST((n - 1) // 5 AS INTEGER) AS page, block, CAST(start AS BIGINT) AS text_offset, line > 0 AS inside_block
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block, line) AS n FROM lines) WHERE n > 1 AND n % 5 = 1"""


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as paragraphs with space between them, widows kept: lines and page of each turn's first and last line.

    A conversation's turns are brought together in order; its layout is one fold.
    """
    ship(spark)
    schema = "conv_id long, turn long, first_page int, last_page int, n_lines long, y_milli long"
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())

    def make(conv_id, group: dict[str, list]) -> list[tuple]:
        style = {"line_height": LINE, "line_rule": "exact"}
        spaces = {"user": (10.0, 20.0), "system": (0.0, 12.0)}
        blocks = []
        for role, text in zip(group["role"], group["text"], strict=True):
            before, after = spaces.get(role, (20.0, 6.0))
            blocks.append(Paragraph([Run(text or "", SIZE)], style | {"before": before, "after": after, "keep_next": role == "system"}))
        found: dict[int, list] = {}
        for n, page in enumerate(paginate(blocks, SMALL)):
            for p in page.lines:
                found.setdefault(p.block, []).append((n, p.y))
        return [(conv_id, turn, found[i][0][0], found[i][-1][0], len(found[i]), milli(found[i][0][1])) for i, turn in enumerate(group["turn"])]

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return in_groups(rows, "conv_id", ["turn", "text"], make, [f.split()[0] for f in schema.split(", ")], kinds, schema)


def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers beside lines, restarting on each page and never; every second one shows; empty lines are not counted."""
    rows = placed_lines(documents(spark, sf_dir), widow=False).where(F.col("width_milli") > 0)
    in_page = Window.partitionBy("doc_id", "page").orderBy("block", "line")
    in_doc = Window.partitionBy("doc_id").orderBy("block", "line")
    rows = rows.select("doc_id", "page", "block", "line", F.row_number().over(in_page).alias("on_page"), F.row_number().over(in_doc).alias("on_document"))
    return rows.where((F.col("on_page") % 2 == 0) | (F.col("on_document") % 2 == 0))


NUMBERS_SQL = _LINES_SQL + """
SELECT * FROM (SELECT doc_id, page, block, line, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY block, line) AS INTEGER) AS on_page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block, line) AS INTEGER) AS on_document
FROM (SELECT *, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY block, line) - 1) // 5 AS INTEGER) AS page FROM lines) WHERE length(rtrim(got, ' ')) > 0) WHERE on_page % 2 = 0 OR on_document % 2 = 0"""


def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`n of total` on each page, the number in the document's style: front matter (odd ids) in lower roman."""
    pages = pages_per_document(spark, sf_dir).select("doc_id", "n_pages", F.explode(F.sequence(F.lit(1), "n_pages")).alias("page"))
    number = F.when(F.col("doc_id") % 2 == 1, fn.roman(F.col("page"))).otherwise(F.col("page").cast("string"))
    return pages.select("doc_id", F.col("page").cast("long").alias("page"), F.concat(number, F.lit(" of "), F.col("n_pages").cast("string")).alias("field"))


def _roman_sql(n: str) -> str:
    hundreds, tens, ones = (f"[{', '.join(repr(d) for d in row)}][CAST({n} // {place} % 10 + 1 AS INTEGER)]" for row, place in zip(fn._ROMAN, (100, 10, 1), strict=True))
    return f"repeat('m', CAST({n} // 1000 AS BIGINT)) || {hundreds} || {tens} || {ones}"


FIELDS_SQL = _LINES_SQL + f""", c AS (SELECT doc_id, CAST(ceil(count(*) / 5.0) AS BIGINT) AS n_pages FROM lines GROUP BY doc_id), p AS (SELECT doc_id, n_pages, unnest(generate_series(1, n_pages)) AS page FROM c)
SELECT doc_id, CAST(page AS BIGINT) AS page, CASE WHEN doc_id % 2 = 1 THEN {_roman_sql("page")} ELSE CAST(page AS VARCHAR) END || ' of ' || CAST(n_pages AS VARCHAR) AS field FROM p"""

QUERIES = {
    "pages_per_document": (pages_per_document, PAGES_SQL),
    "lines_per_document": (lines_of_documents, LINES_SQL),
    "page_starts": (starts_of_pages, STARTS_SQL),
    "conversation_pages": (conversation_pages, None),
    "line_numbers": (line_numbers, NUMBERS_SQL),
    "page_fields": (page_fields, FIELDS_SQL),
}
