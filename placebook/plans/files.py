"""Queries over files made of the tables: damaged workbooks, and lines numbered over the blocks of files."""

from __future__ import annotations

import io
import math
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import RANGE_ROWS
from ..session import scratch_dir, ship
from ..sources import grids, tables
from .surrogates import table

BOOK = 500


def _sheet(rows: list[tuple]) -> str:
    cell = '<c t="inlineStr"><is><t>{}</t></is></c>'
    return "<worksheet><sheetData>" + "".join(f'<row r="{i}">{"".join(cell.format(v) for v in r)}</row>' for i, r in enumerate(rows, 1)) + "</sheetData></worksheet>"


def workbook(rows: pd.DataFrame) -> pd.DataFrame:
    """A book's two sheets; every third book lost its directory, every third a piece of its second sheet and its directory."""
    book = int(rows["book"].iloc[0])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="odd"/><sheet name="even"/></sheets></workbook>')
        for i, rest in enumerate((1, 0), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet([tuple(r) for r in rows.loc[rows["c_custkey"] % 2 == rest, ["c_custkey", "c_name"]].itertuples(index=False)]))
        start, ends = z.infolist()[2].header_offset, z.start_dir
    data = out.getvalue()
    content = (data, data[:ends], data[: start + (ends - start) // 2])[book % 3]
    return pd.DataFrame({"path": [f"book{book}.xlsx"], "content": [content]})


def repaired_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as workbooks of BOOK rows, of which two in three are damaged, and read again: whole sheets, and an error for the rest."""
    ship(spark)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.floor(F.col("c_custkey") / BOOK).alias("book"))
    books = c.groupBy("book").applyInPandas(workbook, "path string, content binary")
    told = grids.read_grids(books)
    return told.select("doc", "sheet", F.get("cells", F.lit(0)).cast("long").alias("c_custkey"), F.get("cells", F.lit(1)).alias("c_name"), "error")


REPAIRED_SQL = f"""SELECT 'book' || c_custkey // {BOOK} || '.xlsx' AS doc, CASE WHEN c_custkey % 2 = 1 THEN 'odd' ELSE 'even' END AS sheet, c_custkey, c_name, NULL::VARCHAR AS error FROM customer WHERE c_custkey // {BOOK} % 3 < 2 OR c_custkey % 2 = 1
UNION ALL SELECT DISTINCT 'book' || c_custkey // {BOOK} || '.xlsx', 'even', NULL::BIGINT, NULL, 'the sheet is damaged' FROM customer WHERE c_custkey // {BOOK} % 3 = 2"""


def split_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as files of lines in their order, some of them blank or broken, and read by block with their numbers over all files."""
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("line"))
    line = F.when(F.col("event_id") % 17 == 3, "").when(F.col("event_id") % 19 == 4, "[1]").otherwise(F.col("line"))
    path = f"{scratch_dir(spark).rstrip('/')}/events-{uuid.uuid4().hex}"
    parts = max(1, math.ceil(e.count() / RANGE_ROWS))  # told by the file's footers
    e.repartitionByRange(parts, "event_id").sortWithinPartitions("event_id").select(line).write.text(path)
    read = tables.read_json_lines(spark, path, "event_id long, event_type string", through=True)
    return read.select("line", F.col("row.event_id").alias("event_id"), "is_object")


SPLIT_SQL = """WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS line FROM events)
SELECT line, CASE WHEN event_id % 19 <> 4 THEN event_id END AS event_id, event_id % 19 <> 4 AS is_object FROM n WHERE event_id % 17 <> 3"""

QUERIES = {f.__name__: f for f in (repaired_books, split_line_numbers)}
SQL = {"repaired_books": REPAIRED_SQL, "split_line_numbers": SPLIT_SQL}
