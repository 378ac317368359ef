"""Office documents and web tables as rows of cells, with the standard library only."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from functools import partial
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.classify import canonical_department, sum_row, title_department, valid_department
from ..functions.text import contains_any
from ..session import ship
from .archives import members

#: Bytes at either end of an archive in which names of members are looked for.
ENDS = 65_536
GRID = "doc string, sheet string, row_no int, cells array<string>, error string"


def kind_of(content: Column, name: Column) -> Column:
    """The format by its first bytes, of archives by the names of their members; the file's name decides between archives that tell nothing."""
    magic = F.upper(F.hex(F.substring(content, 1, 8)))
    text = F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1"))
    # the directory at the end has all names; of a damaged archive the first headers have some
    ends = F.concat(F.decode(F.substring(content, 1, ENDS), "ISO-8859-1"), F.decode(F.substring(content, -ENDS, ENDS), "ISO-8859-1"))
    inside = F.when(magic.startswith("504B0304"), ends)
    archive = (
        F.when(inside.contains("application/hwp+zip") | inside.contains("Contents/section"), "hwpx")
        .when(inside.contains("xl/workbook") | inside.contains("xl/worksheets"), "xlsx")
        .when(F.lower(name).endswith(".hwpx"), "hwpx")
        .when(F.lower(name).endswith(".xlsx"), "xlsx")
        .otherwise("zip")
    )
    return (
        F.when(is_locked(content), "locked")
        .when(magic.startswith("504B0304"), archive)
        .when(magic.startswith("25504446"), "pdf")
        .when(magic.startswith("D0CF11E0A1B11AE1"), "ole")
        .when(text.rlike(r"<(!doctype html|html|table|\?xml[^>]*\?>\s*<workbook)"), "html")
        .otherwise("text")
    )


def is_locked(content: Column) -> Column:
    """A document that rights management has encrypted."""
    head = F.decode(F.substring(content, 1, 128), "ISO-8859-1")
    return F.coalesce(contains_any(head, fixed.LOCKED_MARKS), F.lit(False))


def is_error_page(content: Column) -> Column:
    """A web page where a file should be."""
    head = F.lower(F.trim(F.decode(F.substring(content, 1, 512), "ISO-8859-1")))
    return F.coalesce(head.startswith("<!doctype html") | contains_any(head, fixed.PAGE_MARKS), F.lit(False))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_rows(data: bytes, merged: bool = True, most_rows: int | None = None, blank_rows: int | None = None) -> Iterator[tuple[str, int, list[str] | str]]:
    """(sheet, row, cells); the value of a merged range is in each of its cells and nowhere else.

    Sheets are read whole. With ``most_rows`` or ``blank_rows`` a sheet ends there, and a
    last row says so instead of its cells; a sheet whose part is damaged, or needs texts that are, gives
    such a row, too.
    """
    held = members(data)
    shared: list[str] | None = []
    if "xl/sharedStrings.xml" in held:
        texts = held["xl/sharedStrings.xml"]
        shared = None if texts is None else ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(texts)]
    book = held.get("xl/workbook.xml")
    titles = [s.get("name") for s in ElementTree.fromstring(book).iter() if _local(s.tag) == "sheet"] if book else []
    sheets = sorted((n for n in held if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    for i, part in enumerate(sheets):
        title = titles[i] if i < len(titles) else f"sheet{i + 1}"
        if held[part] is None:
            yield title, 0, "the sheet is damaged"
            continue
        root = ElementTree.fromstring(held[part])
        grid: dict[int, dict[int, str]] = {}
        cut = None
        for row in (e for e in root.iter() if _local(e.tag) == "row"):
            r = int(row.get("r") or len(grid) + 1)
            if most_rows is not None and r > most_rows:
                cut = f"cut after row {most_rows}"
                break
            cells = {}
            for k, c in enumerate(row):
                value = next((v.text or "" for v in c.iter() if _local(v.tag) == "v"), "")
                if c.get("t") == "s" and value:
                    if shared is None:
                        cut = "the workbook's texts are damaged"
                    value = "" if shared is None else shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                cells[_column(c.get("r")) if c.get("r") else k] = value
            grid[r] = cells
        last = max(grid, default=0)
        wide = max((max(c, default=0) for c in grid.values()), default=0)
        for m in (e for e in root.iter() if merged and _local(e.tag) == "mergeCell"):
            a, _, b = m.get("ref").partition(":")
            rows = [int(re.search(r"\d+", x)[0]) for x in (a, b or a)]
            cols = [_column(x) for x in (a, b or a)]
            top = grid.get(rows[0], {}).get(cols[0], "")
            # a range may be named far beyond the sheet's last cell
            for r in range(rows[0], min(rows[1], max(last, rows[0])) + 1):
                for c in range(cols[0], min(cols[1], max(wide, cols[0])) + 1):
                    if top and not grid.setdefault(r, {}).get(c):
                        grid[r][c] = top
        before = 0
        for r in sorted(grid):
            if blank_rows is not None and r - before > blank_rows:
                cut = f"cut after {blank_rows} blank rows below row {before}"
                break
            if any(v.strip() for v in grid[r].values()):
                before = r
                yield title, r, [grid[r].get(c, "") for c in range(max(grid[r]) + 1)]
        if cut:
            yield title, before, cut


def hwpx_rows(data: bytes) -> Iterator[tuple[str, int, list[str] | str]]:
    """(table, row, cells) of the tables of all sections; the text of a cell's paragraphs in one. A damaged section gives a row that says so."""
    held, n = members(data), 0
    for part in sorted(x for x in held if re.fullmatch(r"Contents/section\d+\.xml", x)):
        if held[part] is None:
            yield part, 0, "the section is damaged"
            continue
        for table in (e for e in ElementTree.fromstring(held[part]).iter() if _local(e.tag) == "tbl"):
            n += 1
            for r, row in enumerate((e for e in table if _local(e.tag) == "tr"), 1):
                yield f"table{n}", r, [" ".join("".join(t.itertext()) for t in c.iter() if _local(t.tag) == "t").strip() for c in row if _local(c.tag) == "tc"]


class TableParser(HTMLParser):
    """Rows of cells of all tables, spreadsheet XML included."""

    ROWS, CELLS, TABLES = ("tr", "row", "ss:row"), ("td", "th", "cell", "ss:cell"), ("table", "ss:table")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.table, self.row_no, self.rows, self.row, self.cell = 0, 0, [], None, None

    def end_cell(self):
        if self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None

    def end_row(self):
        if self.row is not None:
            self.end_cell()
            self.row_no += 1
            self.rows.append((f"table{max(self.table, 1)}", self.row_no, self.row))
            self.row = None

    def handle_starttag(self, tag, attrs):
        if tag in self.TABLES:
            self.end_row()
            self.table, self.row_no = self.table + 1, 0
        elif tag in self.ROWS:
            self.end_row()
            self.row = []
        elif tag in self.CELLS and self.row is not None:
            self.end_cell()
            self.cell = []
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if tag in self.CELLS:
            self.end_cell()
        elif tag in self.ROWS or tag in self.TABLES:
            self.end_row()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_rows(text: str) -> list[tuple[str, int, list[str]]]:
    parser = TableParser()
    parser.feed(text)
    parser.close()
    parser.end_row()
    return parser.rows


def _decoded(data: bytes) -> str:
    for encoding in ("utf-8-sig", "cp949"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


READERS = {"xlsx": xlsx_rows, "hwpx": hwpx_rows, "html": lambda data: html_rows(_decoded(data))}


def read_grids(files: DataFrame, most_rows: int | None = None, blank_rows: int | None = None) -> DataFrame:
    """Rows of cells of (path, content).

    Unreadable, locked and unsupported files, pages without a table and empty ones give one
    row with an error, never none. Of a damaged archive what is whole is read, and each part
    that isn't gives a row with an error. Sheets of workbooks are read to their end, or, with
    ``most_rows`` or ``blank_rows``, to there, with a row with an error where they are cut.
    """
    read = READERS | {"xlsx": partial(xlsx_rows, most_rows=most_rows, blank_rows=blank_rows)}
    ship(files.sparkSession)
    told = files.select("path", "content", kind_of(F.col("content"), F.col("path")).alias("kind"), is_error_page(F.col("content")).alias("page"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, kind, page in batch.itertuples(index=False):
                out = []
                try:
                    if kind not in read:
                        raise ValueError(f"no reader for {kind}")
                    out = [(path, s, r, None, c) if isinstance(c, str) else (path, s, r, c, None) for s, r, c in read[kind](bytes(content))]
                    if not out:
                        raise ValueError("a web page without a table" if page else "no rows")
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    out = [(path, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(out, columns=["doc", "sheet", "row_no", "cells", "error"])

    return told.mapInPandas(rows, GRID)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    return read_grids(spark.read.format("binaryFile").load(path).select("path", "content"))


def header_rows(grid: DataFrame) -> DataFrame:
    """(doc, sheet, header_row, fields): the row among the first that looks most like a header, and its columns.

    A cell stands for the first meaning of which it contains a word, and the first such cell
    of a row counts for the meaning's worth. Only rows with a place or an address are
    headers; of equally good ones the first is taken. ``fields`` maps a meaning to its column.
    """
    near = grid.filter((F.col("row_no") <= fixed.HEADER_ROWS) & F.col("cells").isNotNull())
    cell = F.regexp_replace(F.trim("cell"), "[ \n\r]", "")
    meaning, worth = F.lit(None).cast("string"), F.lit(0)
    for name, words in reversed(fixed.HEADER_WORDS.items()):
        meaning = F.when(contains_any(cell, words), name).otherwise(meaning)
        worth = F.when(F.col("meaning") == name, fixed.HEADER_WORTH[name]).otherwise(worth)
    cells = near.select("doc", "sheet", "row_no", F.posexplode("cells").alias("column", "cell")).withColumn("meaning", meaning)
    by = cells.filter("meaning is not null").groupBy("doc", "sheet", "row_no", "meaning").agg(F.min("column").alias("column")).withColumn("worth", worth)
    rows = by.groupBy("doc", "sheet", "row_no").agg(F.sum("worth").alias("score"), F.map_from_entries(F.collect_list(F.struct("meaning", "column"))).alias("fields"))
    rows = rows.filter(F.map_contains_key("fields", "place") | F.map_contains_key("fields", "address"))
    best = rows.groupBy("doc", "sheet").agg(F.max_by(F.struct("row_no", "fields"), F.struct("score", -F.col("row_no"))).alias("b"))
    return best.select("doc", "sheet", F.col("b.row_no").alias("header_row"), "b.fields")


def _unit(c: Column) -> Column:
    """A unit's name as it is, or the first part of the text that ends like one; null if neither is valid."""
    part = F.regexp_extract(c, fixed.UNIT_NAME, 1)
    return F.when(valid_department(c), c).when(valid_department(part), part)


def sheet_departments(grid: DataFrame) -> DataFrame:
    """(doc, sheet, department_raw, department, evidence): the unit that each sheet belongs to, if it tells one.

    First the labelled cells above the table, by row and column: a label with a value in the
    same cell, or a bare label with the value in one of the three cells after it. Then the
    sheet's name: a unit in it, or itself. evidence: header or sheet.
    """
    near = grid.filter((F.col("row_no") <= fixed.HEADER_ROWS) & F.col("cells").isNotNull())
    cells = near.select("doc", "sheet", "row_no", "cells", F.posexplode("cells").alias("column", "cell"))
    text = F.trim("cell")
    bare = F.trim(F.regexp_replace(text, r"^[□○※\-*\s]+", ""))
    after = [F.nullif(F.nullif(F.trim(F.get("cells", F.col("column") + i)), F.lit("")), F.lit("-")) for i in (1, 2, 3)]
    is_label = F.regexp_replace(bare, " ?:$", "").isin(fixed.UNIT_LABELS)
    inside, beside = [], [F.when(is_label, x) for x in after]
    for label in fixed.UNIT_LABELS:
        value = F.regexp_extract(text, re.escape(label) + fixed.UNIT_AFTER_LABEL, 1)
        value = F.trim(F.regexp_replace(F.split(F.trim(value), "\n")[0], r"\s{2,}.*$", ""))
        inside.append(F.when(text.contains(label), F.nullif(value, F.lit(""))))
    told = cells.filter(contains_any(text, fixed.UNIT_LABELS)).select("doc", "sheet", "row_no", "column", F.posexplode(F.array(*inside, *beside)).alias("n", "value"))
    told = told.filter("value is not null").withColumn("unit", _unit(F.col("value"))).filter("unit is not null")
    told = told.groupBy("doc", "sheet").agg(F.min_by("unit", F.struct("row_no", "column", "n")).alias("_above"))
    named = F.trim("sheet")
    sheets = grid.filter("sheet is not null").select("doc", "sheet").distinct()
    sheets = sheets.select("doc", "sheet", title_department(named).alias("_titled"), valid_department(named).alias("_valid")).join(told, ["doc", "sheet"], "left")
    by_name = F.when(F.col("_titled").isNotNull() | F.col("_valid"), named)
    sheets = sheets.withColumns({"department_raw": F.coalesce("_above", by_name), "evidence": F.when(F.col("_above").isNotNull(), "header").when(by_name.isNotNull(), "sheet")})
    sheets = sheets.filter("department_raw is not null").withColumn("_canonical", canonical_department("department_raw"))
    department = F.coalesce(F.when(F.col("evidence") == "sheet", F.col("_titled")), "_canonical")
    return sheets.select("doc", "sheet", "department_raw", department.alias("department"), "evidence")


LEDGER_FIELDS = ["date", "place", "purpose", "amount", "address", "department"]


def ledger_rows(grid: DataFrame) -> DataFrame:
    """(doc, sheet, row_no, date, place, purpose, amount, address, department, error): the rows below each sheet's header by meaning.

    Sums and blank rows go. The unit is that of the row's own column; a row without one has
    its sheet's (see sheet_departments). A sheet without a header and a file that could not
    be read give one row with the error and nothing else.
    """
    heads = header_rows(grid)
    below = grid.join(heads, ["doc", "sheet"]).filter(F.col("row_no") > F.col("header_row"))
    at = lambda m: F.nullif(F.trim(F.get("cells", F.col("fields")[m])), F.lit(""))
    told = below.select("doc", "sheet", "row_no", *[at(m).alias(m) for m in LEDGER_FIELDS], "cells")
    told = told.filter(~sum_row(F.array_join("cells", " ")) & F.coalesce("date", "place", "purpose").isNotNull()).drop("cells")
    units = sheet_departments(grid).select("doc", "sheet", F.col("department").alias("_unit"))
    told = told.join(units, ["doc", "sheet"], "left").withColumn("department", F.coalesce("department", "_unit")).drop("_unit").withColumn("error", F.lit(None).cast("string"))
    headless = grid.filter("sheet is not null").select("doc", "sheet").distinct().join(heads, ["doc", "sheet"], "left_anti").withColumn("error", F.lit("no header row"))
    unread = grid.filter("error is not null").select("doc", "sheet", "error")
    empty = [F.lit(None).cast("int").alias("row_no"), *[F.lit(None).cast("string").alias(m) for m in LEDGER_FIELDS]]
    return told.unionByName(headless.unionByName(unread).select("doc", "sheet", *empty, "error"))
