"""Damaged archives, uncut sheets, and lines numbered over the blocks of a file."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from placebook.plans import files
from placebook.sources import archives, grids, tables


def packed(parts, **how):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text, **how)
    return out.getvalue()


def book(rows, more=""):
    return packed({"xl/workbook.xml": '<workbook><sheets><sheet name="s"/></sheets></workbook>', "xl/worksheets/sheet1.xml": files._sheet(rows).replace("</worksheet>", more + "</worksheet>")})


PARTS = {"a.txt": "first " * 500, "b.txt": "second " * 500, "c.txt": "", "d.txt": "fourth"}


def test_members_of_a_whole_archive():
    assert archives.members(packed(PARTS)) == {k: v.encode() for k, v in PARTS.items()}


@pytest.mark.parametrize("how", [{}, {"compress_type": zipfile.ZIP_STORED}])
def test_members_without_a_directory(how):
    data = packed(PARTS, **how)
    assert archives.members(data[: data.index(b"PK\x01\x02")]) == {k: v.encode() for k, v in PARTS.items()}
    assert archives.members(b"junk" + data[: data.index(b"PK\x01\x02") + 9])["d.txt"] == b"fourth"


def test_every_cut_gives_whole_members_or_none():
    data = packed(PARTS)
    for end in range(40, len(data), 7):
        try:
            found = archives.members(data[:end])
        except zipfile.BadZipFile:
            continue
        assert all(v is None or v == PARTS[k].encode() for k, v in found.items())
    with pytest.raises(zipfile.BadZipFile):
        archives.members(b"nothing")


def test_a_changed_byte_is_found_by_the_checksum():
    data = bytearray(packed(PARTS, compress_type=zipfile.ZIP_STORED))
    data[data.index(b"second")] ^= 1
    assert archives.members(bytes(data)) == {"a.txt": PARTS["a.txt"].encode(), "b.txt": None, "c.txt": b"", "d.txt": b"fourth"}


def test_members_with_sizes_behind_the_data():
    """As writers to a stream make them: the header's sizes are 0, a descriptor follows."""

    class Stream(io.RawIOBase):
        def __init__(self):
            self.data = b""

        def writable(self):
            return True

        def write(self, b):
            self.data += bytes(b)
            return len(b)

    out = Stream()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in PARTS.items():
            z.writestr(name, text)
    cut = out.data[: out.data.index(b"PK\x01\x02")]
    assert archives.members(cut) == {k: v.encode() for k, v in PARTS.items()}
    assert zlib.crc32(archives.members(cut[:-4])["a.txt"]) == zlib.crc32(PARTS["a.txt"].encode())


def read(spark, data, **how):
    df = spark.createDataFrame([("x.xlsx", bytearray(data))], "path string, content binary")
    return [tuple(r)[1:] for r in grids.read_grids(df, **how).collect()]


def test_sheets_are_read_to_their_end(spark):
    rows = [(f"v{i}",) if i < 3200 or i > 3260 else ("",) for i in range(3300)]
    got = read(spark, book(rows))
    assert len(got) == 3300 - 61 and got[-1] == ("s", 3300, ["v3299"], None)
    cut = read(spark, book(rows), most_rows=100)
    assert len(cut) == 101 and cut[-1] == ("s", 100, None, "cut after row 100")
    cut = read(spark, book(rows), blank_rows=20)
    assert len(cut) == 3201 and cut[-1] == ("s", 3200, None, "cut after 20 blank rows below row 3200")


def test_merged_ranges_far_beyond_the_sheet(spark):
    got = read(spark, book([("a", "b"), ("", "c")], '<mergeCells><mergeCell ref="A1:A1048576"/><mergeCell ref="B2:XFD1048576"/></mergeCells>'))
    assert got == [("s", 1, ["a", "b"], None), ("s", 2, ["a", "c"], None)]


def test_lost_texts_are_told(spark):
    data = packed({"xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>', "xl/sharedStrings.xml": "<sst><si><t>" + "text" * 99 + "</t></si></sst>"})
    at = data.index(b"xl/sharedStrings.xml") + 30
    got = read(spark, data[:at])
    assert got == [("sheet1", 1, ["", "7"], None), ("sheet1", 1, None, "the workbook's texts are damaged")]


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 40) if i % 9 else "" for i in range(5000)]
    (tmp_path / "one.txt").write_text("\n".join(lines))
    (tmp_path / "two.txt").write_text("only\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        df = tables.read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path / "one.txt")).rdd.getNumPartitions() > 4
        got = sorted((r["line"], r["value"]) for r in df.filter("source = 'one.txt'").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(enumerate(lines, 1))
    assert df.filter("source = 'two.txt'").agg(F.max("line")).first()[0] == 1


def test_lines_of_many_files_are_numbered_as_of_one(spark, monkeypatch):
    """The written files hold so many rows each, and numbers go on from one to the next."""
    monkeypatch.setattr(files, "RANGE_ROWS", 100)
    read, sources = tables.read_json_lines, []
    monkeypatch.setattr(tables, "read_json_lines", lambda s, path, *a, **k: sources.append(s.read.text(path).select(F.input_file_name()).distinct().count()) or read(s, path, *a, **k))
    out = sorted((r["line"], r["event_id"]) for r in files.split_line_numbers(spark, "/root/testdata/sf0.001").collect())
    ids = sorted(r[0] for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id").collect())
    assert sources[0] >= len(ids) // 200 > 1
    want = [(n, i if i % 19 != 4 else None) for n, i in enumerate(ids, 1) if i % 17 != 3]
    assert out == want
