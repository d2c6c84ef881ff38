"""Sheets as units of work, limits that reach the XML reader, and odd members."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from fleetlake.operators import sheets
from fleetlake.sources import workbook
from fleetlake.sources.books import books_view
from fleetlake.sources.workbook import Limits
from xlsx_util import kardex_rows, make_xlsx

SCHEMA = "path string, content binary"


def content_of(scratch, tabs, name="x.xlsx", **how):
    with open(make_xlsx(os.path.join(scratch, name), tabs, **how), "rb") as f:
        return f.read()


def counted(monkeypatch):
    """Bytes that the XML reader has taken from members so far."""
    taken, read = [], workbook._Inflated.read

    def spy(self, n=1 << 16):
        out = read(self, n)
        taken.append(len(out))
        return out

    monkeypatch.setattr(workbook._Inflated, "read", spy)
    return taken


def test_each_sheet_is_a_task_of_its_own(spark, scratch):
    book = content_of(scratch, [(f"S{i}", [["a", i, "b"], [f"only {i}"]]) for i in range(20)])
    files = spark.createDataFrame([("p", book)], SCHEMA)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    parsed = workbook.parse_members(workbook.list_members(files), partitions=20).select("sheet_name", F.spark_partition_id().alias("task")).distinct().collect()
    assert old and len(parsed) == 20 and len({r.task for r in parsed}) == 20
    got = {(r.sheet_name, r.row_ix, r.col_ix): r.value for r in workbook.read_cells(files).where("cell_type <> 'sheet'").collect()}
    assert got == {k: v for i in range(20) for k, v in {(f"S{i}", 0, 0): "a", (f"S{i}", 0, 1): str(i), (f"S{i}", 0, 2): "b", (f"S{i}", 1, 0): f"only {i}"}.items()}


def test_limits_choose_sheets_rows_and_columns(spark, scratch):
    book = content_of(scratch, [("A", [[f"a{r}{c}" for c in range(3)] for r in range(5)]), ("B", [["b"]]), ("C", [])])
    files = spark.createDataFrame([("p", book)], SCHEMA)

    def read(**limits):
        return sorted((r.sheet_name, r.row_ix, r.col_ix) for r in workbook.read_cells(files, limits=Limits(**limits)).collect())

    assert read(sheets=(0,), rows=(1, 3), columns=frozenset({0, 2})) == [("A", -1, -1), ("A", 1, 0), ("A", 1, 2), ("A", 2, 0), ("A", 2, 2)]
    assert read(sheets=("B", 2)) == [("B", -1, -1), ("B", 0, 0), ("C", -1, -1)]
    assert read(sheets=("none",)) == [] and len(read()) == 3 + 15 + 1


def test_reading_ends_at_the_header(scratch, monkeypatch):
    taken = counted(monkeypatch)
    rows = kardex_rows([], "T") + [[f"row {i}", i] * 5 for i in range(20_000)]
    book = content_of(scratch, [("Notes", [["nothing here"]]), ("Big", rows), ("Never", rows)], inline=True)
    assert workbook.find_header(book, "WO No") == (1, "Big", 1, None)
    assert sum(taken) < 300_000
    taken.clear()
    got = workbook.parse_workbook("p", book, Limits(sheets=(1,), rows=(0, 4)))
    assert {c[3] for c in got} == {-1, 0, 1, 2, 3} and sum(taken) < 300_000
    taken.clear()
    workbook.parse_workbook("p", book, Limits(sheets=(1,)))
    assert sum(taken) > 3_000_000


def test_each_sheet_is_read_once(scratch, monkeypatch):
    book = content_of(scratch, [("A", [[f"x{i}"] for i in range(5000)])], inline=True)
    size = {i.filename: i.file_size for i in zipfile.ZipFile(io.BytesIO(book)).infolist()}
    taken = counted(monkeypatch)
    assert len(workbook.parse_workbook("p", book)) == 5001
    # the shared texts are listed and read, the sheet only read
    assert sum(taken) == size["xl/worksheets/sheet1.xml"] + 2 * size["xl/sharedStrings.xml"]


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2])
def test_members_of_any_method(scratch, method):
    plain = zipfile.ZipFile(io.BytesIO(content_of(scratch, [("A", [["k", 1]]), ("B", [["k"]])])))
    out = io.BytesIO(b"")
    with zipfile.ZipFile(out, "w") as z:
        for i in plain.infolist():
            z.writestr(i.filename, plain.read(i), method if i.filename.endswith("sheet1.xml") else zipfile.ZIP_DEFLATED)
    got = [(c[2], c[5], c[6]) for c in workbook.parse_workbook("p", out.getvalue())]
    first = [("A", "str", "k"), ("A", "num", "1")] if method != zipfile.ZIP_BZIP2 else [("A", "error", "NotImplementedError: compression method 12")]
    assert got == [("A", "sheet", None), *first, ("B", "sheet", None), ("B", "str", "k")]


def test_damaged_bytes_and_missing_texts_break_their_sheet_only(scratch):
    book = content_of(scratch, [("A", [["needle text"]]), ("B", [["k"]])], inline=True)
    at = book.index(b"needle text")
    kinds = [(c[2], c[5]) for c in workbook.parse_workbook("p", book[:at] + b"N" + book[at + 1 :])]
    assert kinds == [("A", "sheet"), ("A", "error"), ("B", "sheet"), ("B", "str")]
    shared = content_of(scratch, [("A", [["k"]])])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(shared)) as old, zipfile.ZipFile(out, "w") as z:
        for i in old.infolist():
            z.writestr(i.filename, old.read(i).replace(b"<v>0</v>", b"<v>7</v>"))
    assert [c[5:] for c in workbook.parse_workbook("p", out.getvalue())] == [("sheet", None), ("error", "IndexError: no shared string 7")]


def test_header_rows_equal_header_discovery(spark):
    files = books_view(spark, "/root/testdata/sf0.001")
    got = {r.path: (r.sheet_ix, r.sheet_name, r.header_row) for r in workbook.header_rows(files).where("header_row is not null").collect()}
    assert got == {r.path: (r.sheet_ix, r.sheet_name, r.header_row) for r in sheets.header_discovery(workbook.read_cells(files)).collect()} != {}


def test_markers_take_no_shared_text(spark, scratch):
    files = spark.createDataFrame([("p", content_of(scratch, [("A", [["first"]])]))], SCHEMA)
    assert [tuple(r) for r in workbook.read_cells(files).orderBy("row_ix").select("cell_type", "value").collect()] == [("sheet", None), ("str", "first")]
