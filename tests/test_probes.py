"""Inputs that the driver tables lack: odd workbooks, logs, dates, numbers, scorers."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from fleetlake import session
from fleetlake.functions.dates import parse_datetime
from fleetlake.operators import clean, logs, prompts, quality, query, sheets, stats
from fleetlake.sources import workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
OFF = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = "http://schemas.openxmlformats.org/package/2006/relationships"


def book(*sheet_xml):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{OFF}"><sheets>' + "".join(
            f'<sheet name="S{i}" sheetId="{i + 1}" r:id="r{i}"/>' for i in range(len(sheet_xml))) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PKG}">' + "".join(
            f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheet_xml))) + "</Relationships>")
        for i, xml in enumerate(sheet_xml):
            z.writestr(f"xl/worksheets/s{i}.xml", xml)
    return out.getvalue()


def text(value, at=""):
    return f'<c {at} t="inlineStr"><is><t>{value}</t></is></c>'


def cells_of(content, path="b.xlsx"):
    return workbook.parse_workbook(path, content)


def test_cells_without_a_place_follow_the_one_before():
    rows = "".join(f"<row>{text(f'a{i}')}{text(f'b{i}')}</row>" for i in range(3))
    got = cells_of(book(f'<worksheet {NS}><sheetData>{rows}<row r="9">{text("x", "r='C9'")}{text("y")}</row></sheetData></worksheet>'))
    assert [c[3:5] + c[6:] for c in got[1:]] == [
        (0, 0, "a0"), (0, 1, "b0"), (1, 0, "a1"), (1, 1, "b1"), (2, 0, "a2"), (2, 1, "b2"), (8, 2, "x"), (8, 3, "y")]


def test_half_read_sheet_gives_no_cells_and_others_go_on():
    good = f"<worksheet {NS}><sheetData><row>{text('k')}</row></sheetData></worksheet>"
    got = cells_of(book(f"<worksheet {NS}><sheetData><row>{text('lost')}</row>", good))
    assert [(c[1], c[5]) for c in got] == [(0, "sheet"), (0, "error"), (1, "sheet"), (1, "str")]


def test_unreadable_books_are_counted_and_never_previewed(spark, scratch):
    good = f"<worksheet {NS}><sheetData><row>{text('k')}</row></sheetData></worksheet>"
    for name, content in (("ok.XLSX", book(good)), ("bad.xlsx", b"no zip"), ("note.txt", b"skipped")):
        with open(os.path.join(scratch, name), "wb") as f:
            f.write(content)
    cells = workbook.read_workbooks(spark, scratch).withColumn("path", F.substring_index("path", "/", -1))
    assert {(r["path"], r["status"]) for r in sheets.sheet_counts(cells, 0).collect()} == {("ok.XLSX", "ok"), ("bad.xlsx", "error")}
    got = {r["path"]: (r["total_sheets"], r["total_rows"]) for r in sheets.ingest_summary(sheets.sheet_counts(cells, 0)).collect()}
    assert got == {"ok.XLSX": (1, 1), "bad.xlsx": (0, 0)}
    assert [(r["path"], r["value"]) for r in sheets.raw_preview(cells).collect()] == [("ok.XLSX", "k")]
    old = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "10")
    try:
        kinds = sorted(r["cell_type"] for r in workbook.read_workbooks(spark, scratch).collect())
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", old)
    assert kinds == ["error", "error"]      # the long book by its length, the short one by its content


def test_two_cells_at_one_place(spark):
    rows = [("p", 0, "s", 0, 0, "str", "WO No"), ("p", 0, "s", 1, 0, "str", "b"), ("p", 0, "s", 1, 0, "str", "a")]
    cells = spark.createDataFrame(rows, "path string, sheet_ix int, sheet_name string, row_ix long, col_ix int, cell_type string, value string")
    assert [r["wo_no"] for r in sheets.sheet_pivot(cells, header_row=0).collect()] == ["a"]


def test_files_without_a_header_lack_all_columns(spark):
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    heads = spark.createDataFrame([("a", "X")], "path string, header string")
    got = {r["path"]: r["missing"] for r in clean.missing_columns_per_file(heads, ["X", "Y"], files).collect()}
    assert got == {"a": ["Y"], "b": ["X", "Y"]}


def test_empty_log_messages_are_entries(spark, scratch):
    path = os.path.join(scratch, "a.log")
    with open(path, "w") as f:
        f.write("\nhead\n[2024-01-01 00:00:00.000] \n[2024-01-01 00:00:01.000] x\n\n[2024-01-01 00:00:02.000] y\n")
    open(os.path.join(scratch, "empty.log"), "w").close()
    want = ["", "", "head", "x\n", "y"]
    assert sorted(r["message"] for r in logs.read_log_files(spark, scratch).collect()) == want
    assert sorted(r["message"] for r in logs.read_log_files(spark, scratch, whole_files=True).collect()) == want


@pytest.mark.parametrize("given, want", [
    ("45291", None), ("123456", None), ("10:30", None), ("notadate", None), ("", None), (None, None),
    ("2024-02-30", None), ("2024-01-02", "2024-01-02 00:00:00"), (" 2024-01-02T03:04:05.5 ", "2024-01-02 03:04:05"),
    ("01/02/2024 5:06", "2024-01-02 05:06:00"), ("13/02/2024", "2024-02-13 00:00:00"),
    ("20240102", "2024-01-02 00:00:00"), ("Jan 5, 2024", "2024-01-05 00:00:00")])
def test_dates(spark, given, want):
    df = spark.createDataFrame([(given,)], "d string")
    assert df.select(F.date_format(parse_datetime("d"), "yyyy-MM-dd HH:mm:ss")).first()[0] == want


def test_numbers_and_validity(spark):
    df = spark.createDataFrame([(v,) for v in ("100d", "1.5f", "0x1p3", " 1e3 ", ".5", "-2.", "", "inf")], "c string")
    assert [r[0] for r in df.select(clean.float_value(F.col("c"))).collect()] == [None, None, None, 1000.0, 0.5, -2.0, None, float("inf")]
    row = spark.createDataFrame([("1", "notadate", "d", None, None)], "work_order string, date string, description string, cost string, mileage string")
    assert quality.row_validity(row).first()["errors"] == "invalid_date"


def test_pages_pass_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4), ("b", 5)], "k string, row_ix long")
    seen, last = [], (None, -1)
    while page := query.page_after(df, *last, size=2).collect():
        seen += [r["row_ix"] for r in page]
        last = tuple(page[-1])
    assert seen == [1, 2, 3, 4, 5]


def test_large_amounts(spark):
    df = spark.createDataFrame([("99999999999999999999.25",)] * 3, "cost string").selectExpr(
        "cost", "null completion_date", "'x' location", "'1' mileage", "'0' interco_amount")
    assert str(stats.fault_statistics(df).first()["total_custcost"]) == "299999999999999999997.75"


@pytest.mark.parametrize("batch", ["1", "10000"])
def test_only_the_failing_pair_is_other(spark, batch):
    def scorer(c, d):
        if (c == "bad").any():
            raise RuntimeError("no answer")
        return c

    df = spark.createDataFrame([("Engine", "x"), ("bad", "x"), ("Body", None), (None, None)], "nature_of_complaint string, description string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r["nature_of_complaint"]: (r["label"], r["label_error"]) for r in prompts.classify_memoised(
            df.coalesce(1), scorer, allowed=("Engine", "Body"), out="label").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == {"Engine": ("Engine", None), "Body": ("Body", None), None: ("Other", None), "bad": ("Other", "RuntimeError: no answer")}


def test_no_folder_of_one_machine_on_a_cluster():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
