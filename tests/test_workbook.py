"""The .xlsx source and the cell-table operators on real files built here."""

import datetime as dt
import os

from pyspark.sql import functions as F

from fleetlake.operators import sheets
from fleetlake.plans import kardex as K
from fleetlake.sources.workbook import list_files, read_workbooks
from fleetlake.spec import FAULT_TABLE_REQUIRED, KARDEX
from xlsx_util import kardex_rows, make_xlsx

REC = [
    {"WO No": "WO-1", "Open Date": dt.datetime(2023, 1, 1, 10, 30), "Nature of Complaint": "Engine noise",
     "Job Description": "Urgent brake failure", "Mileage": 50000, "Cat": "REPAIR", "Custamt": 12.5},
    {"WO No": 456, "Open Date": "2023-01-02", "Nature of Complaint": "Test",
     "Job Description": "  Fuel filter   service ", "Mileage": 123.5},
    {"WO No": "789", "Open Date": "invalid_date", "Nature of Complaint": "x", "Job Description": "y"},
]


def build(folder):
    make_xlsx(os.path.join(folder, "a.xlsx"), [("Lifestyle (6yrs)", kardex_rows(REC, "Vehicle A")),
                                                ("Empty", []),
                                                ("Notes", [["just notes"]])])
    make_xlsx(os.path.join(folder, "b.XLSX"), [("10 ft (6yrs)", kardex_rows(REC[:1], "Vehicle B"))], inline=True)
    with open(os.path.join(folder, "c.xlsx"), "wb") as f:
        f.write(b"not a zip file")
    with open(os.path.join(folder, "d.pdf"), "wb") as f:
        f.write(b"%PDF-1.4")
    with open(os.path.join(folder, "e.txt"), "w") as f:
        f.write("plain text")


def test_cells_and_operators(spark, scratch):
    build(scratch)
    files = {os.path.basename(r["path"]): r["admitted"] for r in list_files(spark, scratch).collect()}
    assert files == {"a.xlsx": True, "b.XLSX": True, "c.xlsx": True, "d.pdf": True, "e.txt": False}

    cells = read_workbooks(spark, scratch).cache()
    paths = {os.path.basename(r[0]) for r in cells.select("path").distinct().collect()}
    assert paths == {"a.xlsx", "b.XLSX", "c.xlsx"}
    err = cells.where(F.col("cell_type") == "error").collect()
    assert len(err) == 1 and err[0]["path"].endswith("c.xlsx")

    a = cells.where(F.col("path").endswith("a.xlsx"))
    d = {(r["row_ix"], r["col_ix"]): (r["cell_type"], r["value"]) for r in a.where("sheet_ix = 0").collect()}
    assert d[(4, 4)] == ("date", "2023-01-01 10:30:00")
    assert d[(5, 0)] == ("num", "456")
    assert d[(5, 3)] == ("num", "123.5")
    assert d[(0, 0)] == ("str", "Vehicle A")

    det = {os.path.basename(r["path"]): (r["format"], r["reason"]) for r in sheets.detect_format(cells).collect()}
    assert det["a.xlsx"][0] == "kardex" and det["b.XLSX"][0] == "kardex"
    assert det["c.xlsx"][0] is None and det["c.xlsx"][1].startswith("unreadable workbook")

    hd = {os.path.basename(r["path"]): (r["sheet_ix"], r["header_row"]) for r in sheets.header_discovery(cells).collect()}
    assert hd["a.xlsx"] == (0, 1)   # first row containing 'WO No'

    counts = {(os.path.basename(r["path"]), r["sheet_name"]): (r["n"], r["status"])
              for r in sheets.sheet_counts(cells).collect()}
    assert counts[("a.xlsx", "Empty")] == (0, "empty")
    assert counts[("a.xlsx", "Notes")] == (None, "no_body")
    assert counts[("a.xlsx", "Lifestyle (6yrs)")] == (2, "ok")     # rows 5 and 6 (first record lost, C14)
    shares = sheets.sheet_share(sheets.sheet_counts(cells)).where(F.col("path").endswith("a.xlsx")).collect()
    assert abs(sum(float(r["share_pct"]) for r in shares) - 100.0) < 1e-6

    status = {os.path.basename(r["path"]): (r["success"], r["message"])
              for r in sheets.load_status(cells, FAULT_TABLE_REQUIRED, header_row=3).collect()}
    assert status["a.xlsx"] == (True, "loaded")
    assert status["c.xlsx"][0] is False and status["c.xlsx"][1].startswith("unreadable workbook")

    rows = sheets.sheet_pivot(cells, KARDEX)
    good, rejected = K.quarantine(rows, KARDEX, keep=("path", "sheet_name", "row_ix"))
    assert good.count() == 3            # two from a.xlsx, one from b.XLSX
    g = {r["work_order"]: r for r in good.where(F.col("path").endswith("a.xlsx")).collect()}
    assert set(g) == {"WO1", "456"}
    assert g["WO1"]["date"] == "2023-01-01 10:30:00" and g["WO1"]["severity"] == "high"
    assert g["456"]["description"] == "Fuel filter service" and g["456"]["fault_category"] == "Maintenance"
    assert g["WO1"]["vehicle_type"] == "Lifestyle (6yrs)"
    assert [r["reason"] for r in rejected.collect()] == ["invalid_date"]


def test_pivot_drop_first_record_variant(spark, scratch):
    make_xlsx(os.path.join(scratch, "k.xlsx"), [("S", kardex_rows(REC, "T"))])
    cells = read_workbooks(spark, scratch)
    assert sheets.sheet_pivot(cells, KARDEX).count() == 3
    assert sheets.sheet_pivot(cells, KARDEX, drop_first_record=True).count() == 2
