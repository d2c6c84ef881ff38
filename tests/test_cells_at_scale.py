"""Cells are not sorted for a text that few of them have, rows are sorted natively, parts grow with the orders, books are opened once."""

import re

import pytest

from fleetlake.operators import sheets
from fleetlake.sources import views, workbook
from fleetlake.spec import KARDEX
from test_workbook_limits import content_of

CELLS = "path string, sheet_ix int, sheet_name string, row_ix long, col_ix int, cell_type string, value string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def cells(spark):
    rows = [("p", s, f"S{s}", r, c, "str" if c else "num", f" {s}-{r}-{c} ") for s in range(2) for r in range(5) for c in range(3)]
    rows += [("p", 0, "S0", 3, 0, "str", t) for t in (" bus ", "a tram", None)] + [("q", -1, None, -1, -1, "error", e) for e in ("x", "z", "y")] + [("q", 0, "E", -1, -1, "sheet", None)]
    return spark.createDataFrame(rows, CELLS)


def test_cells_are_counted_not_sorted_for_the_greatest_text(cells):
    kinds = sheets.sheet_vehicle_type(cells)
    assert sorted(map(tuple, kinds.collect())) == [("p", 0, "S0", "a tram"), ("p", 1, "S1", "Unknown")]
    found = sheets.detect_format(cells, "0-4")
    assert sorted(map(tuple, found.collect()), key=str) == [("p", "kardex", None), ("q", None, "unreadable workbook: z")]
    loads = sheets.load_status(cells, ["bus"])
    assert {r.path: r.message for r in loads.collect()} == {"p": "loaded", "q": "unreadable workbook: z"}
    for df in (kinds, found):  # what reads the cells comes last in the plan
        assert re.findall(r"(\w+Aggregate)\(", plan(df))[-1] == "HashAggregate"


def test_cells_of_a_row_are_sorted_natively(spark):
    rows = [("p", 0, "S", r, c, "str", v) for r, c, v in [(3, 0, "WO No"), (3, 1, "Loc"), (4, 1, "y"), (4, 0, "b"), (4, 0, "a"), (4, 1, None), (5, 9, "under no header"), (6, 1, "z")]]
    piv = sheets.sheet_pivot(spark.createDataFrame(rows, CELLS), KARDEX)
    assert [tuple(r) for r in piv.select("row_ix", "wo_no", "loc", "cat").orderBy("row_ix").collect()] == [(4, "a", None, None), (5, None, None, None), (6, None, "z", None)]
    assert "array_sort(" not in plan(piv)


def test_parts_grow_with_the_orders_and_are_dealt_after_the_customers(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    want = sorted(map(str, views.work_order_view(spark, sf).collect()))
    monkeypatch.setattr(views, "ORDERS_PER_TASK", 100)
    view = views.work_order_view(spark, sf)
    assert view.rdd.getNumPartitions() == 15 and sorted(map(str, view.collect())) == want
    assert re.search(r"(\w+Join) ", plan(view)).group(1) == "SortMergeJoin"  # the uppermost is that with lineitem


def test_the_tables_queries_leave_long_methods_unfused_and_others_do_not(spark):
    import __spark_entry__ as entry

    limit = lambda: spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    entry._configure(spark)
    assert limit() == "8000"
    entry._configure(spark, views=False)
    assert limit() == "65535"


def test_few_texts_go_with_their_sheets_and_many_are_joined(spark, scratch):
    book = content_of(scratch, [(f"S{i}", [["shared", i, "", "only"], [f"text {i}", "shared"]]) for i in range(3)])
    files = spark.createDataFrame([("p", book), ("q", b"no zip")], "path string, content binary")
    both = [sorted(map(str, workbook.read_cells(files, few=n).collect())) for n in (0, workbook.FEW_TEXTS)]
    assert both[0] == both[1] and len(both[0]) == 3 + 3 * 5 + 1
    kinds = lambda n: sorted(r.kind for r in workbook.list_members(files, few=n).collect())
    assert kinds(0) == ["error", "sheet", "sheet", "sheet", "strings"] and kinds(workbook.FEW_TEXTS) == ["error", "sheet", "sheet", "sheet"]
    read = workbook.read_cells(files)
    read.collect()
    final = plan(read).split("Initial Plan")[0]
    assert final.count("ReusedExchange") >= 1  # files are opened once for all who read what is dealt
