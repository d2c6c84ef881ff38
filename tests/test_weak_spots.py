"""Limits before the pivot, one-pass stacking, sums that overflow, records."""

from pyspark.sql import functions as F

from fleetlake.operators import sheets, stats
from fleetlake.sources.sinks import records_json

CELLS = "path string, sheet_ix int, sheet_name string, row_ix long, col_ix int, cell_type string, value string"


def cells(spark, n):
    rows = [("p", s, f"S{s}", r, c, "str", "WO No" if r == 0 and c == 0 else "Loc" if r == 0 else f"{s}-{r}-{c}") for s in range(3) for r in [0, *range(3, 3 + 2 * n, 2)] for c in range(2) if (r, c) != (3, 0)]
    return spark.createDataFrame(rows, CELLS)


def test_first_rows_are_picked_before_the_pivot(spark):
    piv = sheets.sheet_pivot(cells(spark, 50), header_row=0)
    first = sheets.sheet_pivot(cells(spark, 50), header_row=0, first_rows=4)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, piv.where("row_ix <= 9").collect())) and first.count() == 12
    dropped = sheets.sheet_pivot(cells(spark, 50), header_row=0, first_rows=4, drop_first_record=True)
    assert {r.row_ix for r in dropped.collect()} == {5, 7, 9, 11}
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("collect_list") < plan.index("WindowGroupLimit")


def test_one_sheet_by_position(spark):
    assert {r.sheet_name for r in sheets.sheet_pivot(cells(spark, 2), header_row=0, sheet_ix=1).collect()} == {"S1"}


def test_stacking_in_one_pass_equals_a_union(spark):
    piv = sheets.sheet_pivot(cells(spark, 3), header_row=0).select("path", "sheet_ix", "sheet_name", "row_ix", "wo_no", "loc")
    some = [piv.where("sheet_name = 'S0'").drop("sheet_ix"), piv.where("sheet_name = 'S2'").select("path", "sheet_name", "row_ix", "wo_no")]
    got = sheets.stack_layouts(piv, {"S0": None, "S2": ["wo_no"]})
    assert sorted(map(str, got.collect())) == sorted(map(str, sheets.stack_sheets(some).collect())) and got.count() == 6
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0


def test_sums_that_overflow_are_null(spark):
    rows = spark.createDataFrame([(None, "x", "1", "9" * 36, None, "high")] * 2, "completion_date string, location string, mileage string, interco_amount string, cost string, severity string")
    got = stats.fault_record(rows, "kind").first()
    assert (got.data_type, got.total_records, got.total_intercost, got.total_custcost, got.high_severity_faults) == ("kind", 2, None, 0, 2)


def test_records_beside_kept_columns(spark):
    df = spark.createDataFrame([(1, None, "x")], "a int, b string, c string")
    assert [tuple(r) for r in records_json(df, ["b", "c"], keep=["a"]).collect()] == [(1, '{"b":null,"c":"x"}')]
    assert records_json(df.select(F.col("a"))).first()[0] == '{"a":1}'
