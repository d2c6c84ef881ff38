"""Streaming ingest (each file once, restart safe) and the driver contract."""

import os

from fleetlake.streaming import ingest
from xlsx_util import kardex_rows, make_xlsx

REC = [{"WO No": "WO-1", "Open Date": "2024-01-01", "Nature of Complaint": "c", "Job Description": "Fuel filter service"}]


def test_workbook_stream_processes_each_file_once(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    out, ck = os.path.join(scratch, "out"), os.path.join(scratch, "ck")
    make_xlsx(os.path.join(src, "a.xlsx"), [("Lifestyle (6yrs)", kardex_rows(REC))])
    ingest.workbook_stream(spark, src, out, ck).awaitTermination()
    assert ingest.read_output(spark, out).count() == 1
    make_xlsx(os.path.join(src, "b.xlsx"), [("10 ft (6yrs)", kardex_rows(REC * 2))])
    ingest.workbook_stream(spark, src, out, ck).awaitTermination()     # restart from the checkpoint
    good = ingest.read_output(spark, out)
    assert good.count() == 3
    assert {r["vehicle_type"] for r in good.collect()} == {"Lifestyle (6yrs)", "10 ft (6yrs)"}
    ingest.workbook_stream(spark, src, out, ck).awaitTermination()     # nothing new
    assert ingest.read_output(spark, out).count() == 3


def test_log_stream_matches_batch(spark, scratch):
    from fleetlake.operators import logs
    src = os.path.join(scratch, "logs")
    os.makedirs(src)
    with open(os.path.join(src, "a.log"), "w") as f:
        f.write("[2024-01-01 00:00:00.123] one\ncontinued\n[2024-01-01 00:00:01.000] two\n")
    out, ck = os.path.join(scratch, "lout"), os.path.join(scratch, "lck")
    ingest.log_stream(spark, src, out, ck).awaitTermination()
    streamed = sorted((r["message"]) for r in spark.read.parquet(out).collect())
    batch = sorted(r["message"] for r in logs.read_log_files(spark, src).collect())
    assert streamed == batch == ["one\ncontinued", "two"]


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"vehicle_type", "severity", "fault_category", "n", "open_n", "total_cost"}
    assert set(e.oracle_sql()) <= set(e.queries())
