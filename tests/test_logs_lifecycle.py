"""Log records, fault-log lifecycle, statistics and prompt operators."""

import os

import pandas as pd
from pyspark.sql import functions as F

from fleetlake.operators import lifecycle, logs, prompts, stats

LOG_TEXT = (
    "=== Log Started at 2024-01-01 00:00:00 ===\n"
    "[2024-01-01 00:00:00.123] \n=== Application Started ===\nVersion: abc on main\nAuthor: someone\n"
    "==========================\n"
    "[2024-01-01 00:00:01.500] Processing row 1\n"
    "[2024-01-01 00:00:02.000] Error processing row 2: Invalid date format\n"
)


def test_log_file_stitching(spark, scratch):
    path = os.path.join(scratch, "application.log")
    with open(path, "w") as f:
        f.write(LOG_TEXT)
    entries = logs.read_log_files(spark, path, whole_files=True).orderBy("entry_ix", "sub").collect()
    assert len(entries) == 4
    assert entries[0]["ts"] is None and entries[0]["message"].startswith("=== Log Started")
    banner = entries[1]
    assert banner["ts"].strftime("%H:%M:%S.%f")[:-3] == "00:00:00.123"
    assert "=== Application Started ===" in banner["message"] and "Author: someone" in banner["message"]
    assert entries[3]["message"] == "Error processing row 2: Invalid date format"


def test_line_level_reader_matches_whole_file(spark, scratch):
    path = os.path.join(scratch, "big.log")
    parts = []
    for i in range(3000):
        parts.append(f"[2024-01-01 00:{i // 60 % 60:02d}:{i % 60:02d}.{i % 1000:03d}] entry {i}\n")
        if i % 7 == 0:
            parts.append(f"  continuation {i} a\n  continuation {i} b\n")
    with open(path, "w") as f:
        f.write("preamble line\n" + "".join(parts))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")     # force many splits
    try:
        lines = logs.read_log_lines(spark, path)
        assert lines.select("split_start").distinct().count() > 3
        got = sorted((str(r["ts"]), r["message"]) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = sorted((str(r["ts"]), r["message"]) for r in logs.read_log_files(spark, path, whole_files=True).collect())
    assert got == want
    assert len(got) == 3001
    assert ("None", "preamble line") in got
    assert any(m == "entry 7\n  continuation 7 a\n  continuation 7 b" for _, m in got)


def test_latest_after_and_retention(spark):
    df = spark.range(0, 2500).select(F.col("id").alias("log_id"), F.current_timestamp().alias("ts"),
                                     F.concat(F.lit("m"), F.col("id").cast("string")).alias("message"))
    latest = [r["log_id"] for r in logs.latest_logs(df).collect()]
    assert latest == list(range(2400, 2500))
    assert [r["log_id"] for r in logs.logs_after(df, -1).collect()] == latest
    assert [r["log_id"] for r in logs.logs_after(df, 2497).collect()] == [2498, 2499]
    kept = logs.log_retention(df).agg(F.min("log_id"), F.count("*")).collect()[0]
    assert tuple(kept) == (1500, 1000)


def test_next_ids_and_close(spark):
    empty = spark.createDataFrame([], "fault_id string, vehicle_id string, fault_description string, "
                                      "severity string, timestamp timestamp, status string")
    new = spark.range(0, 5).select(F.col("id").alias("k"), F.lit("V1").alias("vehicle_id"),
                                   F.lit("d").alias("fault_description"), F.lit("high").alias("severity"),
                                   F.current_timestamp().alias("timestamp"))
    ids = [r["fault_id"] for r in lifecycle.next_fault_ids(empty, new, ["k"]).orderBy("k").collect()]
    assert ids == ["F001", "F002", "F003", "F004", "F005"]
    existing = spark.createDataFrame([("F998", "V9", "x", "low", None, "open"), ("F999", "V9", "y", "low", None, "open")],
                                     empty.schema)
    ids = [r["fault_id"] for r in lifecycle.next_fault_ids(existing, new, ["k"], num_partitions=3).orderBy("k").collect()]
    assert ids == ["F1000", "F1001", "F1002", "F1003", "F1004"]
    log = lifecycle.append_faults(existing, new, ["k"])
    assert log.count() == 7 and log.where("status = 'open'").count() == 7
    req = spark.createDataFrame([("F999",), ("F999",), ("F123",)], "fault_id string")
    updated, unknown = lifecycle.close_faults(log, req)
    st = {r["fault_id"]: r["status"] for r in updated.collect()}
    assert st["F999"] == "closed" and st["F998"] == "open" and updated.count() == 7
    assert [r["error"] for r in unknown.collect()] == ["no fault has the id F123"]
    again, _ = lifecycle.close_faults(updated, req)       # idempotent
    assert sorted(map(tuple, again.select("fault_id", "status").collect())) == \
        sorted(map(tuple, updated.select("fault_id", "status").collect()))


def test_statistics(spark):
    df = spark.createDataFrame([
        ("A", "100", None, "1.50", "2.00", "REPAIR", "Engine noise", "Engine"),
        ("B", "300", "2024-01-01", None, "n/a", "REPAIR", None, "Other"),
        ("A", "x", None, None, None, None, "Engine noise", "Engine"),
    ], "location string, mileage string, completion_date string, interco_amount string, cost string, "
       "category string, nature_of_complaint string, fault_category_kw string")
    row = stats.fault_statistics(df).collect()[0]
    assert (row["total_records"], row["active_faults"], row["unique_locations"]) == (3, 2, 2)
    assert float(row["avg_mileage"]) == 200.0
    assert float(row["total_intercost"]) == 1.5 and float(row["total_custcost"]) == 2.0
    dims = {"categories": "category", "complaints_by_type": "nature_of_complaint", "fault_categories": "fault_category_kw"}
    vc = {(r["dimension"], r["value"]): r["n"] for r in stats.value_counts(df, dims).collect()}
    assert vc == {("categories", "REPAIR"): 2, ("complaints_by_type", "Engine noise"): 2,
                  ("fault_categories", "Engine"): 2, ("fault_categories", "Other"): 1}
    top = [r["value"] for r in stats.top_values(stats.value_counts(df, dims), "fault_categories").collect()]
    assert top == ["Engine", "Other"]
    empty = stats.fault_statistics(df.limit(0)).collect()[0]
    assert empty["avg_mileage"] is None and float(empty["total_custcost"]) == 0.0


def test_prompts_and_memoised_classification(spark):
    df = spark.createDataFrame([("Engine noise", "loud"), ("Engine noise", "loud"), ("Flat tyre", None),
                                (None, "x")], "nature_of_complaint string, description string")
    out = df.select(prompts.render_named("response", "quick_response", category=F.lit("Repair"),
                                         issue=F.col("description"), solution=F.lit(None))).collect()
    assert out[0][0] == "Category: Repair\nIssue: loud\nSolution: \n"
    assert df.select(prompts.render_named("response", "nope")).first()[0] == ""
    calls = spark.sparkContext.accumulator(0)

    def scorer(c: pd.Series, d: pd.Series) -> pd.Series:
        calls.add(len(c))
        return c.fillna("").str.split(" ").str[0]

    res = prompts.classify_memoised(df, scorer).collect()
    assert calls.value == 3                      # one call per distinct pair
    assert sorted((r["nature_of_complaint"] or "", r["model_category"]) for r in res) == \
        [("", "Other"), ("Engine noise", "Engine"), ("Engine noise", "Engine"), ("Flat tyre", "Other")]

    def failing(c, d):
        raise RuntimeError("scorer down")

    assert {r["model_category"] for r in prompts.classify_memoised(df, failing).collect()} == {"Other"}


def test_history_prompt_pages(spark):
    df = spark.range(0, 2500).select(F.lit("V7").alias("vehicle_id"), F.col("id").alias("row_ix"),
                                     F.lit("2024-01-01 00:00:00").alias("date"), F.lit("fix").alias("description"))
    pages = prompts.history_prompts(df).orderBy("page").collect()
    assert [p["n_entries"] for p in pages] == [1000, 1000, 500]
    assert pages[0]["prompt"].startswith("Analyze the maintenance history for vehicle V7:\n2024-01-01 00:00:00: fix\n")


def test_fault_table_round_trip(spark, scratch):
    from fleetlake.sources.sinks import records_json, write_fault_table
    df = spark.createDataFrame([("A", "WO1", None), ("B", "WO2", "x")], "vehicle_type string, work_order string, note string")
    path = os.path.join(scratch, "faults")
    write_fault_table(df, path)
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.select("vehicle_type", "work_order", "note").collect())) == \
        [("A", "WO1", None), ("B", "WO2", "x")]
    assert back.where("vehicle_type = 'A'").count() == 1
    js = sorted(r[0] for r in records_json(df).collect())
    assert js[0] == '{"vehicle_type":"A","work_order":"WO1","note":null}'


def test_table_page_and_keyset_paging(spark):
    from fleetlake.operators import query
    df = spark.range(0, 95).select(F.format_string("WO%03d", (F.col("id") * 7) % 95).alias("work_order"),
                                   F.col("id").alias("row_ix"))
    p3 = [r["work_order"] for r in query.table_page(df, page=3, size=10).collect()]
    assert p3 == [f"WO{i:03d}" for i in range(30, 40)]
    last = query.table_page(df, page=2, size=10).collect()[-1]
    nxt = [r["work_order"] for r in query.page_after(df, last["work_order"], last["row_ix"], size=10).collect()]
    assert nxt == p3
    hits = query.table_search(df, "wo09").count()
    assert hits == 5


def test_append_log_export_and_missing_columns(spark, scratch):
    from fleetlake.operators.clean import missing_columns_per_file
    from fleetlake.sources.sinks import export_table
    df = spark.createDataFrame([(1, "a"), (2, "b")], "log_id bigint, message string").withColumn(
        "ts", F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    out = os.path.join(scratch, "applog")
    logs.append_log(df, out)
    logs.append_log(df, out)
    back = spark.read.parquet(out)
    assert back.count() == 4 and [r["day"] for r in back.select("day").distinct().collect()][0].isoformat() == "2024-01-02"
    export_table(df.select("log_id", "message"), os.path.join(scratch, "csv"))
    assert spark.read.option("header", True).csv(os.path.join(scratch, "csv")).count() == 2
    headers = spark.createDataFrame([("f1", "WO No"), ("f1", "Open Date"), ("f2", "WO No")], "path string, header string")
    miss = {r["path"]: r["missing"] for r in missing_columns_per_file(headers, ["WO No", "Open Date"]).collect()}
    assert miss == {"f1": [], "f2": ["Open Date"]}


def test_complaint_included_when_asked(spark):
    from fleetlake.operators import labels
    df = spark.createDataFrame([("replace part", "Brake squeal", "x")],
                               "description string, nature_of_complaint string, _desc_raw string")
    off = labels.extract_components(df).first()["component"]
    on = labels.extract_components(df, include_complaint=True).first()["component"]
    assert off is None and on == "brake"


def test_rank_within_hot_group_spans_partitions(spark):
    from fleetlake.operators.ranking import rank_within
    # group 'hot' holds a third of the rows; ties on 'd' are broken by the unique 'k'
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
        (F.col("id") % 7).alias("d"), F.col("id").alias("k"))
    out = rank_within(df, ["g"], ["d", "k"], num_partitions=12)
    rows = out.collect()
    assert len(rows) == 3000
    by = {}
    for r in rows:
        by.setdefault(r["g"], []).append(r)
    for g, rs in by.items():
        want = {x["k"]: i + 1 for i, x in enumerate(sorted(rs, key=lambda x: (x["d"], x["k"])))}
        assert all(r["rank"] == want[r["k"]] for r in rs), g
    hot_parts = out.where("g = 'hot'").select(F.spark_partition_id()).distinct().count()
    assert hot_parts > 1
