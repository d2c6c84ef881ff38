"""The stored fault log and statistics that merge."""

import os

import pytest
from pyspark.sql import functions as F

from fleetlake.operators import fault_log, stat_states, stats
from fleetlake.streaming.published import batch_path, facts_of, published

NEW = "vehicle_id string, fault_description string, severity string, timestamp timestamp, n int"


def faults(spark, first, last):
    return spark.range(first, last).selectExpr(
        "concat('V', id % 5) AS vehicle_id", "concat('fault ', id) AS fault_description", "if(id % 2 = 0, 'high', null) AS severity", "timestamp'2024-01-01' AS timestamp", "cast(id as int) AS n")


def asked(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "fault_id string")


def now(spark, folder):
    return {r.fault_id: (r.fault_description, r.status) for r in fault_log.read(spark, folder).collect()}


def test_batches_write_only_themselves_and_reads_merge(spark, scratch):
    assert fault_log.read(spark, scratch).count() == 0
    assert fault_log.append(faults(spark, 0, 998), scratch, ["n"]) == 0
    before = {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(scratch) for f in fs}
    fault_log.append(faults(spark, 998, 1003), scratch, ["n"])
    unknown = fault_log.close(asked(spark, "F002", "F002", "F1000", "F1004", "F2", "x", "F", None, "F000", "F-01"), scratch)
    assert {r.fault_id: r.error for r in unknown.collect()} == {i: f"no fault has the id {i}" for i in ("F1004", "F2", "x", "F", "F000", "F-01")}
    assert all(os.path.getmtime(p) == t for p, t in before.items())
    got = now(spark, scratch)
    assert got == {f"F{i + 1:03d}": (f"fault {i}", "closed" if i in (1, 999) else "open") for i in range(1003)}
    assert spark.read.parquet(batch_path(scratch, "closed", 2)).count() == 2
    # closing again, an empty batch and a compaction change nothing that is read
    fault_log.close(asked(spark, "F002"), scratch)
    fault_log.append(faults(spark, 0, 0), scratch, ["n"])
    base = fault_log.compact(spark, scratch)
    assert now(spark, scratch) == got and facts_of(spark, scratch, base) == {"batch": base, "parts": ["base"], "high": 1003, "base": base}
    fault_log.close(asked(spark, "F003"), scratch)
    fault_log.append(faults(spark, 5000, 5001).withColumn("status", F.lit("waiting")), scratch, ["n"])
    assert now(spark, scratch) == {**got, "F003": ("fault 2", "closed"), "F1004": ("fault 5000", "waiting")}
    # what the compaction covers is not read any more
    assert all(f"batch={i}" not in p for p in fault_log.read(spark, scratch).inputFiles() for i in range(base))


def test_a_batch_that_is_cut_off_gives_its_ids_to_the_next(spark, scratch, monkeypatch):
    fault_log.append(faults(spark, 0, 2), scratch, ["n"])
    with monkeypatch.context() as m:
        m.setattr(fault_log, "publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            fault_log.append(faults(spark, 7, 9), scratch, ["n"])
    assert len(now(spark, scratch)) == 2
    fault_log.append(faults(spark, 3, 4), scratch, ["n"])
    assert now(spark, scratch) == {"F001": ("fault 0", "open"), "F002": ("fault 1", "open"), "F003": ("fault 3", "open")}


def test_two_writers_of_one_batch(spark, scratch, monkeypatch):
    fault_log.append(faults(spark, 0, 1), scratch, ["n"])
    monkeypatch.setattr(fault_log, "published", lambda *a: [])     # has not seen the batch yet
    with pytest.raises(FileExistsError):
        fault_log.close(asked(spark, "F001"), scratch)
    assert published(spark, scratch) == [0]


ORDERS = "file string, completion_date string, severity string, location string, mileage string, interco_amount string, cost string, category string, nature_of_complaint string, fault_category_kw string"
ROWS = [("a", None, "high", "x", "10", "1.10", "2", "c1", "n1", "k"), ("a", "2024", "low", "y", "n/a", None, "3.5", None, "n1", "k"), ("b", None, None, None, "20.5", "n/a", "x", "c1", None, "k"),
        ("b", None, "high", "x", None, "2.20", "0.01", "c2", "n2", None), (None, "2024", "high", "z", "1", "3", None, "c2", "n1", "k")]


def scalars(df):
    return {c: v for c, v in df.first().asDict().items()}


def test_merged_statistics_equal_a_scan(spark, scratch):
    rows = spark.createDataFrame(ROWS, ORDERS)
    stat_states.store(rows.where("file = 'a'"), scratch, "file")
    stat_states.store(rows.where("file = 'b' and severity is null"), scratch, "file")     # half a file, which comes again
    stat_states.store(rows.where("file is null or file = 'b'"), scratch, "file")
    want = {**scalars(stats.fault_statistics(rows)), "high_severity_faults": 3}
    assert scalars(stat_states.merged(spark, scratch)) == want
    counts = stats.value_counts(rows, stat_states.DIMENSIONS)
    assert sorted(map(tuple, stat_states.merged_values(spark, scratch).collect())) == sorted(map(tuple, counts.collect()))
    assert spark.read.parquet(batch_path(scratch, "scalars", 0)).count() == 1     # a new file costs one row


def test_statistics_without_files_and_with_sums_that_overflow(spark, scratch):
    assert scalars(stat_states.merged(spark, scratch)) == {
        "total_records": 0, "active_faults": 0, "high_severity_faults": 0, "unique_locations": 0, "avg_mileage": None, "total_intercost": 0, "total_custcost": 0}
    assert stat_states.merged_values(spark, scratch).count() == 0
    most = "9" * 36
    stat_states.store(spark.createDataFrame([(f, None, None, None, None, None, most, None, None, None) for f in "aab"], ORDERS), scratch, "file")
    got = scalars(stat_states.merged(spark, scratch))
    assert got["total_custcost"] is None and got["total_intercost"] == 0 and got["total_records"] == 3


def test_distinct_locations_within_the_stated_error(spark, scratch):
    rows = spark.range(60_000).selectExpr("concat('f', id % 3) AS file", "cast(null as string) AS completion_date", "'low' AS severity", "concat('loc', id % 30000) AS location", "'1' AS mileage",
                                          "'1' AS interco_amount", "'1' AS cost", "'c' AS category", "'n' AS nature_of_complaint", "'k' AS fault_category_kw")
    stat_states.store(rows, scratch, "file")
    assert abs(scalars(stat_states.merged(spark, scratch))["unique_locations"] / 30_000 - 1) < 0.05
