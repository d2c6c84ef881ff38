"""Log entries line by line, in batch and stream, and batches that appear at once."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from fleetlake.operators import logs
from fleetlake.streaming import ingest, published
from xlsx_util import kardex_rows, make_xlsx

PREFIX = re.compile(logs.HEAD)
COLUMNS = ["log", "entry_file", "line_no", "ts", "line"]


def expected(folder):
    """(log, file in which the entry begins, number in the entry, time, line)."""
    out = []
    for log in sorted(os.listdir(folder)):
        entry = None
        for name in sorted(os.listdir(os.path.join(folder, log))):
            with open(os.path.join(folder, log, name), newline="") as f:
                text = f.read()
            for line in text.split("\n")[: -1 if text.endswith("\n") or not text else None]:
                m = PREFIX.match(line)
                if m:
                    entry = [name, -1, m.group(1)]
                if entry is None:
                    out.append((log, name, 0, None, line))
                    continue
                entry[1] += 1
                out.append((log, entry[0], entry[1], entry[2], line[m.end():] if m else line))
    return sorted(map(str, out))


def found(rows):
    ts = F.date_format("ts", logs.TS_FORMAT)
    return sorted(str(tuple(r)) for r in rows.select(F.substring_index("log", "/", -1), "entry_file", "line_no", ts, "line").collect())


def write_logs(folder, seed=1, files=4, lines=40):
    rng = random.Random(seed)
    for log in ("app", "web", "quiet"):
        os.makedirs(os.path.join(folder, log))
        for i in range(files):
            with open(os.path.join(folder, log, f"part-{i}.log"), "w") as f:
                for k in range(rng.randrange(lines)):
                    head = log != "quiet" and rng.random() < 0.2
                    f.write((f"[2024-01-0{i + 1} 00:{k // 60:02d}:{k % 60:02d}.{rng.randrange(1000):03d}] " if head else "") + rng.choice(["", "é", "text " * rng.randrange(9), "[2024] no prefix"]) + "\n")
    return folder


@pytest.mark.parametrize("split_bytes", [17, 130, 10**6])
def test_lines_of_entries_over_many_splits(spark, scratch, split_bytes):
    folder = write_logs(os.path.join(scratch, "logs"), seed=split_bytes)
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    small.conf.set("spark.sql.files.openCostInBytes", "1")
    assert found(logs.read_entry_lines(small, folder)) == expected(folder)


def test_an_entry_of_many_lines_is_held_by_no_task(spark, scratch):
    os.makedirs(os.path.join(scratch, "logs", "app"))
    n = 300_000
    with open(os.path.join(scratch, "logs", "app", "a.log"), "w") as f:
        f.write("[2024-01-01 00:00:00.000] begin\n" + "".join(f"line {i}\n" for i in range(n)))
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    small.conf.set("spark.sql.files.openCostInBytes", "1")
    rows = logs.read_entry_lines(small, os.path.join(scratch, "logs"))
    per_task = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) > 20 and max(per_task) < n / 10
    assert rows.where("line_no > 0 and line <> concat('line ', line_no - 1)").isEmpty()
    assert rows.agg(F.min("entry_split"), F.max("entry_at"), F.count("*"), F.max("line_no")).first() == (0, 0, n + 1, n)


def test_batches_cut_at_any_place_of_python_batches(spark, scratch):
    folder = write_logs(os.path.join(scratch, "logs"), seed=5, files=2, lines=200)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert found(logs.read_entry_lines(spark, folder)) == expected(folder)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_stream_equals_batch_when_batches_cut_entries(spark, scratch):
    folder, out, ck = (os.path.join(scratch, d) for d in ("logs", "out", "ck"))
    write_logs(folder, seed=9, files=5)
    ingest.entry_stream(spark, folder, out, ck, max_files=2).awaitTermination()
    assert len(published.published(spark, out)) > 5
    assert found(ingest.read_output(spark, out, "lines")) == expected(folder) == found(logs.read_entry_lines(spark, folder))
    # the next file goes on with the entry that is open
    with open(os.path.join(folder, "app", "part-9.log"), "w") as f:
        f.write("goes on\n[2024-02-01 00:00:00.000] next\n")
    ingest.entry_stream(spark, folder, out, ck).awaitTermination()
    assert found(ingest.read_output(spark, out, "lines")) == expected(folder)


def test_stream_equals_batch_when_files_come_in_any_order(spark, scratch):
    folder, out, ck = (os.path.join(scratch, d) for d in ("logs", "out", "ck"))
    write_logs(folder, seed=11)
    for log in os.listdir(folder):  # the last file is the oldest
        for i in range(4):
            os.utime(os.path.join(folder, log, f"part-{i}.log"), (10**9 - i * 10,) * 2)
    ingest.entry_stream(spark, folder, out, ck, max_files=5).awaitTermination()
    lines = ingest.read_output(spark, out, "lines")
    assert lines.select("batch").distinct().count() > 2
    assert found(lines) == expected(folder)


def test_a_log_that_is_idle_for_long_is_forgotten(spark, scratch):
    folder, out = os.path.join(scratch, "logs"), os.path.join(scratch, "out")
    for log, days in (("old", 9), ("new", 1)):
        os.makedirs(os.path.join(folder, log))
        with open(os.path.join(folder, log, "1.log"), "w") as f:
            f.write("[2024-01-01 00:00:00.000] open\n")
        os.utime(os.path.join(folder, log, "1.log"), (10**9 - days * 86400,) * 2)
    ingest.entry_stream(spark, folder, out, os.path.join(scratch, "ck"), forget_after="2 days").awaitTermination()
    for log in ("old", "new"):
        with open(os.path.join(folder, log, "2.log"), "w") as f:
            f.write("more\n")
        os.utime(os.path.join(folder, log, "2.log"), (10**9,) * 2)
    ingest.entry_stream(spark, folder, out, os.path.join(scratch, "ck"), forget_after="2 days").awaitTermination()
    got = {os.path.basename(r["log"]): (r["line_no"], r["ts"] is None) for r in ingest.read_output(spark, out, "lines").where("line = 'more'").collect()}
    assert got == {"old": (0, True), "new": (1, False)}


def test_no_logs(spark, scratch):
    os.makedirs(os.path.join(scratch, "logs"))
    assert logs.read_entry_lines(spark, os.path.join(scratch, "logs")).count() == 0


REC = [{"WO No": "WO-1", "Open Date": "2024-01-01", "Nature of Complaint": "c", "Job Description": "Fuel filter service"}]


@pytest.mark.parametrize("fails_at", ["sheet_counts", "publish"])
def test_a_batch_that_is_cut_off_is_invisible_and_then_whole(spark, scratch, monkeypatch, fails_at):
    src, out, ck = (os.path.join(scratch, d) for d in ("in", "out", "ck"))
    os.makedirs(src)
    make_xlsx(os.path.join(src, "a.xlsx"), [("Lifestyle (6yrs)", kardex_rows(REC))])
    ingest.workbook_stream(spark, src, out, ck).awaitTermination()
    make_xlsx(os.path.join(src, "b.xlsx"), [("10 ft (6yrs)", kardex_rows(REC * 2))])
    with monkeypatch.context() as m:
        def killed(*args):
            raise RuntimeError("killed")
        m.setattr(ingest.sheets if fails_at == "sheet_counts" else ingest, fails_at, killed)
        with pytest.raises(Exception, match="killed"):
            ingest.workbook_stream(spark, src, out, ck).awaitTermination()
    assert os.path.isdir(os.path.join(out, "good", "batch=1"))      # written, and not yet to be seen
    assert [ingest.read_output(spark, out, p).count() for p in ("good", "sheet_counts")] == [1, 1]
    ingest.workbook_stream(spark, src, out, ck).awaitTermination()
    assert [ingest.read_output(spark, out, p).count() for p in ("good", "sheet_counts")] == [3, 2]
    assert published.published(spark, out) == [0, 1]
    assert {r["batch"] for r in ingest.read_output(spark, out).select("batch").collect()} == {0, 1}


def test_reading_before_the_first_batch(spark, scratch):
    with pytest.raises(FileNotFoundError):
        published.read_published(spark, scratch, "good")
    assert published.read_published(spark, scratch, "good", "a int").columns == ["a", "batch"]
    published.publish(spark, scratch, 3, ["good"])
    published.publish(spark, scratch, 3, ["good"])
    assert published.published(spark, scratch) == [3]
