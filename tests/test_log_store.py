"""Retention by whole days."""

import os
import random

import pytest

from fleetlake.operators import log_store


def log(spark, ids, day=lambda i: f"2024-01-{1 + i // 100:02d}"):
    rows = [(i, day(i), f"m{i}") for i in ids]
    return spark.createDataFrame(rows, "log_id long, day string, message string").selectExpr("log_id", "to_timestamp(day) AS ts", "message")


def ids_of(df):
    return sorted(r.log_id for r in df.collect())


def files(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_days_are_dropped_or_left_and_one_is_rewritten(spark, scratch):
    assert log_store.read(spark, scratch).count() == 0
    log_store.append(log(spark, range(0, 600)), scratch)
    log_store.append(log(spark, range(600, 1000)), scratch)
    before = files(scratch)
    assert log_store.retain(spark, scratch, 350) == {"dropped": 6, "rewritten": 1, "left": 3}
    assert ids_of(log_store.read(spark, scratch)) == list(range(650, 1000))
    assert all(files(scratch)[p] == t for p, t in before.items())
    assert ids_of(log_store.after(spark, scratch, 970)) == list(range(971, 1000))
    assert all("day=2024-01-10" in p for p in log_store.after(spark, scratch, 970).inputFiles())
    assert log_store.vacuum(spark, scratch) == 7 and log_store.vacuum(spark, scratch) == 0
    assert ids_of(log_store.read(spark, scratch)) == list(range(650, 1000))
    # nothing to do, everything goes, and on again
    assert log_store.retain(spark, scratch, 350) == {"dropped": 0, "rewritten": 0, "left": 4}
    assert log_store.retain(spark, scratch, 0)["dropped"] == 4 and log_store.read(spark, scratch).count() == 0
    log_store.append(log(spark, [1500]), scratch)
    assert ids_of(log_store.read(spark, scratch)) == [1500]


@pytest.mark.parametrize("keep", [1, 7, 123, 400, 599])
def test_late_days_and_scattered_ids(spark, scratch, keep):
    # days that come late, in many batches, without a time, and ids far apart
    rng = random.Random(keep)
    ids = rng.sample(range(-10**15, 10**15), 600)
    day = {i: rng.choice([None, *[f"2024-02-{d:02d}" for d in range(1, 9)]]) for i in ids}
    for part in range(3):
        log_store.append(log(spark, ids[part::3], day.get), scratch)
    log_store.retain(spark, scratch, keep)
    assert ids_of(log_store.read(spark, scratch)) == sorted(ids)[-keep:]


def test_retention_that_is_cut_off_changes_nothing(spark, scratch, monkeypatch):
    log_store.append(log(spark, range(300)), scratch)

    def stop(*args, **kwargs):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(log_store, "publish", stop)
        with pytest.raises(OSError):
            log_store.retain(spark, scratch, 50)
    assert ids_of(log_store.read(spark, scratch)) == list(range(300))
    log_store.retain(spark, scratch, 50)
    assert ids_of(log_store.read(spark, scratch)) == list(range(250, 300))
