"""A stored fault log that is merged when it is read.

Appending and closing write only their batch: numbered new faults, or the ids
that are closed.  Batches appear at once (``streaming.published``), and each
carries a fact: the highest id number given so far.  New ids go on from there
without a look at the log, and as ids have no gaps, a requested id is known if
its number is not above it.

Reading takes the last compacted table and the batches since, and joins the
closed ids, which Spark broadcasts while they are few.  ``compact`` writes what
a read gives, so that reads stay short.  One writer at a time: a second one that
takes the same batch number gets an error and nothing of it is seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming.published import batch_path, facts_of, publish, published
from .lifecycle import ID_PREFIX, _id_number
from .ranking import ranged_table

ROWS = "number long, vehicle_id string, fault_description string, severity string, timestamp timestamp, status string"
CLOSED = "number long"
UNKNOWN = "fault_id string, error string"
COLUMNS = [c.split()[0] for c in ROWS.split(", ")][1:]


def _state(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """Number of the next batch, and the facts of the last one."""
    ids = published(spark, folder)
    return (ids[-1] + 1, facts_of(spark, folder, ids[-1])) if ids else (0, {"high": 0, "base": None})


def _read(spark: SparkSession, folder: str, part: str, schema: str, first: int, last: int) -> DataFrame:
    ids = [i for i in published(spark, folder) if first <= i <= last and part in facts_of(spark, folder, i)["parts"]]
    return spark.read.schema(schema).parquet(*[batch_path(folder, part, i) for i in ids]) if ids else spark.createDataFrame([], schema)


def append(new: DataFrame, folder: str, order: list[str], default_status: str = "open") -> int:
    """M1: give new faults the next ids, in ``order`` (a total one), and store
    them; returns the batch's number.

    ``new`` has vehicle_id, fault_description, severity, timestamp and may have
    status (NULL: the default).  An empty ``new`` is a batch without rows."""
    spark = new.sparkSession
    batch, before = _state(spark, folder)
    ranged = ranged_table(new, order)
    # one row per partition
    counts = ranged.groupBy("_pid").agg(F.count("*").alias("n"))
    offsets = counts.select("_pid", "n", (F.sum("n").over(Window.orderBy("_pid")) - F.col("n") + before["high"]).alias("_off"))
    status = F.coalesce(F.col("status"), F.lit(default_status)) if "status" in new.columns else F.lit(default_status)
    rows = ranged.join(F.broadcast(offsets), "_pid").select(
        (F.col("_off") + F.col("_pos") + 1).alias("number"), "vehicle_id", "fault_description", "severity", "timestamp", status.alias("status"))
    rows.write.mode("overwrite").parquet(batch_path(folder, "rows", batch))
    added = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    publish(spark, folder, batch, ["rows"], once=True, high=before["high"] + added, base=before["base"])
    return batch


def close(requests: DataFrame, folder: str) -> DataFrame:
    """M3: close the faults with the requested ``fault_id``; the others are
    returned, with the error.  Only the requests are looked at: the log is
    neither read nor written.  Closing again changes nothing."""
    spark = requests.sparkSession
    batch, before = _state(spark, folder)
    asked = requests.select("fault_id").where(F.col("fault_id").isNotNull()).distinct().withColumn("number", _id_number(F.col("fault_id")))
    known = F.coalesce(F.col("number").between(1, before["high"]) & (F.col("fault_id") == F.format_string(ID_PREFIX + "%03d", "number")), F.lit(False))
    asked.where(known).select("number").write.mode("overwrite").parquet(batch_path(folder, "closed", batch))
    unknown = asked.where(~known).select("fault_id", F.concat(F.lit("no fault has the id "), F.col("fault_id")).alias("error"))
    unknown.write.mode("overwrite").parquet(batch_path(folder, "unknown", batch))
    publish(spark, folder, batch, ["closed", "unknown"], once=True, high=before["high"], base=before["base"])
    return spark.read.schema(UNKNOWN).parquet(batch_path(folder, "unknown", batch))


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    batch, facts = _state(spark, folder)
    first = 0 if facts["base"] is None else facts["base"] + 1
    rows = _read(spark, folder, "rows", ROWS, first, batch)
    if facts["base"] is not None:
        rows = spark.read.schema(ROWS).parquet(batch_path(folder, "base", facts["base"])).unionByName(rows)
    closed = _read(spark, folder, "closed", CLOSED, first, batch).distinct().withColumn("_closed", F.lit(True))
    return rows.join(closed, "number", "left").withColumn("status", F.when(F.col("_closed"), "closed").otherwise(F.col("status"))).drop("_closed")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The log as it is now: ``fault_id``, its columns and the latest status."""
    return _merged(spark, folder).select(F.format_string(ID_PREFIX + "%03d", "number").alias("fault_id"), *COLUMNS)


def compact(spark: SparkSession, folder: str) -> int:
    """Store the log as one table, which reads then begin with; returns the
    batch's number.  Earlier batches are no longer read."""
    batch, before = _state(spark, folder)
    _merged(spark, folder).write.mode("overwrite").parquet(batch_path(folder, "base", batch))
    publish(spark, folder, batch, ["base"], once=True, high=before["high"], base=batch)
    return batch
