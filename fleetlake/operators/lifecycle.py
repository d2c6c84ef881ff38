"""Fault-log lifecycle as batch operations.

The original edits one row at a time; here a whole batch of new or closed
faults is one plan: numbering is a distributed prefix sum, closing is a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranged_table

ID_PREFIX = "F"


def _id_number(c):
    return F.substring(c, F.lit(2), F.length(c)).try_cast("long")


def max_fault_number(existing: DataFrame) -> DataFrame:
    """One row: the largest numeric part of existing ids (0 when none)."""
    return existing.agg(F.coalesce(F.max(_id_number(F.col("fault_id"))), F.lit(0).cast("long")).alias("_base"))


def next_fault_ids(existing: DataFrame, new: DataFrame, order, num_partitions: int | None = None) -> DataFrame:
    """Give each new row ``fault_id`` = F%03d(base + rank), where base
    is the largest existing number (``F001`` first when there is none) and
    rank follows ``order`` (which must be a total order, e.g. end with a
    unique key).

    No single-partition window: rows are range-partitioned on ``order`` and
    sorted inside partitions; each row's rank is its partition's offset (a
    prefix sum over per-partition counts — one small row per partition) plus
    its position inside the partition (``ranking.ranged_table``).
    """
    ranged = ranged_table(new, list(order), num_partitions)
    # The existing maximum enters the prefix sum as a pseudo partition -1, so
    # every offset already includes it.  The table has one row per partition.
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt")).unionByName(
        max_fault_number(existing).select(F.lit(-1).alias("_pid"), F.col("_base").alias("_cnt")))
    offsets = counts.select(
        "_pid", F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)).alias("_off")
    ).where(F.col("_pid") >= 0)
    # Bounded by the partition count: safe to broadcast.
    numbered = ranged.join(F.broadcast(offsets), "_pid").withColumn("_rank", F.col("_off") + F.col("_pos") + 1)
    return numbered.withColumn("fault_id", F.format_string(ID_PREFIX + "%03d", F.col("_rank"))) \
        .drop("_pid", "_pos", "_off", "_rank")


def append_faults(existing: DataFrame, new: DataFrame, order, now_col: str = "timestamp",
                  default_status: str = "open") -> DataFrame:
    """M1: number a batch of new faults and append it to the log.

    ``new`` has ``vehicle_id, fault_description, severity`` and a timestamp
    column (passed in, so results are reproducible); ``status`` defaults to
    ``open`` when absent or NULL.
    """
    numbered = next_fault_ids(existing, new, order)
    status = F.coalesce(F.col("status"), F.lit(default_status)) if "status" in new.columns else F.lit(default_status)
    rows = numbered.select("fault_id", "vehicle_id", "fault_description", "severity",
                           F.col(now_col).alias("timestamp"), status.alias("status"))
    return existing.select(*rows.columns).unionByName(rows)


def close_faults(existing: DataFrame, requests: DataFrame):
    """M3: set ``status='closed'`` for every requested ``fault_id``.

    Returns ``(updated_log, unknown)``; ``unknown`` lists requested ids that
    are not in the log with the error text.  Requests are de-duplicated by a
    hash aggregate whose output is already partitioned by ``fault_id``, so
    the join only shuffles the log; AQE turns it into a broadcast join at run
    time when the request batch is small.  Idempotent.
    """
    req = requests.select("fault_id").where(F.col("fault_id").isNotNull()).distinct() \
        .withColumn("_hit", F.lit(True))
    updated = (existing.join(req, "fault_id", "left")
               .withColumn("status", F.when(F.col("_hit"), F.lit("closed")).otherwise(F.col("status")))
               .drop("_hit"))
    unknown = (req.drop("_hit").join(existing.select("fault_id"), "fault_id", "left_anti")
               .withColumn("error", F.concat(F.lit("no fault has the id "), F.col("fault_id"))))
    return updated, unknown
