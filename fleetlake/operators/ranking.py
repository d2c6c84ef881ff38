"""Rank rows inside groups without sending a group to one task.

``row_number() OVER (PARTITION BY g ORDER BY o)`` hash-partitions on ``g``:
a group holding a third of all rows would be sorted by a single task.  Here
rows are range-partitioned on ``(g, o)`` instead, so a large group spans many
partitions; inside a partition a group's rows are contiguous and ordered.
Each row's rank is

    (rows of its group in earlier partitions) + (position in this partition)
    - (position of the group's first row in this partition) + 1

The first term is a prefix sum over a table with one row per (partition,
group) pair, computed with a window over the partitions a group spans — at
most the partition count per group.  ``order`` must make the order total
(end it with a unique key) so re-run tasks produce the same ranks.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

POS_MASK = (1 << 33) - 1   # row index inside a partition, from monotonically_increasing_id


def ranged_table(df: DataFrame, keys, num_partitions: int | None = None) -> DataFrame:
    """Range-partition ``df`` on ``keys``, sort inside partitions and record
    each row's partition (``_pid``) and position (``_pos``) as columns.

    The result is written as a table in the shared checkpoint folder and read
    back: range bounds are sampled from the data, so two evaluations of an
    input whose row order is not fixed could disagree; the written table
    cannot, and it survives lost executors.  ``df`` is persisted for the two
    passes that read it (sampling and the write), so its plan runs once.
    """
    spark = df.sparkSession
    cols = [F.col(c) if isinstance(c, str) else c for c in keys]
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    # Without an explicit count AQE may merge small range partitions; it only
    # merges neighbours, so partition order still follows the key order.
    parts = (src.repartitionByRange(num_partitions, *cols) if num_partitions
             else src.repartitionByRange(*cols))
    ranged = (parts.sortWithinPartitions(*cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(POS_MASK))))
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/fleetlake-ranked-{uuid.uuid4().hex}"
    try:
        ranged.write.parquet(folder)
    finally:
        src.unpersist()
    return spark.read.parquet(folder)


def rank_within(df: DataFrame, group, order, out: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based rank of each row inside its group by ``order``."""
    g = list(group)
    ranged = ranged_table(df, g + list(order), num_partitions)
    per_part = ranged.groupBy("_pid", *g).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    earlier = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_pid", *g, "_first",
                              F.coalesce(F.sum("_cnt").over(earlier), F.lit(0)).alias("_off"))
    # null-safe: rows whose group is NULL are a group too
    offsets = offsets.select("_pid", "_first", "_off", *[F.col(c).alias(f"_group_{c}") for c in g]).withColumnRenamed("_pid", "_part")
    same = F.col("_pid") == F.col("_part")
    for c in g:
        same = same & F.col(c).eqNullSafe(F.col(f"_group_{c}"))
    joined = ranged.join(offsets, same).drop("_part", *[f"_group_{c}" for c in g])
    return (joined.withColumn(out, F.col("_off") + F.col("_pos") - F.col("_first") + 1)
            .drop("_pid", "_pos", "_first", "_off"))
