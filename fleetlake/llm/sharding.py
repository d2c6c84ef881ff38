"""Sharding by longest-processing-time scheduling.

Documents with equal texts form a group that stays together.  Groups, largest
first, go to the least-loaded shard through a heap.  The heap works on a
bounded table: a group of at least 1/(shards * bundles) of all bytes is a unit
of its own (there are at most shards * bundles of these), and smaller groups
are hashed into shards * bundles units.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.llm._common import numbered, written
from fleetlake.session import ship_code


def assign(units: DataFrame, shards: int) -> DataFrame:
    """Units (alone boolean, unit long, bytes long) with their shard.  Largest
    first, ties by (alone, unit), to the least-loaded shard, ties to the lowest."""
    ship_code()

    def lpt(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import heapq

        parts = list(parts)
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True).sort_values(["bytes", "alone", "unit"], ascending=[False, True, True])
        loads, to = [(0, s) for s in range(shards)], []
        for size in rows["bytes"]:
            load, shard = loads[0]
            heapq.heapreplace(loads, (load + size, shard))
            to.append(shard)
        yield pd.DataFrame({"alone": rows["alone"], "unit": rows["unit"], "shard": pd.Series(to, dtype="int32", index=rows.index)})

    return units.repartition(1).mapInPandas(lpt, "alone boolean, unit long, shard int")


def shard(docs: DataFrame, shards: int = 24, bundles: int = 512) -> DataFrame:
    """One row for each document: (doc_id, size, text_crc32, shard, slot).

    ``size`` is the UTF-8 bytes of the text plus 8.  A null text counts as an
    empty one and is in its group.  ``slot`` numbers the documents of a shard
    from 0 without gaps.  Groups are found by a 64-bit hash of the text: two
    different texts with one hash would share a shard too, which breaks no
    promise.  Shard loads differ by about one unit at most: 1/bundles of a
    shard, or the largest group.  Repeated rows and doc_ids each count, other
    columns are not read, and an empty table gives no row."""
    text, total_units = F.coalesce(F.col("text"), F.lit("")), shards * bundles
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("unit"))
    groups = rows.groupBy("unit").agg(F.sum("size").alias("bytes"))
    everything = rows.agg(F.sum("size")).scalar()
    alone = F.col("bytes").cast("decimal(38,0)") * total_units >= everything
    bundle = F.pmod("unit", F.lit(total_units))
    units = (groups.select(alone.alias("alone"), "unit", "bytes")
             .groupBy("alone", F.when(F.col("alone"), F.col("unit")).otherwise(bundle).alias("unit")).agg(F.sum("bytes").alias("bytes")))
    to = written(assign(units, shards), "shards")
    # at most shards * bundles rows each
    heads = F.broadcast(to.filter("alone").select("unit", F.col("shard").alias("own")))
    tails = F.broadcast(to.filter("not alone").select(F.col("unit").alias("bundle"), F.col("shard").alias("shared")))
    placed = (rows.withColumn("bundle", bundle).join(heads, "unit", "left").join(tails, "bundle", "left")
              .select("doc_id", "size", "text_crc32", F.coalesce("own", "shared").alias("shard")))
    return numbered(placed, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")


def shard_query(docs: DataFrame) -> DataFrame:
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
