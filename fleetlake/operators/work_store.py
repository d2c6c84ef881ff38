"""Stored work orders with a page directory and a search index.

``store`` writes rows in the order of their pages, cut into ranges, and a
directory of one row per range: its first row's number and how many it has.  A
page then reads the one range (or few) that it lies in, however deep it is, and
no task counts off the rows before it.  Labels are columns of the table, so that
filters on them reach the Parquet reader instead of being worked out again.

``index_text`` adds a posting (trigram, range, block) for each trigram that a
block of ``BLOCK`` neighbouring rows has in its searched texts, sorted by
trigram, so there are far fewer postings than trigrams in the texts.  ``search``
looks up the rarest trigrams of what is asked, keeps the rows of the blocks that
have them all, and holds those rows against the whole text, so hits equal those
of a scan.

A store appears at once (``streaming.published``); storing or indexing again
adds a batch, and readers take the last one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType
from pyspark.sql.window import Window

from ..functions.text import search_blob
from ..session import ship_code
from ..streaming.published import batch_path, facts_of, publish, published
from .ranking import POS_MASK

#: Neighbouring rows of a range that share their postings.
BLOCK = 256
POSTINGS = "gram long, _range int, block long"
#: Bits of a code point, three of which make a trigram's number.
BITS = 21
#: Trigrams of what is asked that are looked up at most; the rows they lead to are verified.
LOOKED_UP = 8


def _last(spark: SparkSession, folder: str) -> dict:
    ids = published(spark, folder)
    if not ids:
        raise FileNotFoundError(f"nothing is stored in {folder}")
    return facts_of(spark, folder, ids[-1])


def _next(spark: SparkSession, folder: str) -> int:
    ids = published(spark, folder)
    return ids[-1] + 1 if ids else 0


def store(df: DataFrame, folder: str, order: str, tiebreak: str = "row_ix", ranges: int | None = None) -> int:
    """Write ``df`` ordered by (``order``, nulls first, ``tiebreak``), which must
    be a total order so that a task run again places its rows alike.  Returns
    the batch's number.  No row gives an empty store."""
    spark, batch = df.sparkSession, _next(df.sparkSession, folder)
    keys = [F.col(order).asc_nulls_first(), F.col(tiebreak).asc_nulls_first()]
    src = df.persist(StorageLevel.MEMORY_AND_DISK)  # its keys are sampled before it is written
    parts = src.repartitionByRange(ranges, *keys) if ranges else src.repartitionByRange(*keys)
    # the writer needs rows by _range, which this order gives without another sort
    rows = (parts.withColumn("_range", F.spark_partition_id()).sortWithinPartitions("_range", *keys)
            .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(POS_MASK))))
    try:
        rows.write.mode("overwrite").partitionBy("_range").parquet(batch_path(folder, "rows", batch))
    finally:
        src.unpersist()
    facts = {"rows": batch, "schema": df.schema.json(), "index": None}
    # one row per range
    sizes = _rows(spark, folder, facts).groupBy("_range").agg(F.count("*").alias("n"))
    first = F.sum("n").over(Window.orderBy("_range")) - F.col("n")
    sizes.select("_range", "n", first.alias("first")).write.mode("overwrite").parquet(batch_path(folder, "directory", batch))
    publish(spark, folder, batch, ["rows", "directory"], once=True, **facts)
    return batch


def _rows(spark: SparkSession, folder: str, facts: dict) -> DataFrame:
    schema = StructType.fromJson(json.loads(facts["schema"])).add("_place", LongType()).add("_range", IntegerType())
    return spark.read.schema(schema).parquet(batch_path(folder, "rows", facts["rows"]))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The stored rows, in no order."""
    return _rows(spark, folder, _last(spark, folder)).drop("_range", "_place")


def page(spark: SparkSession, folder: str, number: int, size: int = 10) -> DataFrame:
    """O1: page ``number`` (from 0), in order.  The ranges it lies in are found
    in the directory; at most ``size`` of them have a row of it."""
    facts = _last(spark, folder)
    begin, end = number * size, (number + 1) * size
    directory = spark.read.schema("_range int, n long, first long").parquet(batch_path(folder, "directory", facts["rows"]))
    inside = directory.where((F.col("first") < end) & (F.col("first") + F.col("n") > begin)).collect()
    wanted = [(F.col("_range") == r["_range"]) & F.col("_place").between(begin - r["first"], end - 1 - r["first"]) for r in inside]
    rows = _rows(spark, folder, facts).where(reduce(Column.__or__, wanted, F.lit(False)))
    return rows.orderBy("_range", "_place").drop("_range", "_place")


def _gram(a: int, b: int, c: int) -> int:
    return a << 2 * BITS | b << BITS | c


def _grams(texts: list[str]) -> np.ndarray:
    """The distinct trigrams of some texts, by code points."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    return np.unique(_gram(codes[:-2], codes[1:-1], codes[2:])[row[:-2] == row[2:]])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, _range, _place) -> ``POSTINGS``.  A block that two batches share,
    or whose rows do not lie together, gives some of its postings twice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts, ranges, blocks = batch.column("text"), batch.column("_range").to_numpy(), batch.column("_place").to_numpy() // BLOCK
        starts = np.flatnonzero(np.r_[True, (ranges[1:] != ranges[:-1]) | (blocks[1:] != blocks[:-1])])
        found = [_grams(texts[a:b].to_pylist()) for a, b in zip(starts, np.r_[starts[1:], batch.num_rows])]
        sizes = [len(g) for g in found]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(ranges[starts], sizes)), pa.array(np.repeat(blocks[starts], sizes))],
                                         ["gram", "_range", "block"])


def index_text(spark: SparkSession, folder: str, cols: list[str]) -> int:
    """Build the search index of the stored rows over ``cols``; returns the batch's number."""
    ship_code()
    facts, batch = _last(spark, folder), _next(spark, folder)
    texts = _rows(spark, folder, facts).select(search_blob(cols).alias("text"), "_range", "_place")
    # a trigram has at most one posting for each block, so none outgrows a task
    postings = texts.mapInArrow(_postings, POSTINGS).repartition("gram").sortWithinPartitions("gram", "_range", "block")
    postings.write.mode("overwrite").parquet(batch_path(folder, "postings", batch))
    stored = spark.read.schema(POSTINGS).parquet(batch_path(folder, "postings", batch))
    (stored.groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram")
     .write.mode("overwrite").parquet(batch_path(folder, "grams", batch)))
    publish(spark, folder, batch, ["postings", "grams"], once=True, **{k: facts[k] for k in ("rows", "schema")}, index={"batch": batch, "cols": cols})
    return batch


def search(spark: SparkSession, folder: str, q: str) -> DataFrame:
    """the stored rows whose indexed columns hold ``q``, whatever its case,
    through the index.  A ``q`` shorter than a trigram has none to look up and
    all rows are read."""
    facts, asked = _last(spark, folder), q.lower()
    if facts["index"] is None:
        raise ValueError(f"{folder} has no search index")
    rows, at = _rows(spark, folder, facts), facts["index"]["batch"]
    grams = sorted({_gram(*map(ord, asked[i:i + 3])) for i in range(len(asked) - 2)})
    if grams:
        counts = spark.read.schema("gram long, n long").parquet(batch_path(folder, "grams", at)).where(F.col("gram").isin(grams))
        rarest = [r["gram"] for r in counts.orderBy("n", "gram").limit(LOOKED_UP).collect()]  # at most LOOKED_UP rows
        known = len(rarest) == min(len(grams), LOOKED_UP)
        postings = spark.read.schema(POSTINGS).parquet(batch_path(folder, "postings", at))
        met = (postings.where(F.col("gram").isin(rarest) if known else F.lit(False))
               .groupBy("_range", "block").agg(F.count_distinct("gram").alias("n")))
        met = met.where(F.col("n") == len(rarest)).select("_range", "block")
        rows = rows.withColumn("block", F.expr(f"_place div {BLOCK}")).join(met, ["_range", "block"], "left_semi").drop("block")
    return rows.where(search_blob(facts["index"]["cols"]).contains(asked)).drop("_range", "_place")
