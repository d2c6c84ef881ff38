"""A stored log with retention by whole days.

Entries lie in one folder for each batch and day.  Every batch comes with a
small table of its days: how many entries, least and greatest id.  Retention
decides by these tables which folders it must touch: a folder whose greatest id
is too old is dropped, one whose least id is young enough stays as it is, and
only those between are read and written again.  No global sort is needed, and a
day may come late or in many batches, as ids alone decide.

Batches appear at once (``streaming.published``); a batch's fact ``live`` names
the folders that a reader takes.  Retention that is cut off changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming.published import batch_path, facts_of, publish, published

ENTRY = "log_id long, ts timestamp, message string"
DAYS = "day string, n long, low long, high long"


def _state(spark: SparkSession, folder: str) -> tuple[int, list]:
    """Number of the next batch, and the live folders as [batch, day, n, low, high]."""
    ids = published(spark, folder)
    return (ids[-1] + 1, facts_of(spark, folder, ids[-1])["live"]) if ids else (0, [])


def _write(entries: DataFrame, folder: str, batch: int) -> list:
    """Write a batch by days; returns its folders, one small row each."""
    spark = entries.sparkSession
    days = entries.select("log_id", "ts", "message", F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("none")).alias("day"))
    days.write.mode("overwrite").partitionBy("day").parquet(batch_path(folder, "entries", batch))
    stored = spark.read.schema(ENTRY + ", day string").parquet(batch_path(folder, "entries", batch))
    bounds = stored.groupBy("day").agg(F.count("*").alias("n"), F.min("log_id").alias("low"), F.max("log_id").alias("high"))
    return [[batch, r["day"], r["n"], r["low"], r["high"]] for r in bounds.collect()]


def append(entries: DataFrame, folder: str) -> int:
    """K4: store entries (log_id, ts, message); returns the batch's number.  An
    entry without a time is of the day ``none``; ids are not null and unique."""
    batch, live = _state(entries.sparkSession, folder)
    publish(entries.sparkSession, folder, batch, ["entries"], once=True, live=live + _write(entries, folder, batch))
    return batch


def _entries(spark: SparkSession, folder: str, live: list) -> DataFrame:
    paths = [f"{batch_path(folder, 'entries', batch)}/day={day}" for batch, day, *_ in live]
    return spark.read.schema(ENTRY).parquet(*paths) if paths else spark.createDataFrame([], ENTRY)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All entries that are kept, in no order."""
    return _entries(spark, folder, _state(spark, folder)[1])


def after(spark: SparkSession, folder: str, log_id: int) -> DataFrame:
    """Entries above ``log_id``, from the folders that can have one, by id."""
    live = [d for d in _state(spark, folder)[1] if d[4] > log_id]
    return _entries(spark, folder, live).where(F.col("log_id") > log_id).orderBy("log_id")


def _least_kept(spark: SparkSession, folder: str, live: list, keep: int) -> int:
    """The ``keep``-th greatest id, from the few folders that can have it."""
    # folders are taken by falling least id until they have enough: the answer is not below the last one's
    have, bound = 0, None
    for _, _, n, low, _ in sorted(live, key=lambda d: -d[3]):
        have, bound = have + n, low
        if have >= keep:
            break
    # folders that lie above the last one as a whole are counted, not read
    some = sorted((d for d in live if d[4] >= bound), key=lambda d: -d[3])
    above, rest = 0, list(some)
    for i, d in enumerate(some):
        if above + d[2] < keep and all(e[4] < d[3] for e in some[i + 1:]):
            above, rest = above + d[2], some[i + 1:]
        else:
            break
    ids = _entries(spark, folder, rest).select("log_id").where(F.col("log_id") >= bound)
    return _nth_greatest(ids, keep - above)


def _nth_greatest(ids: DataFrame, n: int) -> int:
    """The ``n``-th greatest of unique ids: counts of 4096 equal ranges of ids,
    then of the one range that holds it, until a range is one id wide."""
    low, high = ids.agg(F.min("log_id"), F.max("log_id")).first()
    while low < high:
        width = -(-(high - low + 1) // 4096)
        counts = (ids.where(F.col("log_id").between(low, high)).groupBy(F.expr(f"(log_id - {low}L) div {width}L").alias("part")).count()
                  .withColumn("above", F.sum("count").over(Window.orderBy(F.desc("part")))))
        part = counts.where(F.col("above") >= n).orderBy("above").first()
        n -= part["above"] - part["count"]
        low, high = low + part["part"] * width, min(high, low + (part["part"] + 1) * width - 1)
    return low


def retain(spark: SparkSession, folder: str, keep: int) -> dict[str, int]:
    """Keep the ``keep`` entries with the greatest ids.  Returns how many
    folders were dropped, written again and left as they are."""
    batch, live = _state(spark, folder)
    if keep >= sum(d[2] for d in live):
        return {"dropped": 0, "rewritten": 0, "left": len(live)}
    least = _least_kept(spark, folder, live, keep) if keep > 0 else max(d[4] for d in live) + 1
    cut = [d for d in live if d[3] < least <= d[4]]
    left = [d for d in live if d[3] >= least]
    again = _write(_entries(spark, folder, cut).where(F.col("log_id") >= least), folder, batch) if cut else []
    publish(spark, folder, batch, ["entries"], once=True, live=left + again)
    return {"dropped": len(live) - len(left) - len(cut), "rewritten": len(cut), "left": len(left)}


def vacuum(spark: SparkSession, folder: str) -> int:
    """Delete the folders that no reader takes any more; returns how many.  To be
    run once readers that began before the last retention have ended."""
    state = _state(spark, folder)
    taken, gone = {(b, d) for b, d, *_ in state[1]}, 0
    for batch in published(spark, folder):
        root = spark._jvm.org.apache.hadoop.fs.Path(batch_path(folder, "entries", batch))
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            continue
        for item in fs.listStatus(root):
            name = item.getPath().getName()
            if name.startswith("day=") and (batch, name[4:]) not in taken:
                fs.delete(item.getPath(), True)
                gone += 1
    return gone
