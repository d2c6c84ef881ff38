"""Incremental ingest with Structured Streaming.

Workbooks: a ``binaryFile`` file stream; each micro-batch is parsed to cells,
read under the spec's header row and run through the configured pipeline.  Good
rows, rejected rows and sheet counts are written to ``batch=<id>`` folders and
published together (``published``), so readers never see part of a batch.

Logs: a text file stream.  An entry may go on in the next file of its log, and
that file may come in another micro-batch, later or earlier: the file source
takes files by their times, and files of one time in any order.  So a batch
publishes lines with their positions in their splits, and one row per split;
lines meet the entries that go on from other splits when they are read.

The file source's checkpoint records which files were seen, so a restart never
processes a file twice, and a batch that was cut off is written again over its
own folders.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs as L
from ..operators import sheets
from ..plans import kardex as K
from ..sources.workbook import is_excel, read_cells
from ..spec import KARDEX, FormatSpec
from .published import batch_path, publish, published, read_published

POSITION = ("path", "sheet_name", "row_ix")
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
KNOWN_SCHEMA = "log string, since long, seen timestamp"


def process_workbook_batch(files: DataFrame, out: str, batch_id: int, spec: FormatSpec = KARDEX) -> None:
    """One micro-batch of ``binaryFile`` rows -> good/rejected work orders."""
    # The batch's cells feed three outputs: parse once, reuse, release.
    cells = read_cells(files.where(is_excel(F.col("path")))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = sheets.sheet_pivot(cells, spec, sheets=spec.sheets or None)
        good, rejected = K.quarantine(rows, spec, keep=POSITION)
        good.write.mode("overwrite").parquet(batch_path(out, "good", batch_id))
        rejected.select(*POSITION, "work_order", "reason").write.mode("overwrite").parquet(batch_path(out, "rejected", batch_id))
        sheets.sheet_counts(cells).write.mode("overwrite").parquet(batch_path(out, "sheet_counts", batch_id))
        publish(files.sparkSession, out, batch_id, ["good", "rejected", "sheet_counts"])
    finally:
        cells.unpersist()


def workbook_stream(spark: SparkSession, folder: str, out: str, checkpoint: str,
                    spec: FormatSpec = KARDEX, available_now: bool = True, processing_time: str | None = None):
    """Start the workbook ingest; returns the ``StreamingQuery``."""
    src = (spark.readStream.format("binaryFile")
           .schema(BINARY_FILE_SCHEMA)
           .option("recursiveFileLookup", "true")
           .load(folder))
    writer = (src.writeStream
              .foreachBatch(lambda df, bid: process_workbook_batch(df, out, bid, spec))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time or "1 minute")
    return writer.start()


def process_log_batch(text: DataFrame, out: str, batch_id: int, forget_after: str | None = None) -> None:
    """One micro-batch of log lines -> ``positions`` of lines, ``splits``, and
    ``known``, one row per log: when it was seen last, and since which batch its
    entries go on.  The state is that of the last batch before this one that
    was published."""
    spark = text.sparkSession
    earlier = [i for i in published(spark, out) if i < batch_id]
    known = spark.read.schema(KNOWN_SCHEMA).parquet(batch_path(out, "known", earlier[-1])) if earlier else spark.createDataFrame([], KNOWN_SCHEMA)
    lines = L.file_lines(text)
    heads = L.split_heads(lines)
    heads.write.mode("overwrite").parquet(batch_path(out, "heads", batch_id))
    heads = spark.read.schema(heads.schema).parquet(batch_path(out, "heads", batch_id))
    if forget_after is not None:  # by the files' times, so that a repeated batch decides alike
        now = heads.agg(F.max("seen")).first()[0]
        known = known.where(F.lit(now).isNull() | (F.col("seen") >= F.lit(now) - F.expr(f"interval {forget_after}")))
    since = F.coalesce("since", F.lit(batch_id).cast("long")).alias("since")
    heads.join(known.drop("seen"), "log", "left").select(*heads.columns, since).write.mode("overwrite").parquet(batch_path(out, "splits", batch_id))
    (known.unionByName(heads.select("log", F.lit(None).cast("long").alias("since"), "seen"))
     .groupBy("log").agg(F.max("since").alias("since"), F.max("seen").alias("seen")).select("log", since, "seen")
     .write.mode("overwrite").parquet(batch_path(out, "known", batch_id)))
    L.positions(lines).write.mode("overwrite").parquet(batch_path(out, "positions", batch_id))
    publish(spark, out, batch_id, ["positions", "splits", "known"])


def entry_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, available_now: bool = True, max_files: int | None = None, forget_after: str | None = None):
    """Start the log ingest line by line; returns the query.  ``read_output(spark, out,
    "lines")`` gives every line with its entry, as the batch reader
    ``read_entry_lines`` does, in whatever order the files of a log come.

    A log that got no file for ``forget_after`` (such as '2 days', by the files'
    times) is forgotten: lines that come without a prefix then are entries of
    their own."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    writer = (reader.text(folder).select("value", "_metadata").writeStream
              .foreachBatch(lambda df, bid: process_log_batch(df, out, bid, forget_after))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def log_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, available_now: bool = True):
    """Start the ingest of small rotated log files, each read as one string and
    complete in itself (entries appended as parquet); returns the query."""
    files = spark.readStream.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    entries = L.parse_text(files)
    writer = (entries.writeStream.format("parquet")
              .option("path", out)
              .option("checkpointLocation", checkpoint)
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_output(spark: SparkSession, out: str, part: str = "good", schema: str | None = None) -> DataFrame:
    """Everything that a stream has published so far (all finished batches).
    The part ``lines`` of a log stream is made from its positions and splits."""
    if part != "lines" or not published(spark, out):
        return read_published(spark, out, part, schema)
    placed = read_published(spark, out, "positions")  # first, so that the splits of all its batches are there
    lines = L.entry_lines(placed, read_published(spark, out, "splits"), [*L.SPLIT, "batch"], ["since"])
    return lines if schema is None else lines.select(*spark.createDataFrame([], schema + ", batch long").columns)
