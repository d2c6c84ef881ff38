"""Application-log records.

Log lines look like ``[YYYY-mm-dd HH:MM:SS.mmm] message``.  A message may
span lines (a start-up banner): continuation lines carry no prefix and belong
to the entry before them; lines before the first prefix get a NULL time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_code

# The record layout of a log line.
TS_PATTERN = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}"
LINE_PATTERN = r"^\[(" + TS_PATTERN + r")\] ?(.*)$"
TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"
INITIAL_PAGE = 100       # first log page size
RETAINED = 1000          # entries kept by retention


def format_line(ts: Column, message: Column) -> Column:
    """``[ts] message`` as written to the log file."""
    return F.concat(F.lit("["), F.date_format(ts, TS_FORMAT), F.lit("] "), message)


def parse_lines(lines: DataFrame, col: str = "line", keep=()) -> DataFrame:
    """One entry per single line: ``ts`` (NULL when unprefixed), ``message``."""
    raw = F.col(col)
    m = raw.rlike(LINE_PATTERN)
    return lines.select(
        *keep,
        F.when(m, F.try_to_timestamp(F.regexp_extract(raw, LINE_PATTERN, 1), F.lit(TS_FORMAT))).alias("ts"),
        F.when(m, F.regexp_extract(raw, LINE_PATTERN, 2)).otherwise(raw).alias("message"),
    )


HEAD = r"^\[(" + TS_PATTERN + r")\] ?"


def read_log_files(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Log files -> entries ``path, ts, message`` with multi-line
    messages stitched to the entry they continue.

    Default: line level (``read_log_lines``), which splits large files across
    tasks.  ``whole_files=True`` reads each file as one string instead (fine
    for small rotated files; one file is then one task's input) and also
    returns ``entry_ix`` and ``sub``.
    """
    if whole_files:
        files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
        return parse_text(files)
    return read_log_lines(spark, path)


def parse_text(files: DataFrame, text_col: str = "value") -> DataFrame:
    """Whole-text log -> entries ``path, entry_ix, sub, ts, message``: the text
    is split before every prefixed line; lines before the first prefix are
    entries of their own (NULL ts, numbered by ``sub``).  Entries with an
    empty message are entries; an empty file has none."""
    text = F.regexp_replace(F.col(text_col), r"\n\z", "")
    pieces = F.split(text, r"\n(?=\[" + TS_PATTERN + r"\])")
    exploded = files.where(F.col(text_col) != "").select("path", F.posexplode(pieces).alias("entry_ix", "body"))
    body = F.col("body")
    has = body.rlike(HEAD)
    # a leading piece without a prefix holds the lines before the first entry
    lines = F.when(has, F.array(body)).otherwise(F.split(body, "\n"))
    flat = exploded.select("path", "entry_ix", F.posexplode(lines).alias("sub", "text"))
    has = F.col("text").rlike(HEAD)
    msg = F.when(has, F.regexp_replace(F.col("text"), HEAD, "")).otherwise(F.col("text"))
    return (flat.select("path", "entry_ix", "sub",
                        F.when(has, F.try_to_timestamp(F.regexp_extract(F.col("text"), HEAD, 1), F.lit(TS_FORMAT))).alias("ts"),
                        msg.alias("message")))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Line-level log reader for files of any size.

    Lines keep their file position as (``split_start`` from the scan's file
    metadata, ``line_id``: increasing within a split).  Each line is owned by
    the last prefixed line before it: first within its own split (a window
    per split, so a group is at most one split), then — for lines before the
    first prefix of a split — by the last prefixed line of an earlier split
    (a window over the one-row-per-split table).  Lines before any prefix of
    the file are entries of their own.  Output: ``path, split_start,
    line_id`` (of the entry's first line), ``ts``, ``message``.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("line_id"),
        F.col("value").alias("line"))
    return stitch_lines(lines)


def stitch_lines(lines: DataFrame) -> DataFrame:
    """``path, split_start, line_id, line`` -> entries (see ``read_log_lines``)."""
    split = ["path", "split_start"]
    is_head = F.col("line").rlike(HEAD)
    in_split = Window.partitionBy(*split).orderBy("line_id").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_head", is_head).withColumn(
        "_own", F.last(F.when(F.col("_head"), F.col("line_id")), ignorenulls=True).over(in_split))
    per_split = marked.groupBy(*split).agg(F.max(F.when(F.col("_head"), F.col("line_id"))).alias("_last"))
    earlier = Window.partitionBy("path").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_split.select(
        *split, F.last(F.when(F.col("_last").isNotNull(), F.struct(F.col("split_start").alias("s"),
                                                                    F.col("_last").alias("l"))),
                       ignorenulls=True).over(earlier).alias("_carry"))
    owned = marked.join(carry, split, "left").select(
        "path", "line_id", "split_start", "line",
        F.when(F.col("_own").isNotNull(), F.col("split_start")).otherwise(F.col("_carry.s")).alias("_os"),
        F.when(F.col("_own").isNotNull(), F.col("_own")).otherwise(F.col("_carry.l")).alias("_ol"))
    # lines before any prefix in the file own themselves
    owned = owned.select("path", "line", "split_start", "line_id",
                         F.coalesce("_os", "split_start").alias("e_split"),
                         F.coalesce("_ol", "line_id").alias("e_line"))
    entries = owned.groupBy("path", "e_split", "e_line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split_start", "line_id", "line"))),
                                 lambda x: x["line"]), "\n").alias("text"))
    has = F.col("text").rlike(HEAD)
    return (entries.select(
        "path", F.col("e_split").alias("split_start"), F.col("e_line").alias("line_id"),
        F.when(has, F.try_to_timestamp(F.regexp_extract(F.col("text"), HEAD, 1), F.lit(TS_FORMAT))).alias("ts"),
        F.when(has, F.regexp_replace(F.col("text"), HEAD, "")).otherwise(F.col("text")).alias("message")))


# ---------------------------------------------------------------------------
# W1 line by line: an entry of any length is never one value
# ---------------------------------------------------------------------------
#: Position of a line's entry when it begins in an earlier split, or nowhere.
ELSEWHERE = -1
SPLIT = ["log", "file", "split_start"]


def file_lines(text: DataFrame) -> DataFrame:
    """``log, file, split_start, seen, id, ts, line`` from a text scan, batch or
    stream: ``id`` goes up by one inside a split, ``ts`` is the text of a
    prefix, NULL for other lines, and ``seen`` the file's time.

    The files of one log lie in one folder, in the order of their names."""
    path = F.col("_metadata.file_path")
    ts = F.when(F.col("value").rlike(HEAD), F.regexp_extract("value", HEAD, 1))
    return text.select(F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("log"), F.substring_index(path, "/", -1).alias("file"), F.col("_metadata.file_block_start").alias("split_start"),
                       F.col("_metadata.file_modification_time").alias("seen"), F.monotonically_increasing_id().alias("id"), ts.alias("ts"), F.col("value").alias("line"))


def split_heads(lines: DataFrame) -> DataFrame:
    """One row per split: its ``n`` lines, and position and time of its last
    prefixed line."""
    last = F.max(F.when(F.col("ts").isNotNull(), F.struct("id", "ts")))
    return (lines.groupBy(*SPLIT).agg(F.count("*").alias("n"), F.min("id").alias("_first"), last.alias("_last"), F.max("seen").alias("seen"))
            .select(*SPLIT, "n", (F.col("_last.id") - F.col("_first")).alias("at"), F.col("_last.ts").alias("ts"), "seen"))


def carried(heads: DataFrame, key=SPLIT, apart=()) -> DataFrame:
    """``SPLIT, in_file, in_split, in_at, in_ts, in_lines``: for each split, place
    and time of the entry that is open at its beginning, and how many lines that
    has by then.  ``key`` names a split, and entries go on only where columns
    ``apart`` are equal.  A window over one row per split of a log."""
    w = Window.partitionBy("log", *apart).orderBy("file", "split_start")
    rows = heads.withColumn("_end", F.sum("n").over(w))
    place = F.struct(F.col("file").alias("file"), F.col("split_start").alias("split"), F.col("at").alias("at"))
    own = F.struct(place.alias("place"), F.col("ts").alias("ts"), (F.col("_end") - F.col("n") + F.col("at")).alias("number"))
    rows = rows.withColumn("_own", F.when(F.col("at").isNotNull(), own))
    rows = rows.withColumn("_in", F.last("_own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.select(*key, F.col("_in.place.file").alias("in_file"), F.col("_in.place.split").alias("in_split"), F.col("_in.place.at").alias("in_at"), F.col("_in.ts").alias("in_ts"),
                       (F.col("_end") - F.col("n") - F.col("_in.number")).alias("in_lines"))


def positions(lines: DataFrame) -> DataFrame:
    """``SPLIT, at, own, ts, line``: each line's position in its split, and
    position and time of the last prefixed line up to it in the split.

    A split is read by one task from its beginning, so nothing is shuffled or
    sorted, and what is carried from batch to batch is one position."""
    ship_code()
    schema = "log string, file string, split_start long, at long, own long, ts string, line string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, own, own_ts = None, 0, ELSEWHERE, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, ts = batch["id"].to_numpy(), batch["ts"]
            head, parts = ts.is_valid().to_numpy(zero_copy_only=False), [batch[c] for c in SPLIT]
            new = np.zeros(n, dtype=bool)
            for c in parts:
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            new[0] = key != tuple(c[0].as_py() for c in parts)
            begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            at = ids - np.where(begin >= 0, ids[begin], first)
            # the last line that begins a split or an entry: none yet, then what was held goes on
            last = np.maximum.accumulate(np.where(new | head, np.arange(n), -1))
            owns = np.where(last < 0, own, np.where(head[last], at[last], ELSEWHERE))
            times = pa.concat_arrays([ts, pa.array([own_ts], pa.string())]).take(pa.array(np.where(last < 0, n, last)))
            key, first, own, own_ts = tuple(c[-1].as_py() for c in parts), int(ids[-1] - at[-1]), int(owns[-1]), times[-1].as_py()
            yield pa.RecordBatch.from_arrays([*parts, pa.array(at), pa.array(owns), times, batch["line"]], names)

    return lines.select(*SPLIT, "id", "ts", "line").mapInArrow(run, schema)


def entry_lines(placed: DataFrame, heads: DataFrame, key=SPLIT, apart=()) -> DataFrame:
    """``log, entry_file, entry_split, entry_at, line_no, ts, line`` for each of
    ``placed``, lines with their ``positions``, and ``heads``, one row per split
    (see ``carried``): where its entry begins, its number in the entry and the
    entry's time.  Columns of ``key`` besides ``SPLIT`` come last.

    A prefixed line has number 0 and stands without its prefix.  Lines before
    any prefix of a log are entries of their own, with a NULL time.  No entry is
    gathered: lines stay where they are read and meet one row per split.  These
    rows are written, so that Spark knows their size: it broadcasts them while
    they are few and sorts both sides beyond that."""
    spark = heads.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/fleetlake-splits-{uuid.uuid4().hex}"
    splits = carried(heads, key, apart)
    splits.write.parquet(path)
    rows = placed.join(spark.read.schema(splits.schema).parquet(path), key)
    here, before = F.col("own") != ELSEWHERE, F.col("in_at").isNotNull()
    pick = lambda own, earlier, alone: F.when(here, own).when(before, earlier).otherwise(alone)
    return rows.select(
        "log", pick(F.col("file"), F.col("in_file"), F.col("file")).alias("entry_file"), pick(F.col("split_start"), F.col("in_split"), F.col("split_start")).alias("entry_split"),
        pick(F.col("own"), F.col("in_at"), F.col("at")).alias("entry_at"), pick(F.col("at") - F.col("own"), F.col("in_lines") + F.col("at"), F.lit(0).cast("long")).alias("line_no"),
        F.try_to_timestamp(F.coalesce("ts", "in_ts"), F.lit(TS_FORMAT)).alias("ts"),
        F.when(here & (F.col("at") == F.col("own")), F.regexp_replace("line", HEAD, "")).otherwise(F.col("line")).alias("line"),
        *(c for c in key if c not in SPLIT))


def read_entry_lines(spark: SparkSession, folder: str) -> DataFrame:
    """W1 on files of any size: the lines of all logs under ``folder`` with
    their entries (see ``entry_lines``).  The text is scanned twice, first for
    one row per split."""
    lines = file_lines(spark.read.text(folder, recursiveFileLookup=True))
    return entry_lines(positions(lines), split_heads(lines))


def latest_logs(logs: DataFrame, n: int = INITIAL_PAGE, id_col: str = "log_id") -> DataFrame:
    """O3: the newest ``n`` entries, returned in ascending id (a top-k)."""
    return logs.orderBy(F.desc(id_col)).limit(n).orderBy(id_col)


def log_retention(logs: DataFrame, keep: int = RETAINED, id_col: str = "log_id") -> DataFrame:
    """Keep the newest ``keep`` entries (compaction job input)."""
    return logs.orderBy(F.desc(id_col)).limit(keep)


def logs_after(logs: DataFrame, after_id, id_col: str = "log_id") -> DataFrame:
    """Entries with id greater than ``after_id`` in id order; ``-1`` asks
    for the initial page instead, as the original reader does."""
    if isinstance(after_id, int) and after_id == -1:
        return latest_logs(logs, INITIAL_PAGE, id_col)
    return logs.where(F.col(id_col) > after_id).orderBy(id_col)


def append_log(entries: DataFrame, path: str) -> None:
    """K4: append entries to a day-partitioned parquet log table."""
    (entries.withColumn("day", F.to_date("ts"))
     .write.mode("append").partitionBy("day").parquet(path))
