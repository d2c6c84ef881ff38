"""Packing by concatenating and cutting.

All documents' token ids, in input order, are one long stream that is cut
into windows of ``length`` ids.  Pass one tokenizes each document once, keeps
the running total inside its input split and writes both; pass two adds the
totals of the splits before it (a prefix sum over one row per split), which
gives every document its global offset, and cuts at the window bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.llm._common import written
from fleetlake.llm.word_bpe import encoder
from fleetlake.session import ship_code

#: Texts tokenized by one call; bounds the memory that encodings take.
BATCH_CHARS = 2_000_000


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Rows (doc_id, split, split_file, split_at, start, n, ids): the ids of
    each document and ``end_id`` as little-endian unsigned 32-bit integers,
    and their place in the input split.  Splits are ordered by (split_file,
    split_at): file name and byte where the split begins, or the number of the
    partition for rows that do not come from files.  Null texts are empty."""
    ship_code()
    with open(tokenizer_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    try:
        rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                           F.col("_metadata.file_path").alias("split_file"),
                           F.col("_metadata.file_block_start").alias("split_at"))
    except AnalysisException:  # not read from files
        rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("split_file"),
                           F.spark_partition_id().cast("long").alias("split_at"))

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, end, at, total = encoder(model.value), end_id.to_bytes(4, "little"), None, 0
        for part in parts:
            size = part["text"].str.len().cumsum() // BATCH_CHARS
            for _, some in part.groupby(size, sort=False):
                ids, starts = [x + end for x in ids_of(some["text"].tolist())], []
                for key, x in zip(zip(some["split_file"], some["split_at"]), ids):
                    if key != at:
                        at, total = key, 0
                    starts.append(total)
                    total += len(x) // 4
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64"), "split_file": some["split_file"], "split_at": some["split_at"],
                                    "start": starts, "n": [len(x) // 4 for x in ids], "ids": ids})

    return rows.mapInPandas(encode, "doc_id long, split_file string, split_at long, start long, n long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 2) -> DataFrame:
    """One row for each piece of a document in a sequence: (doc_id, start,
    length, ids, doc_tokens, sequence_id, offset), ids as little-endian
    unsigned 32-bit integers.

    Only the last sequence of all is shorter than ``length``, so it is the only
    one that needs padding.  An empty or null text is its end id alone.
    Repeated rows and doc_ids are documents of their own, a null doc_id stays
    null, other columns are not read, and an empty table gives no row."""
    tokens = written(tokenize(docs, tokenizer_path, end_id).withColumn("split", F.xxhash64("split_file", "split_at")), "tokens")
    # one row for each input split
    splits = tokens.groupBy("split", "split_file", "split_at").agg(F.sum("n").alias("total"))
    before = Window.orderBy("split_file", "split_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("split", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    at = tokens.join(F.broadcast(offsets), "split").withColumn("at", F.col("before") + F.col("start"))
    pieces = at.select("doc_id", "ids", "n", "at", F.explode(F.sequence(F.expr(f"at div {length}"), F.expr(f"(at + n - 1) div {length}"))).alias("sequence_id"))
    first = F.greatest(F.col("sequence_id") * length - F.col("at"), F.lit(0))
    last = F.least((F.col("sequence_id") + 1) * length - F.col("at"), F.col("n"))
    return (pieces.select("doc_id", "ids", "n", "at", "sequence_id", first.alias("first"), last.alias("last"))
            .select("doc_id", F.col("first").alias("start"), (F.col("last") - F.col("first")).alias("length"),
                    F.expr("substring(ids, cast(first * 4 + 1 as int), cast((last - first) * 4 as int))").alias("ids"),
                    F.col("n").alias("doc_tokens"), "sequence_id", F.expr(f"(at + first) % {length}").alias("offset")))


def piece_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
