"""Byte-level BPE with ``tiktoken`` and a local rank file.

``tiktoken`` splits a text by a pattern and merges each match by itself.  Its
matcher keeps a place to go back to for every blank of a run of white space, so
a long run ends in a panic.  Long texts are therefore cut beforehand, where the
pattern always ends a match: between a character that is no white space and one
that is.  A long run of white space is, but for its last character, one match
of its own and is merged without the matcher.

Ids are little-endian unsigned 32-bit integers in a binary column.  They decode
to raw bytes: a token may end inside of a character.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlake.session import ship_code

#: Characters after which a text may be cut, and blanks that make a run long: results do not depend on either.
PART, RUN = 100_000, 1_000
#: Characters or bytes that are Python objects at once, unless one text is longer.
AT_ONCE = 4_000_000
#: The code points of the pattern's white-space class.
WHITE = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: \S leaves out everything that is white space to either matcher.
CUT = re.compile(r"(?<=\S)(?=[\t\n\x0b\x0c\r ])")
BLANKS = re.compile(f"[{WHITE}]{{{RUN},}}")


class Codec:
    """Encoder and decoder for the text of a rank file."""

    def __init__(self, ranks: str, pattern: str) -> None:
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in map(str.split, ranks.splitlines())}
        self.matches = tiktoken.Encoding("matches", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.one = tiktoken.Encoding("one", pat_str="(?s:.+)", mergeable_ranks=table, special_tokens={})

    def _part(self, text: str) -> Iterator[list[int]]:
        at = 0
        while len(text) - at > PART and (cut := CUT.search(text, at + PART)):
            yield self.matches.encode_ordinary(text[at : cut.start()])
            at = cut.start()
        yield self.matches.encode_ordinary(text[at:])

    def encode(self, text: str) -> bytes:
        ids, at = array("I"), 0
        for run in BLANKS.finditer(text) if len(text) > RUN else ():
            # the last blank before a word belongs to the word, or stands alone
            end = run.end() if run.end() == len(text) else run.end() - 1
            for some in self._part(text[at : run.start()]):
                ids.extend(some)
            ids.extend(self.one.encode_ordinary(text[run.start() : end]))
            at = end
        for some in self._part(text[at:]):
            ids.extend(some)
        return ids.tobytes()

    def decode(self, ids: bytes) -> bytes:
        return self.matches.decode_bytes(array("I", ids))


def _ranks(spark: SparkSession, ranks_path: str) -> Broadcast:
    """The text of the rank file, as large as the vocabulary whatever the input."""
    ship_code()
    with open(ranks_path, encoding="ascii") as f:
        return spark.sparkContext.broadcast(f.read())


def _with_column(rows: DataFrame, name: str, size: Column, made: Callable[[Codec, pa.RecordBatch], list], ranks_path: str, pattern: str, without: str = "") -> DataFrame:
    """``rows`` with a binary column that a codec makes, and not the column
    ``without``.  Only slices with ``AT_ONCE`` of ``size`` become Python objects
    at once."""
    ranks = _ranks(rows.sparkSession, ranks_path)
    stay = [f for f in rows.schema.fields if f.name != without]
    names = [f.name for f in stay]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, pattern)
        for batch in batches:
            part = np.cumsum(batch["_size"].to_numpy(zero_copy_only=False)) // AT_ONCE
            bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for first, last in zip(bounds, bounds[1:]):
                some = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*[some[c] for c in names], pa.array(made(codec, some), pa.binary())], [*names, name])

    return rows.withColumn("_size", size.cast("long")).mapInArrow(run, T.StructType([*stay, T.StructField(name, T.BinaryType())]))


def encode(docs: DataFrame, keep: Column, ranks_path: str, pattern: str) -> DataFrame:
    """(kept_as, ids) for each row: ``keep`` and the ids of the whole text.

    Null and empty texts have no ids.  Strings of special tokens are ordinary
    text.  Repeated rows are encoded one by one, other columns are not read, an
    empty table gives no row.  A text of any length is encoded as a whole: its
    parts only bound what the matcher sees at once."""
    rows = docs.select(keep.alias("kept_as"), F.coalesce("text", F.lit("")).alias("text"))
    return _with_column(rows, "ids", F.length("text"), lambda codec, part: [codec.encode(t) for t in part["text"].to_pylist()], ranks_path, pattern, "text")


def decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``tokens`` with the column ``bytes``: what its ``ids`` stand for.  Null
    ids stay null, no ids are no bytes, and an id that the rank file lacks is
    an error."""
    return _with_column(tokens, "bytes", F.coalesce(F.octet_length("ids"), F.lit(0)), lambda codec, part: [None if x is None else codec.decode(x) for x in part["ids"].to_pylist()], ranks_path, pattern)


def codec_query(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    rows = decode(encode(docs, F.col("doc_id"), ranks_path, pattern), ranks_path, pattern)
    return rows.select(F.col("kept_as").alias("doc_id"), F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
