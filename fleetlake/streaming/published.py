"""Batches that appear all at once.

A micro-batch writes several outputs, each into a ``batch=<id>`` folder of its
own.  Its last step puts one small file, ``_published/<id>``, in place by a
rename, which file systems do as one step.  Readers follow these files and see
either all outputs of a batch or none.  A batch that was cut off is written
again in full by the restarted stream, over its own folders.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "_published"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def batch_path(out: str, part: str, batch_id: int) -> str:
    return f"{out}/{part}/batch={batch_id}"


def publish(spark: SparkSession, out: str, batch_id: int, parts: list[str], once: bool = False, **facts) -> None:
    """Make the outputs ``parts`` of a batch visible, with ``facts`` about it.
    Again for the same batch changes nothing; with ``once`` it is an error, as
    then another writer has taken the number."""
    final, fs = _files(spark, f"{out}/{FOLDER}/{batch_id}")
    if fs.exists(final):
        if once:
            raise FileExistsError(f"batch {batch_id} of {out} is published already")
        return
    made, _ = _files(spark, f"{out}/{FOLDER}/.{batch_id}-{uuid.uuid4().hex}")
    stream = fs.create(made, True)
    stream.write(bytearray(json.dumps({"batch": batch_id, "parts": parts, **facts}).encode()))
    stream.close()
    if not fs.rename(made, final):
        fs.delete(made, False)
        if once or not fs.exists(final):
            raise OSError(f"cannot publish batch {batch_id} of {out}")


def published(spark: SparkSession, out: str) -> list[int]:
    """Ids of the finished batches, in order: one small file name each."""
    folder, fs = _files(spark, f"{out}/{FOLDER}")
    if not fs.exists(folder):
        return []
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if not f.getPath().getName().startswith("."))


def facts_of(spark: SparkSession, out: str, batch_id: int) -> dict:
    """What ``publish`` was told about a batch."""
    at, fs = _files(spark, f"{out}/{FOLDER}/{batch_id}")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def read_published(spark: SparkSession, out: str, part: str, schema: str | None = None) -> DataFrame:
    """The output ``part`` of all finished batches, with the column ``batch``.
    Without one, no rows if the ``schema`` is given, else an error."""
    ids = published(spark, out)
    if not ids:
        if schema is None:
            raise FileNotFoundError(f"no batch of {out} is finished")
        return spark.createDataFrame([], schema + ", batch long")
    # folders, not their files, are named: the scan lists them in parallel
    reader = spark.read.option("basePath", f"{out}/{part}")
    return (reader.schema(schema + ", batch long") if schema else reader).parquet(*[batch_path(out, part, i) for i in ids])
