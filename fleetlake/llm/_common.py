"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlake.session import ensure_checkpoint_dir, ship_code


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Paths of the tables that ``written`` has made in this process.
made: list[str] = []


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that ``written`` has made and nothing will read again."""
    for path in paths:
        if path in made:
            made.remove(path)
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts the lineage: tasks that are run again read the same rows, so numbers
    that depend on the order of rows stay as they were first written."""
    ship_code()
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/fleetlake-{label}-{uuid.uuid4().hex}"
    made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, group: list[str], order: list[Column], out: str, chunks: int = 4096, cut: Column | None = None) -> DataFrame:
    """Gapless numbers from 0 within each (non-null) ``group``, in a hash order.

    Every group is cut by a hash of ``order`` into ``chunks`` parts that are
    numbered alone and shifted by the counts of the parts before them, so a
    group that holds a third of all rows is still numbered by many tasks.  If
    ``order`` is spread evenly already, ``cut`` can give the parts: numbers
    then follow (cut, order)."""
    here = [F.xxhash64(F.lit(7), *order), *order] if cut is None else order
    parts = df.withColumn("_cut", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int") if cut is None else cut)
    before = (parts.groupBy(*group, "_cut").count()
              .withColumn("_before", F.coalesce(
                  F.sum("count").over(Window.partitionBy(*group).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)),
                  F.lit(0)))
              .drop("count"))
    return (parts.join(before, [*group, "_cut"])
            .withColumn(out, F.col("_before") + F.row_number().over(Window.partitionBy(*group, "_cut").orderBy(*here)) - 1)
            .drop("_cut", "_before"))
