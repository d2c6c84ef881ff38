"""Sinks (K1-K4): the fault table, exports and records as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_fault_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                      partition_by=("vehicle_type",)) -> None:
    """K1: write work orders partitioned by vehicle type, so later reads of
    one vehicle type prune to its folder.  ``fmt='csv'`` writes a header."""
    w = df.write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def export_table(df: DataFrame, path: str) -> None:
    """K2: the visible table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def records_json(df: DataFrame, cols=None, keep=()) -> DataFrame:
    """K3: one JSON object per row (NULL fields kept as ``null``), beside the
    columns ``keep``."""
    cols = cols or df.columns
    return df.select(*keep, F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))
