"""Row validity, quarantine and null handling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import completion_ts, float_value, int_value

ERROR_CODES = ("missing_work_order", "missing_date", "missing_description", "invalid_cost", "invalid_mileage",
               "invalid_date")


def drop_all_null(df: DataFrame, subset) -> DataFrame:
    """Drop a row only when every listed column is NULL (F1)."""
    return df.dropna(how="all", subset=list(subset))


def row_validity(df: DataFrame) -> DataFrame:
    """F6 as flags: ``is_valid`` and ``errors`` (comma-joined codes, '' when
    valid).  A date must be in the canonical format.  A flag only; rows are not dropped here."""
    def falsy(c):
        return F.col(c).isNull() | (F.col(c) == "")
    checks = [
        F.when(falsy("work_order"), F.lit(ERROR_CODES[0])),
        F.when(falsy("date"), F.lit(ERROR_CODES[1])),
        F.when(~falsy("date") & (completion_ts(F.col("date")).isNull()), F.lit(ERROR_CODES[5])),
        F.when(falsy("description"), F.lit(ERROR_CODES[2])),
        F.when(F.col("cost").isNotNull() & float_value(F.col("cost")).isNull(), F.lit(ERROR_CODES[3])),
        F.when(F.col("mileage").isNotNull() & int_value(F.col("mileage")).isNull(), F.lit(ERROR_CODES[4])),
    ]
    errors = F.concat_ws(",", *checks)
    return df.withColumn("errors", errors).withColumn("is_valid", F.col("errors") == "")


def split_quarantine(df: DataFrame, reason_col: str = "_reject"):
    """(good, rejected) from one plan.  ``rejected`` keeps the row's
    position and the reason; both are lazy filters of the same input."""
    good = df.where(F.col(reason_col).isNull()).drop(reason_col)
    rejected = df.where(F.col(reason_col).isNotNull()).withColumnRenamed(reason_col, "reason")
    return good, rejected
