"""Statistics that merge.

Each file's work orders are reduced once to a state: counts, exact sums, a
sketch of its locations, and counts of values in long form.  States are stored
in batches that appear at once; a new file costs its own rows only.  A file that
comes again replaces its earlier state.  Reading merges the states, one row per
file and one per (file, dimension, value).

All numbers equal those of ``operators.stats`` on the rows, but for distinct
locations: these are estimated from merged sketches, with a relative standard
error of about 1.04 / sqrt(2 ** LG_K), 1.6 %; a few dozen are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.published import batch_path, publish, published, read_published
from .stats import MONEY, _num

LG_K = 12
SCALARS = (f"file string, total_records long, active_faults long, high_severity_faults long, locations binary, mileage_sum {MONEY}, mileages long, "
           f"intercost {MONEY}, intercosts long, custcost {MONEY}, custcosts long")
VALUES = "file string, dimension string, value string, n long"
DIMENSIONS = {"categories": "category", "complaints_by_type": "nature_of_complaint", "fault_categories": "fault_category_kw"}


def scalar_states(rows: DataFrame, file_col: str) -> DataFrame:
    """One row per file (``SCALARS``).  A sum that overflows is NULL, and so is
    everything merged from it; ``..s`` counts what was summed."""
    money = lambda c: _num(c, MONEY)
    # hundredths are kept
    mileage = _num("mileage", "double").cast(MONEY)
    return rows.groupBy(F.coalesce(F.col(file_col), F.lit("")).alias("file")).agg(
        F.count("*").alias("total_records"), F.count_if(F.col("completion_date").isNull()).alias("active_faults"), F.count_if(F.col("severity") == "high").alias("high_severity_faults"),
        F.hll_sketch_agg("location", F.lit(LG_K)).alias("locations"), F.try_sum(mileage).cast(MONEY).alias("mileage_sum"), F.count(mileage).alias("mileages"),
        F.try_sum(money("interco_amount")).cast(MONEY).alias("intercost"), F.count(money("interco_amount")).alias("intercosts"),
        F.try_sum(money("cost")).cast(MONEY).alias("custcost"), F.count(money("cost")).alias("custcosts"))


def value_states(rows: DataFrame, file_col: str, dims: dict[str, str] = DIMENSIONS) -> DataFrame:
    """Counts per file, dimension and value (``VALUES``); NULL values are not counted."""
    pairs = F.array(*[F.struct(F.lit(name).alias("dimension"), F.col(c).cast("string").alias("value")) for name, c in dims.items()])
    long = rows.select(F.coalesce(F.col(file_col), F.lit("")).alias("file"), F.inline(pairs))
    return long.where("value is not null").groupBy("file", "dimension", "value").agg(F.count("*").alias("n"))


def store(rows: DataFrame, folder: str, file_col: str, dims: dict[str, str] = DIMENSIONS) -> int:
    """Add the states of the files in ``rows``; returns the batch's number."""
    spark = rows.sparkSession
    batch = max(published(spark, folder), default=-1) + 1
    scalar_states(rows, file_col).write.mode("overwrite").parquet(batch_path(folder, "scalars", batch))
    value_states(rows, file_col, dims).write.mode("overwrite").parquet(batch_path(folder, "values", batch))
    publish(spark, folder, batch, ["scalars", "values"], once=True)
    return batch


def _latest(states: DataFrame, scalars: DataFrame) -> DataFrame:
    """The states of the batch in which each file came last."""
    return states.join(scalars.groupBy("file").agg(F.max("batch").alias("batch")), ["file", "batch"])


def merged(spark: SparkSession, folder: str) -> DataFrame:
    """A1-A5 and A11 as one row, from the states of all files.  Sums are 0 where
    there is nothing to sum and NULL where they overflow."""
    states = read_published(spark, folder, "scalars", SCALARS)
    rows = _latest(states, states)
    total = lambda c: F.when(F.count_if(F.col(c).isNull() & (F.col(c + "s") > 0)) == 0, F.coalesce(F.try_sum(c), F.when(F.coalesce(F.sum(c + "s"), F.lit(0)) == 0, F.lit(0)))).cast(MONEY)
    return rows.agg(
        F.coalesce(F.sum("total_records"), F.lit(0)).alias("total_records"), F.coalesce(F.sum("active_faults"), F.lit(0)).alias("active_faults"),
        F.coalesce(F.sum("high_severity_faults"), F.lit(0)).alias("high_severity_faults"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("locations", F.lit(False))), F.lit(0)).alias("unique_locations"),
        F.when(F.sum("mileages") > 0, F.round(F.try_sum("mileage_sum").cast("double") / F.sum("mileages"), 4)).cast("decimal(20,4)").alias("avg_mileage"),
        total("intercost").alias("total_intercost"), total("custcost").alias("total_custcost"))


def merged_values(spark: SparkSession, folder: str) -> DataFrame:
    """``dimension, value, n`` over all files."""
    rows = _latest(read_published(spark, folder, "values", VALUES), read_published(spark, folder, "scalars", SCALARS))
    return rows.groupBy("dimension", "value").agg(F.sum("n").alias("n"))


def record(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics record in long form, ``measure, value, amount``: one
    row per scalar (value NULL) and one per counted value."""
    one = merged(spark, folder)
    scalars = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.lit(None).cast("string").alias("value"), F.col(c).cast("decimal(38,4)").alias("amount")) for c in one.columns])))
    return scalars.unionByName(merged_values(spark, folder).select(F.col("dimension").alias("measure"), "value", F.col("n").cast("decimal(38,4)").alias("amount")))
