"""Fault statistics, value counts and summaries.

All statistics of one table come from one scan: scalar measures in one
``agg`` (partial + final hash aggregate, a single row), value counts of
several dimensions in one ``GROUPING SETS`` pass (one ``Expand`` + partial
aggregation, so a hot value is pre-aggregated per task before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wide enough that no sum of amounts is cast back to a smaller type.
MONEY = "decimal(38,2)"


def _num(c: str, t: str):
    return F.col(c).cast("string").try_cast(t)


def fault_statistics(df: DataFrame, done_col: str = "completion_date", loc_col: str = "location",
                     mileage_col: str = "mileage", interco_col: str = "interco_amount",
                     cost_col: str = "cost", extra=()) -> DataFrame:
    """A1-A5 as one row.  Sums are exact decimals (0 when all NULL, NULL when
    they overflow); the mean mileage skips NULLs and non-numbers (NULL when
    none)."""
    total = lambda c: F.when(F.count(_num(c, MONEY)) == 0, F.lit(0)).otherwise(F.try_sum(_num(c, MONEY))).cast(MONEY)
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col(done_col).isNull()).alias("active_faults"),
        F.count_distinct(F.col(loc_col)).alias("unique_locations"),
        F.round(F.avg(_num(mileage_col, "double")), 4).cast("decimal(20,4)").alias("avg_mileage"),
        total(interco_col).alias("total_intercost"),
        total(cost_col).alias("total_custcost"),
        *extra,
    )


def value_counts(df: DataFrame, dims: dict[str, str]) -> DataFrame:
    """``(dimension, value, n)`` for several columns in one pass;
    NULL values are not counted.  ``dims`` maps dimension name -> column."""
    names = list(dims)
    gcols = [f"_d{i}" for i in range(len(names))]
    view = df.select(*[F.col(c).cast("string").alias(g) for g, c in zip(gcols, dims.values())])
    agg = view.groupingSets([[g] for g in gcols], *gcols).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(g).alias(f"_g{i}") for i, g in enumerate(gcols)])
    dim = None
    for i, name in enumerate(names):
        cond = F.col(f"_g{i}") == 0
        dim = F.when(cond, F.lit(name)) if dim is None else dim.when(cond, F.lit(name))
    out = agg.select(dim.alias("dimension"), F.coalesce(*[F.col(g) for g in gcols]).alias("value"), "n")
    return out.where(F.col("value").isNotNull())


def top_values(counts: DataFrame, dimension: str) -> DataFrame:
    """O2: one dimension's counts, largest first, ties by value."""
    return counts.where(F.col("dimension") == dimension).orderBy(F.desc("n"), F.asc("value"))


def statistics_record(df: DataFrame, dims: dict[str, str], **kw):
    """The statistics record as (scalars row, long value counts).  The
    per-dimension value->count maps stay in long form: a map of all distinct
    complaint texts would gather an unbounded set into a single row."""
    return fault_statistics(df, **kw), value_counts(df, dims)


def fault_summary(df: DataFrame, done_col: str = "completion_date") -> DataFrame:
    """Total, active and high-severity counts in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total_faults"),
        F.count_if(F.col(done_col).isNull()).alias("active_faults"),
        F.count_if(F.col("severity") == "high").alias("high_severity_faults"),
    )


def fault_record(df: DataFrame, data_type: str = "vehicle_fault", **kw) -> DataFrame:
    """A11 with its statistics: what kind of data it is, the counts of
    ``fault_summary`` and the scalars of ``fault_statistics``, from one scan."""
    high = F.count_if(F.col("severity") == "high").alias("high_severity_faults")
    return fault_statistics(df, extra=(high,), **kw).select(F.lit(data_type).alias("data_type"), "*")


def group_summary(df: DataFrame, keys=("vehicle_type", "severity", "fault_category")) -> DataFrame:
    """Counts and exact cost per label group (the flagship report)."""
    cost = F.coalesce(F.col("cost").cast("string").try_cast(MONEY), F.lit(0).cast(MONEY))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("completion_date").isNull()).alias("open_n"),
        F.try_sum(cost).cast(MONEY).alias("total_cost"),
    )
