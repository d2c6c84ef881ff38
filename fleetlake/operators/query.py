"""Filters, search and paging over work-order DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import search_blob


def active_faults(df: DataFrame, done_col: str = "completion_date") -> DataFrame:
    """faults without a completion date."""
    return df.where(F.col(done_col).isNull())


def vehicle_history(df: DataFrame, vehicle_id: str, id_col: str = "vehicle_id",
                    order=("date", "row_ix")) -> DataFrame:
    """rows whose vehicle identifier starts with ``vehicle_id``, by date."""
    return df.where(F.col(id_col).startswith(vehicle_id)).orderBy(*order)


def faults_by_category(df: DataFrame, category: str, col: str = "category") -> DataFrame:
    """exact match on the Cat code."""
    return df.where(F.col(col) == category)


def faults_by_severity(df: DataFrame, severity: str, col: str = "severity") -> DataFrame:
    """exact match on the derived severity."""
    return df.where(F.col(col) == severity)


def table_search(df: DataFrame, q: str, cols=None) -> DataFrame:
    """case-insensitive substring search over all (or given) columns."""
    cols = cols or df.columns
    return df.where(search_blob(cols).contains(q.lower()))


def table_page(df: DataFrame, page: int, size: int = 10, order=None, tiebreak: str = "row_ix") -> DataFrame:
    """O1: one page of rows ordered by the first column (then ``tiebreak``).

    Planned as a top-k (``TakeOrderedAndProject`` with offset): each partition
    keeps its best ``(page+1)*size`` rows, no full sort.  For deep pages use
    ``page_after`` (keyset paging) instead.
    """
    order = order or df.columns[0]
    keys = [F.col(order).asc_nulls_first()] + ([F.col(tiebreak).asc()] if tiebreak in df.columns else [])
    return df.orderBy(*keys).offset(page * size).limit(size)


def page_after(df: DataFrame, last_key, last_tiebreak, size: int = 10, order: str | None = None,
               tiebreak: str = "row_ix") -> DataFrame:
    """Keyset page: rows strictly after (last_key, last_tiebreak).  NULL keys
    come first, as in ``table_page``."""
    order = order or df.columns[0]
    later = F.col(order).isNotNull() if last_key is None else F.col(order) > F.lit(last_key)
    tie = F.col(order).eqNullSafe(F.lit(last_key)) & (F.col(tiebreak) > F.lit(last_tiebreak))
    return df.where(later | tie).orderBy(F.col(order).asc_nulls_first(), tiebreak).limit(size)
