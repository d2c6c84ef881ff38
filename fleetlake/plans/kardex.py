"""The configured work-order pipeline (P23) and the transform registry.

A spec names its transforms; each name maps to a ``DataFrame -> DataFrame``
function.  Applying them in order builds one logical plan that Catalyst
collapses into a single narrow stage: scan -> project (clean, parse, label,
flag) with no shuffle until a statistic asks for one.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, labels, quality
from ..spec import KARDEX, FormatSpec

Transform = Callable[[DataFrame, FormatSpec], DataFrame]

_TRANSFORMS: dict[str, Transform] = {
    "clean_work_order": lambda df, spec: clean.clean_work_order(df),
    "trim_work_order": lambda df, spec: clean.trim_work_order(df),
    "format_dates": lambda df, spec: clean.format_dates(df, spec=spec),
    "coerce_dates": lambda df, spec: clean.coerce_dates(df, spec=spec),
    "clean_description": lambda df, spec: clean.clean_description(df),
    "fill_strip_text": lambda df, spec: clean.fill_strip_text(df),
    "coerce_amount": lambda df, spec: clean.coerce_amount(df),
    "extract_severity_from_description": lambda df, spec: labels.extract_severity(df),
    "extract_component_from_description": lambda df, spec: labels.extract_components(df),
    "classify_fault_category": lambda df, spec: labels.classify_fault_category(df),
    "keyword_fault_category": lambda df, spec: labels.keyword_fault_category(df),
}


def register_transform(name: str, fn: Transform) -> None:
    """Make ``name`` usable in a spec's ``transformations`` list."""
    _TRANSFORMS[name] = fn


def transform_names() -> list[str]:
    return sorted(_TRANSFORMS)


POSITION = ("row_ix", "sheet_name")


def prepare(raw: DataFrame, spec: FormatSpec = KARDEX, keep=POSITION) -> DataFrame:
    """Headed sheet rows -> canonical text columns + ``vehicle_type``.

    Checks the spec's required columns first (analysis time), renames header
    identifiers to keys, adds absent optional columns as NULL.
    """
    clean.require_columns(raw, spec.required_columns)
    df = clean.canonical_rename(raw, spec)
    df = clean.optional_columns(df, spec, keep=keep)
    if "sheet_name" in df.columns:
        df = df.withColumn("vehicle_type", F.col("sheet_name"))
    return df


def apply_transforms(df: DataFrame, spec: FormatSpec = KARDEX) -> DataFrame:
    """Apply the spec's transforms in order; unknown names are ignored."""
    steps = [_TRANSFORMS[t] for t in spec.transformations if t in _TRANSFORMS]
    return reduce(lambda d, step: step(d, spec), steps, df)


def enrich(raw: DataFrame, spec: FormatSpec = KARDEX, keep=POSITION) -> DataFrame:
    """All rows after transforms and validity flags; ``_reject`` holds the
    reason a row cannot be used (NULL for usable rows)."""
    df = apply_transforms(prepare(raw, spec, keep), spec)
    if "_reject" not in df.columns:
        df = df.withColumn("_reject", F.lit(None).cast("string"))
    df = quality.row_validity(df)
    return df.drop("_desc_raw", "_lc", "_lcc")


def quarantine(raw: DataFrame, spec: FormatSpec = KARDEX, keep=POSITION):
    """(good, rejected) work orders from one plan."""
    return quality.split_quarantine(enrich(raw, spec, keep))


def good_work_orders(raw: DataFrame, spec: FormatSpec = KARDEX, keep=POSITION) -> DataFrame:
    """Good rows of the configured pipeline (the flagship plan)."""
    good, _ = quarantine(raw, spec, keep)
    return good
