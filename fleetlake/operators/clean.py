"""Projection, schema and cleaning operators.

Every function is ``DataFrame -> DataFrame`` (or a Column builder) made of
built-in expressions, so a chain of them collapses into one codegen'd
projection with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import CANONICAL, format_ts, parse_datetime, parse_strict, py_to_spark_pattern
from ..functions.text import keep_alnum, py_split_join, py_strip
from ..spec import KARDEX, FormatSpec, header_ident

# ---------------------------------------------------------------------------
# P1 required columns
# ---------------------------------------------------------------------------


def missing_columns(df: DataFrame, required) -> list[str]:
    """Required header names absent from ``df`` (analysis time, no job)."""
    present = set(df.columns)
    return [name for name in required if header_ident(name) not in present and name not in present]


def require_columns(df: DataFrame, required) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"columns absent: {missing}")
    return df


def missing_columns_per_file(headers: DataFrame, required, files: DataFrame | None = None, key=("path",)) -> DataFrame:
    """Across many files at once: the required names that ``headers`` (``key``
    columns, ``header``) lacks for each row of ``files`` (``missing``: empty
    when complete, all names for a file without any header).  Without
    ``files``, only files that have a header row are listed."""
    names = list(required)
    req = F.array(*[F.lit(n) for n in names])
    have = headers.where(F.col("header").isin(names)).groupBy(*key).agg(F.collect_set("header").alias("_h"))
    found = F.coalesce(F.col("_h"), F.array().cast("array<string>"))
    files = headers.select(*key).distinct() if files is None else files.select(*key)
    return files.join(have, list(key), "left").select(
        *key, F.array_sort(F.array_except(req, found)).alias("missing"))


# ---------------------------------------------------------------------------
# P3 / P5 / P7 canonical naming and schema alignment
# ---------------------------------------------------------------------------


def canonical_rename(df: DataFrame, spec: FormatSpec = KARDEX) -> DataFrame:
    """Header identifiers -> canonical keys; unmapped columns unchanged."""
    mapping = {k: v for k, v in spec.rename_map().items() if k in df.columns}
    return df.withColumnsRenamed(mapping)


def optional_columns(df: DataFrame, spec: FormatSpec = KARDEX, keep=()) -> DataFrame:
    """Project every spec key as text; absent columns become NULL."""
    cols = [F.col(c) for c in keep if c in df.columns]
    for c in spec.columns:
        src = c.key if c.key in df.columns else None
        cols.append((F.col(src).cast("string") if src else F.lit(None).cast("string")).alias(c.key))
    return df.select(*cols)


def typed_projection(df: DataFrame, spec: FormatSpec = KARDEX, keep=()) -> DataFrame:
    """Cast every canonical column to its declared type; unparsable -> NULL.

    The raw text of typed columns is kept as ``<key>_raw``.
    """
    cols = [F.col(c) for c in keep if c in df.columns]
    for c in spec.columns:
        src = F.col(c.key)
        if c.type == "string":
            cols.append(src.alias(c.key))
            continue
        if c.type == "integer":
            typed = int_value(src)
        elif c.type == "float":
            typed = float_value(src)
        else:
            typed = parse_datetime(src)
        cols += [typed.alias(c.key), src.alias(f"{c.key}_raw")]
    return df.select(*cols)


# ---------------------------------------------------------------------------
# Scalar cleaners
# ---------------------------------------------------------------------------


def int_value(c: Column) -> Column:
    """``int(str)``: optional sign and digits, surrounding white space allowed;
    '50000.0' and 'invalid' give NULL (P20)."""
    s = py_strip(c.cast("string"))
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint"))


def float_value(c: Column) -> Column:
    """``float(str)`` or NULL; suffixes and hexadecimal forms are no numbers."""
    s = py_strip(c.cast("string"))
    return F.when(s.rlike(r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"), s.try_cast("double"))


def cost_value(c: Column) -> Column:
    """Cost accessor: float, NULL or invalid -> 0.0."""
    v = float_value(c)
    return F.coalesce(v, F.lit(0.0))


def amount_or_zero(c: Column) -> Column:
    """``to_numeric(errors='coerce').fillna(0)``: NaN counts as missing."""
    v = float_value(c)
    return F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.lit(0.0))


def completion_ts(c: Column) -> Column:
    """Strict ``%Y-%m-%d %H:%M:%S`` parse, else NULL."""
    return parse_strict(c, CANONICAL)


def clean_work_order_expr(c: Column) -> Column:
    """Strict clean: drop every non-alphanumeric character."""
    return keep_alnum(c)


def trim_work_order_expr(c: Column) -> Column:
    """Light clean: text with its ends stripped."""
    return py_strip(c.cast("string"))


def collapse_description(c: Column) -> Column:
    """Collapse white space; '' and NULL are left alone."""
    return F.when(c.isNull() | (c == ""), c).otherwise(py_split_join(c))


def fill_strip(c: Column) -> Column:
    """NULL -> '' then strip."""
    return py_strip(F.coalesce(c.cast("string"), F.lit("")))


# ---------------------------------------------------------------------------
# DataFrame-level cleaning steps
# ---------------------------------------------------------------------------


def clean_work_order(df: DataFrame, col: str = "work_order") -> DataFrame:
    return df.withColumn(col, clean_work_order_expr(F.col(col)))


def trim_work_order(df: DataFrame, col: str = "work_order") -> DataFrame:
    return df.withColumn(col, trim_work_order_expr(F.col(col)))


def format_dates(df: DataFrame, col: str = "date", spec: FormatSpec = KARDEX) -> DataFrame:
    """P10: parse text or timestamp and re-emit in the spec's format; rows
    that do not parse get ``invalid_date`` in ``_reject`` (see quarantine)."""
    parsed = parse_datetime(F.col(col))
    out = format_ts(parsed, py_to_spark_pattern(spec.date_format))
    return (df.withColumn("_reject", F.when(out.isNull(), F.lit("invalid_date")))
              .withColumn(col, out))


def coerce_dates(df: DataFrame, col: str = "date", spec: FormatSpec = KARDEX) -> DataFrame:
    """Unparsable -> NULL, drop those rows, reformat."""
    out = format_ts(parse_datetime(F.col(col)), py_to_spark_pattern(spec.date_format))
    return df.withColumn(col, out).where(F.col(col).isNotNull())


def clean_description(df: DataFrame, col: str = "description") -> DataFrame:
    """P12; the raw value is kept in ``_desc_raw`` for the label guards."""
    if "_desc_raw" not in df.columns:
        df = df.withColumn("_desc_raw", F.col(col))
    return df.withColumn(col, collapse_description(F.col(col)))


def fill_strip_text(df: DataFrame, cols=("description", "status", "category")) -> DataFrame:
    return df.withColumns({c: fill_strip(F.col(c)) for c in cols if c in df.columns})


def coerce_amount(df: DataFrame, col: str = "cost") -> DataFrame:
    return df.withColumn(col, amount_or_zero(F.col(col)))
