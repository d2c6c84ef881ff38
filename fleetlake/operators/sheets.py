"""Operators over the workbook cell table.

Cell table: ``path, sheet_ix, sheet_name, row_ix, col_ix, cell_type, value``;
blank cells are absent and every sheet has one marker cell
(``cell_type='sheet'``) so empty sheets are still listed.

Scale notes.  Cells are the widest data here (one row per filled cell), so
each operator filters cells first (pushed to the scan when the table is
parquet) and shuffles rows, never cells, where it can: the pivot groups cells
into one map per sheet row (bounded by the sheet's column count) and joins the
per-sheet places of the known headers (one small row per sheet) on the sheet
key.  Per-sheet outputs are one row per sheet.  No step gathers a whole sheet
into one value, and none sorts all cells for a text that few of them have.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..spec import GENERIC_BODY_START_ROW, GENERIC_VEHICLE_TYPE_CELL, KARDEX, FormatSpec

SHEET_KEY = ["path", "sheet_ix", "sheet_name"]


def ident_expr(c: Column) -> Column:
    """Column expression twin of ``spec.header_ident``."""
    low = F.lower(py_strip(c))
    return F.regexp_replace(F.regexp_replace(low, "[^0-9a-z]+", "_"), "^_+|_+$", "")


def real_cells(cells: DataFrame) -> DataFrame:
    """Cells with a value: neither sheet markers nor parser errors."""
    return cells.where(~F.col("cell_type").isin("sheet", "error"))


def sheet_list(cells: DataFrame) -> DataFrame:
    """One row per sheet, including empty ones (from the marker cells)."""
    return cells.where(F.col("cell_type") == "sheet").select(*SHEET_KEY)


def greatest_text(cells: DataFrame, group: list[str], text: Column, out: str, **flags: Column) -> DataFrame:
    """Per group the greatest ``text``, which few cells have, as ``out``, and the
    greatest of each flag.

    The greatest text of a group needs all its cells sorted.  Counting the cells
    of each different text is a hash table of some rows in each task; the counts
    keep the two steps apart, which Spark would make one again."""
    few = cells.groupBy(*group, text.alias(out)).agg(*[F.max(c).alias(n) for n, c in flags.items()], F.count(F.lit(1)).alias("_n"))
    return few.groupBy(*group).agg(*[F.max(n).alias(n) for n in flags], F.max(F.when(F.col("_n") > 0, F.col(out))).alias(out))


# ---------------------------------------------------------------------------
# S4 / S5 header discovery and format detection
# ---------------------------------------------------------------------------


def header_discovery(cells: DataFrame, marker: str = "WO No") -> DataFrame:
    """Per workbook: the first sheet (in sheet order) having a cell whose text
    contains ``marker`` and, in it, the first such row."""
    hits = real_cells(cells).where(F.col("value").contains(marker))
    first = hits.groupBy("path").agg(F.min(F.struct("sheet_ix", "row_ix", "sheet_name")).alias("m"))
    return first.select("path", F.col("m.sheet_ix").alias("sheet_ix"),
                        F.col("m.sheet_name").alias("sheet_name"),
                        F.col("m.row_ix").alias("header_row"))


def detect_format(cells: DataFrame, marker: str = "WO No", format_name: str = "kardex") -> DataFrame:
    """Per workbook: ``format`` (or NULL) and ``reason`` when undetected or
    unreadable (error cells emitted by the parser)."""
    agg = greatest_text(cells, ["path"], F.when(F.col("cell_type") == "error", F.col("value")), "err",
                        found=F.coalesce(F.col("value").contains(marker) & (F.col("cell_type") != "error"), F.lit(False)))
    return agg.select(
        "path",
        F.when(F.col("found"), F.lit(format_name)).alias("format"),
        F.when(F.col("err").isNotNull(), F.concat(F.lit("unreadable workbook: "), F.col("err")))
        .when(~F.col("found"), F.lit("no registered format matches"))
        .alias("reason"),
    )


# ---------------------------------------------------------------------------
# S2 / S3 / S8 headed-sheet read (cells -> rows)
# ---------------------------------------------------------------------------


def header_cells(cells: DataFrame, header_row: int) -> DataFrame:
    """Trimmed header texts (P2) of each sheet at ``header_row``."""
    return (real_cells(cells).where(F.col("row_ix") == header_row)
            .select(*SHEET_KEY, "col_ix", py_strip(F.col("value")).alias("header")))


def sheet_pivot(cells: DataFrame, spec: FormatSpec = KARDEX, header_row: int | None = None,
                sheets=None, drop_first_record: bool = False, sheet_ix: int | None = None,
                first_rows: int | None = None) -> DataFrame:
    """Rows of each sheet under its header row, one column per known header.

    Output: ``path, sheet_ix, sheet_name, row_ix`` + one column per spec column,
    named by its header identifier.  Cells under unknown headers are dropped;
    sheets without a header row yield nothing.  Of several cells at one place
    the one with the least text counts.  ``drop_first_record``
    reproduces the variant that skipped the first record under the header.
    ``sheet_ix`` reads the sheet at one position only.  ``first_rows`` keeps
    the first rows of each sheet below its header: their cells are picked before
    they are shuffled, by a group limit in every task.
    """
    hr = spec.header_row if header_row is None else header_row
    base = real_cells(cells)
    if sheets is not None:
        base = base.where(F.col("sheet_name").isin(list(sheets)))
    if sheet_ix is not None:
        base = base.where(F.col("sheet_ix") == sheet_ix)
    hdr = (header_cells(base, hr)
           .withColumn("h", ident_expr(F.col("header")))
           .groupBy(*SHEET_KEY, "h").agg(F.min("col_ix").alias("col_ix"))   # first of duplicate names
           .groupBy(*SHEET_KEY).agg(F.map_from_entries(F.collect_list(F.struct("h", "col_ix"))).alias("hmap"))
           .select(*SHEET_KEY, F.array(*[F.try_element_at(F.col("hmap"), F.lit(c.ident)) for c in spec.columns]).alias("places")))
    body = base.where(F.col("row_ix") > hr)
    if first_rows is not None:
        nth = F.dense_rank().over(Window.partitionBy(*SHEET_KEY).orderBy("row_ix"))
        body = body.withColumn("_nth", nth).where(F.col("_nth") <= first_rows + int(drop_first_record)).drop("_nth")
    body = (body.groupBy(*SHEET_KEY, "row_ix")
            .agg(F.sort_array(F.collect_list(F.struct("col_ix", "value"))).alias("_cells"))
            .withColumn("rmap", F.map_from_entries(F.filter(
                "_cells", lambda x, i: (i == 0) | (F.get("_cells", i - 1)["col_ix"] != x["col_ix"]))))
            .drop("_cells"))
    if drop_first_record:
        first = body.groupBy(*SHEET_KEY).agg(F.min("row_ix").alias("_first"))
        body = body.join(first, SHEET_KEY).where(F.col("row_ix") != F.col("_first")).drop("_first")
    joined = body.join(hdr, SHEET_KEY, "inner")
    cols = [F.try_element_at(F.col("rmap"), F.col("places")[i]).alias(c.ident) for i, c in enumerate(spec.columns)]
    return joined.select(*SHEET_KEY, "row_ix", *cols)


def sheet_subset(cells: DataFrame, spec: FormatSpec = KARDEX, sheets=None) -> DataFrame:
    """Configured sheets only, tagged ``vehicle_type`` = sheet name."""
    rows = sheet_pivot(cells, spec, sheets=spec.sheets if sheets is None else sheets)
    return rows.withColumn("vehicle_type", F.col("sheet_name"))


def stack_sheets(frames) -> DataFrame:
    """Stack prepared frames by column name; missing columns -> NULL;
    duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack_layouts(rows: DataFrame, layouts: dict[str, list[str] | None], keep=("path", "sheet_name", "row_ix")) -> DataFrame:
    """U1 in one pass over the rows of many sheets: those named by ``layouts``,
    with NULL in the columns that a sheet's layout lacks (None: it has all)."""
    columns = [c for c in rows.columns if c not in (*SHEET_KEY, "row_ix")]
    lacking = {c: [s for s, have in layouts.items() if have is not None and c not in have] for c in columns}
    return rows.where(F.col("sheet_name").isin(list(layouts))).select(
        *keep, *[F.when(~F.col("sheet_name").isin(lacking[c]), F.col(c)).alias(c) if lacking[c] else F.col(c) for c in columns])


# ---------------------------------------------------------------------------
# S6 / S7 positional layout of the generic stacker
# ---------------------------------------------------------------------------


def sheet_vehicle_type(cells: DataFrame, cell=GENERIC_VEHICLE_TYPE_CELL) -> DataFrame:
    """Per sheet: the text at ``cell`` (row, col), stripped; 'Unknown' when
    blank or not text.  Empty sheets get no row."""
    r, c = cell
    at = (F.col("row_ix") == r) & (F.col("col_ix") == c)
    picked = greatest_text(real_cells(cells), SHEET_KEY, F.when(at & (F.col("cell_type") == "str"), F.col("value")), "v")
    return picked.select(*SHEET_KEY, F.coalesce(py_strip(F.col("v")), F.lit("Unknown")).alias("vehicle_type"))


def sheet_body(cells: DataFrame, body_start: int = GENERIC_BODY_START_ROW,
               cell=GENERIC_VEHICLE_TYPE_CELL) -> DataFrame:
    """S7 + P6: body cells (``row_ix >= body_start``) tagged with the sheet's
    vehicle type and name."""
    body = real_cells(cells).where(F.col("row_ix") >= body_start)
    r, c = cell   # one cell a sheet: a side that AQE can broadcast by its size
    at = (real_cells(cells).where((F.col("row_ix") == r) & (F.col("col_ix") == c) & (F.col("cell_type") == "str"))
          .groupBy(*SHEET_KEY).agg(F.max("value").alias("_v")))
    return body.join(at, SHEET_KEY, "left").select(
        "path", "sheet_name", F.coalesce(py_strip(F.col("_v")), F.lit("Unknown")).alias("vehicle_type"),
        "row_ix", "col_ix", "value")


# ---------------------------------------------------------------------------
# A8 / A9 / A10 per-sheet counts, shares, ingest summary
# ---------------------------------------------------------------------------


def sheet_counts(cells: DataFrame, body_start: int = GENERIC_BODY_START_ROW) -> DataFrame:
    """Records per sheet of the generic stacker.

    ``status``: ``empty`` (no cells, n = 0), ``error`` (parser error, n NULL),
    ``no_body`` (nothing at or below ``body_start``, n NULL), ``ok``.  A
    workbook that cannot be read has one ``error`` row without a sheet.
    One aggregation: a sheet's marker is a cell of its own.
    """
    real = ~F.col("cell_type").isin("sheet", "error")
    j = cells.groupBy(*SHEET_KEY).agg(
        F.count_distinct(F.when(real & (F.col("row_ix") >= body_start), F.col("row_ix"))).alias("body_rows"),
        F.count_if(real).alias("n_cells"),
        F.max((F.col("cell_type") == "error").cast("int")).alias("has_error"),
    )
    status = (F.when(F.col("has_error") == 1, F.lit("error"))
              .when(F.col("n_cells") == 0, F.lit("empty"))
              .when(F.col("body_rows") == 0, F.lit("no_body"))
              .otherwise(F.lit("ok")))
    n = F.when(status == "empty", F.lit(0).cast("long")).when(status == "ok", F.col("body_rows").cast("long"))
    return j.select(*SHEET_KEY, n.alias("n"), status.alias("status"))


def sheet_share(counts: DataFrame) -> DataFrame:
    """Each sheet's records as a percentage of its workbook's total
    (sheets with a count only); NULL when the total is 0."""
    have = counts.where(F.col("n").isNotNull())
    total = F.sum("n").over(Window.partitionBy("path"))
    return have.select("path", "sheet_name", "n",
                       F.when(total > 0, F.round(F.col("n") * 100.0 / total, 4).cast("decimal(10,4)")).alias("share_pct"))


def ingest_summary(counts: DataFrame) -> DataFrame:
    """A10: per workbook the number of sheets (all, even empty) and rows; an
    unreadable workbook has none of either."""
    return counts.groupBy("path").agg(
        F.count("sheet_name").alias("total_sheets"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_rows"),
    )


# ---------------------------------------------------------------------------
# S10 / S11 / S12 / S13 / S14 file flags, previews and listings
# ---------------------------------------------------------------------------


def fault_file_flag(cells: DataFrame, required, header_row: int = 0, sheet_ix: int = 0) -> DataFrame:
    """Per workbook, True when the header row of its first sheet holds
    every required column name; unreadable files count as False."""
    hdr = header_cells(cells.where(F.col("sheet_ix") == sheet_ix), header_row).select("path", "header")
    files = cells.select("path").distinct()
    req = F.array(*[F.lit(n) for n in required])
    per = hdr.groupBy("path").agg(F.collect_set("header").alias("h"))
    return files.join(per, "path", "left").select(
        "path", F.coalesce(F.size(F.array_except(req, F.coalesce(F.col("h"), F.array().cast("array<string>")))) == 0,
                           F.lit(False)).alias("is_fault_data"))


def load_status(cells: DataFrame, required, header_row: int = 3, sheet_ix: int = 0) -> DataFrame:
    """Per workbook ``success`` and ``message`` of a fault-table load
    (first sheet, header at ``header_row``, every required column present)."""
    hdr = header_cells(cells.where(F.col("sheet_ix") == sheet_ix), header_row)
    req = F.array(*[F.lit(n) for n in required])
    per = hdr.groupBy("path").agg(F.collect_set("header").alias("h"))
    errs = greatest_text(cells, ["path"], F.when(F.col("cell_type") == "error", F.col("value")), "err")
    j = errs.join(per, "path", "left")
    missing = F.array_sort(F.array_except(req, F.coalesce(F.col("h"), F.array().cast("array<string>"))))
    miss_text = F.concat(F.lit("["), F.array_join(F.transform(missing, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    return j.select(
        "path",
        (F.col("err").isNull() & (F.size(missing) == 0)).alias("success"),
        F.when(F.col("err").isNotNull(), F.concat(F.lit("unreadable workbook: "), F.col("err")))
        .when(F.size(missing) > 0, F.concat(F.lit("columns absent: "), miss_text))
        .otherwise(F.lit("loaded")).alias("message"),
    )


def raw_preview(cells: DataFrame, n: int = 10, sheet_ix: int = 0) -> DataFrame:
    """Non-blank cells of the first ``n`` rows of the first sheet."""
    return (real_cells(cells).where((F.col("sheet_ix") == sheet_ix) & (F.col("row_ix") < n)
                                    & F.col("value").isNotNull())
            .select("path", "row_ix", "col_ix", "value"))


def sheet_columns(cells: DataFrame, header_row: int = 3) -> DataFrame:
    """Per sheet the header names in column order (bounded by the
    sheet's column count), joined with ' | '."""
    hdr = header_cells(cells, header_row)
    return hdr.groupBy("path", "sheet_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_ix", "header"))),
                                 lambda x: x["header"]), " | ").alias("columns"),
        F.count(F.lit(1)).alias("n_columns"))


def sheet_sample(rows: DataFrame, n: int = 4, columns=None) -> DataFrame:
    """The first ``n`` rows of each sheet, unpivoted to non-null
    ``(column, value)`` pairs.  ``row_number() <= n`` is planned with a
    per-partition group limit before the shuffle, so a sheet never travels
    whole to one task."""
    w = Window.partitionBy("path", "sheet_name").orderBy("row_ix")
    first = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    cols = columns or [c for c in rows.columns if c not in ("path", "sheet_ix", "sheet_name", "row_ix")]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return (first.select("path", "sheet_name", "row_ix", F.inline(pairs))
            .where(F.col("value").isNotNull()))
