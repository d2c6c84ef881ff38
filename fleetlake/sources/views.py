"""Work-order data derived from the driver tables.

The driver tables carry no maintenance vocabulary, so keys, dates, places and
money come from ``orders ⋈ customer ⋈ nation ⟕ lineitem`` and the free text is
picked from fixed phrase lists by key arithmetic.  The result has the shape of
a stacked Kardex sheet: one row per work order, columns named by the header
identifiers of the format spec (``"SRR No."`` -> ``srr_no``), every value text
as it would arrive from a workbook, with deliberate dirt (NULLs, punctuation,
unparsable dates and amounts, padded and empty descriptions).

Plan at scale: ``orders`` are joined to ``customer`` on the customer key
(sort-merge, AQE splits a hot key) and to ``nation`` (25 rows, broadcast by AQE's
runtime size check), then dealt by order key into tasks of at most some
``ORDERS_PER_TASK`` and joined to ``lineitem``, aggregated per order in the same
parts.  That join comes last as the work on wide rows follows it: parts behind
another join would be as few as the narrow rows before it fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..spec import KARDEX_COLUMNS

# Fixture phrase lists (our own test vocabulary, indexed by key arithmetic).
DESCRIPTIONS = [
    "  Engine   runs  rough   at  idle  ",
    "Urgent: brake pedal sinks, immediate stop",
    "Routine tire check, swapped front pair",
    "Replace clutch and gearbox oil",
    "Battery dead, starter not working",
    "Shock absorber leak, replace mounting",
    "DPF regen required, check exhaust",
    "Fuel filter service",
    "Radiator overheat, smoke from hose",
    "Power steering rack loose",
    "Tyre breakdown on highway",
    "Cosmetic scratch, polish door panel",
    "Monitor and note cabin odour",
    "Engine knocking when cold",
    "",
    None,
]
DATE_SHAPES = ["2024-01", "2024/01/05", "2024-1-5", "5 Jan 2024", "January 5, 2024", "2024-01-01T09:00:00Z", "2024-01-01 09:00:00.1234567",
               "1/2/2024 5:06 PM", "01-02-2024", "2024-13-05", "1/2/2024 13:06 PM", "Fri, 5th Jan. 2024 17:30:05 +08:00"]
COMPLAINTS = ["Engine hunts at idle", "Brake squeal", "Flat tyre", "Aircon not cold", "Body dent",
              "Horn silent", "Wiper streaks", None]
CATS = ["REPAIR", "SERVICE", "TYREBD", "PDI", None]
# The five market segments stand for the five vehicle-type sheets.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

# Header identifiers of the view, in sheet column order.
WO_COLUMNS = [c.ident for c in KARDEX_COLUMNS]

# Orders in one task, each of which becomes a wide row and some twenty cells.
ORDERS_PER_TASK = 100_000

TS_TEXT = "yyyy-MM-dd HH:mm:ss"


def _pick(values, idx: Column) -> Column:
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (idx + 1).cast("int"))


def work_order_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw work orders: ``row_ix, sheet_name, vehicle_id`` + the 20 sheet columns."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-orders.count() // ORDERS_PER_TASK))  # counted from the file's footers
    items = table(spark, sf_dir, "lineitem")
    if parts > least:  # else the aggregate's own shuffle has as many parts
        items = items.select("l_orderkey", "l_shipdate", "l_extendedprice", "l_quantity").repartition(parts, "l_orderkey")
    lines = (
        items
        .groupBy(F.col("l_orderkey"))
        .agg(
            F.max("l_shipdate").alias("ship"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amt"),
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("qty"),
        )
    )
    # The per-order aggregate grows with the data, so it is never broadcast:
    # a sort-merge join reuses the aggregate's hash partitioning on the order
    # key.  (Left to itself, AQE would broadcast it at small scale and run
    # everything after the single-split ``orders`` scan in one task.)
    # Dealt by the order key at every size, so the text work spreads over all tasks.
    base = (
        orders.join(customer, orders.o_custkey == customer.c_custkey, "inner")
        .join(nation, customer.c_nationkey == nation.n_nationkey, "inner")
        .repartition(parts, "o_orderkey")
    )
    base = base.join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    c = F.col("o_custkey")
    ship_text = F.date_format("ship", TS_TEXT)
    return base.select(
        k.alias("row_ix"),
        F.col("c_mktsegment").alias("sheet_name"),
        F.concat(F.lit("V"), c.cast("string")).alias("vehicle_id"),
        F.when(k % 89 != 0, F.concat(F.when(k % 71 == 0, F.lit("  ")).otherwise(F.lit("")), F.lit("WO-"), k.cast("string"), F.lit("/"), (c % 10).cast("string"))).alias("wo_no"),
        F.col("n_name").alias("loc"),
        F.col("o_orderstatus").alias("st"),
        F.when(k % 11 == 0, F.concat(k.cast("string"), F.lit(".0")))
        .when(k % 13 == 0, F.lit(None).cast("string"))
        .otherwise((k * 7).cast("string")).alias("mileage"),
        F.when(k % 97 == 0, F.lit("invalid_date"))
        .when(k % 101 == 0, F.lit(None).cast("string"))
        .when(k % 103 == 0, F.lit("45291"))
        .when(k % 107 == 0, F.lit("10:30"))
        .when(k % 109 == 0, F.lit("13/02/2024"))
        .when(k % 113 == 0, F.lit(" Jan 5, 2024 "))
        .when(k % 127 == 0, F.lit("1/2/2024 5:06"))
        .when(k % 131 == 0, _pick(DATE_SHAPES, F.floor(k / 131) % len(DATE_SHAPES)))
        .otherwise(F.date_format("o_orderdate", TS_TEXT)).alias("open_date"),
        F.when(F.col("o_orderstatus") != "O", ship_text).alias("done_date"),
        F.when(F.col("o_orderstatus") == "F", ship_text).alias("actual_finish_date"),
        _pick(COMPLAINTS, F.floor((k % 128 - k % 16) / 16)).alias("nature_of_complaint"),
        F.concat(F.lit("F"), F.lpad((k % 50).cast("string"), 3, "0")).alias("fault_codes"),
        _pick(DESCRIPTIONS, k % 16).alias("job_description"),
        F.when(k % 4 != 0, F.concat(F.lit("SRR"), k.cast("string"))).alias("srr_no"),
        F.concat(F.lit("Mechanic "), (c % 20).cast("string")).alias("mechanic_name"),
        F.col("c_custkey").cast("string").alias("customer"),
        F.col("c_name").alias("customer_name"),
        F.when(k % 6 == 0, F.lit("Check brake pads")).alias("recommendation_4_next"),
        _pick(CATS, k % 5).alias("cat"),
        F.concat(F.lit("Lead "), (c % 7).cast("string")).alias("lead_tech"),
        F.concat(F.lit("B"), k.cast("string")).alias("bill_no"),
        F.col("qty").cast("decimal(18,2)").cast("string").alias("intercoamt"),
        F.when(k % 17 == 0, F.lit("n/a")).when(k % 61 == 0, F.lit("100d")).when(k % 67 == 0, F.lit("1e3")).otherwise(F.col("amt").cast("decimal(18,2)").cast("string")).alias("custamt"),
    )


# ---------------------------------------------------------------------------
# Cell table derived from the work-order view
# ---------------------------------------------------------------------------
CELL_SCHEMA = "path string, sheet_ix int, sheet_name string, row_ix bigint, col_ix int, cell_type string, value string"
HEADER_ROW = 3
TITLE_ROW = 0
DATA_START = 4
EMPTY_SHEET = ("Summary", 5)
NO_HEADER_SHEET = ("Notes", 6)


def _segment_ix(seg: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), seg) - 1).cast("int")


def cells_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work-order view as a workbook cell table.

    Four workbooks (``kardex_<k%4>.xlsx``); one sheet per segment with a title
    cell at row 0, the Excel header names at row 3 and one data row per work
    order at row ``4 + k`` (blank cells absent); plus, per workbook, an empty
    sheet and a sheet without a header.  Every sheet has one marker cell
    (``cell_type='sheet'``, row and column -1) so empty sheets are listed.
    """
    wo = work_order_view(spark, sf_dir)
    path = F.concat(F.lit("kardex_"), (F.col("row_ix") % 4).cast("string"), F.lit(".xlsx"))
    rows = wo.select(
        path.alias("path"),
        _segment_ix(F.col("sheet_name")).alias("sheet_ix"),
        "sheet_name",
        (F.col("row_ix") + DATA_START).cast("long").alias("row_ix"),
        F.array(*[F.struct(F.lit(i).alias("col_ix"), F.col(n).alias("value"))
                  for i, n in enumerate(WO_COLUMNS)]).alias("cells"),
    )
    data = (
        rows.select("path", "sheet_ix", "sheet_name", "row_ix", F.inline("cells"))
        .where(F.col("value").isNotNull())
        .select("path", "sheet_ix", "sheet_name", "row_ix", "col_ix", F.lit("str").alias("cell_type"), "value")
    )
    # One row per sheet (tiny), then a fixed set of layout cells per sheet.
    sheets = rows.groupBy("path", "sheet_ix", "sheet_name").agg(F.count(F.lit(1)).alias("n"))
    layout = [F.struct(F.lit(-1).cast("long").alias("row_ix"), F.lit(-1).alias("col_ix"), F.lit("sheet").alias("cell_type"),
                       F.lit(None).cast("string").alias("value")),
              F.struct(F.lit(TITLE_ROW).cast("long").alias("row_ix"), F.lit(0).alias("col_ix"), F.lit("str").alias("cell_type"),
                       F.concat(F.lit("Kardex "), F.col("sheet_name")).alias("value"))]
    layout += [F.struct(F.lit(HEADER_ROW).cast("long").alias("row_ix"), F.lit(i).alias("col_ix"), F.lit("str").alias("cell_type"),
                        F.lit(c.name).alias("value")) for i, c in enumerate(KARDEX_COLUMNS)]
    sheet_cells = sheets.select("path", "sheet_ix", "sheet_name", F.inline(F.array(*layout)))
    # Per workbook: an empty sheet (marker only) and a sheet without a header.
    books = sheets.groupBy("path").agg(F.sum("n").alias("n"))
    extra = [
        F.struct(F.lit(EMPTY_SHEET[1]).alias("sheet_ix"), F.lit(EMPTY_SHEET[0]).alias("sheet_name"),
                 F.lit(-1).cast("long").alias("row_ix"), F.lit(-1).alias("col_ix"), F.lit("sheet").alias("cell_type"),
                 F.lit(None).cast("string").alias("value")),
        F.struct(F.lit(NO_HEADER_SHEET[1]).alias("sheet_ix"), F.lit(NO_HEADER_SHEET[0]).alias("sheet_name"),
                 F.lit(-1).cast("long").alias("row_ix"), F.lit(-1).alias("col_ix"), F.lit("sheet").alias("cell_type"),
                 F.lit(None).cast("string").alias("value")),
        F.struct(F.lit(NO_HEADER_SHEET[1]).alias("sheet_ix"), F.lit(NO_HEADER_SHEET[0]).alias("sheet_name"),
                 F.lit(0).cast("long").alias("row_ix"), F.lit(0).alias("col_ix"), F.lit("str").alias("cell_type"),
                 F.lit("Workshop notes").alias("value")),
        F.struct(F.lit(NO_HEADER_SHEET[1]).alias("sheet_ix"), F.lit(NO_HEADER_SHEET[0]).alias("sheet_name"),
                 F.lit(1).cast("long").alias("row_ix"), F.lit(0).alias("col_ix"), F.lit("str").alias("cell_type"),
                 F.concat(F.lit("Orders in book: "), F.col("n").cast("string")).alias("value")),
    ]
    extra_cells = books.select("path", F.inline(F.array(*extra))).select(
        "path", "sheet_ix", "sheet_name", "row_ix", "col_ix", "cell_type", "value")
    return data.unionByName(sheet_cells).unionByName(extra_cells)


# ---------------------------------------------------------------------------
# Fault log and application log derived from ``events``
# ---------------------------------------------------------------------------
def fault_log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fault_id, vehicle_id, fault_description, severity, timestamp, status``."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return ev.select(
        F.format_string("F%03d", F.col("event_id") + 1).alias("fault_id"),
        F.concat(F.lit("V"), F.col("user_id").cast("string")).alias("vehicle_id"),
        F.col("event_type").alias("fault_description"),
        F.when(F.col("value") < 20, "low").when(F.col("value") < 55, "medium").otherwise("high").alias("severity"),
        F.col("ts").alias("timestamp"),
        F.lit("open").alias("status"),
    )


def app_log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``log_id, ts, message`` from events."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "props")
    return ev.select(
        F.col("event_id").alias("log_id"),
        F.col("ts"),
        F.concat_ws(" ", F.col("event_type"), F.col("props")).alias("message"),
    )


# ---------------------------------------------------------------------------
# Upload names derived from orders (for file admission)
# ---------------------------------------------------------------------------
UPLOAD_SUFFIXES = [".xlsx", ".XLSX", ".pdf", ".txt", ".xls", "", ".xlsx.bak"]


def uploads_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One uploaded file name per order: ``upload_id, name``."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("upload_id"),
        F.concat(F.lit("kardex_"), k.cast("string"), _pick(UPLOAD_SUFFIXES, k % 7)).alias("name"))
