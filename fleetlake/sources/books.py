"""Real workbooks made from the driver tables.

Each range of order keys becomes one ``.xlsx`` file with three sheets, written
in its own Spark task and kept as ``path, content`` rows, the shape in which
``binaryFile`` gives files.  Cells have every type that the reader knows.  Of
eight books one is no zip file, one has a sheet that breaks off, and one has
another layout.  The zip writer is a small helper for test data.
"""

from __future__ import annotations

import io
import zipfile
from datetime import datetime
from typing import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_code, table

ORDERS_PER_BOOK = 1500
SHEETS = ("F", "O", "P")
HEADERS = ("WO No", "Open Date", "Customer", "Job Description", "Urgent")
OTHER_HEADERS = ("Ticket", "Opened", "Client", "Work", "Urgent")
HEADER_ROW, DATA_ROW = 3, 4
KINDS = 8
NO_ZIP, BROKEN_SHEET, OTHER_LAYOUT = 3, 5, 6

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_STYLES = f'<styleSheet xmlns="{_MAIN}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>'


class _Strings:
    """Texts that the sheets of a book share, numbered as they come."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}

    def cell(self, ref: str, text: str) -> str:
        return f'<c r="{ref}" t="s"><v>{self.numbers.setdefault(text, len(self.numbers))}</v></c>'

    def xml(self) -> str:
        return f'<sst xmlns="{_MAIN}">' + "".join(f"<si><t>{escape(t)}</t></si>" for t in self.numbers) + "</sst>"


def _row(number: int, order, strings: _Strings) -> str:
    n = number + 1
    opened = (order.o_orderdate.to_pydatetime().replace(microsecond=0) - datetime(1899, 12, 30)).total_seconds() / 86400
    customer = f'<c r="C{n}" t="e"><v>#N/A</v></c>' if order.o_orderkey % 97 == 0 else f'<c r="C{n}"><v>{order.o_custkey / 4}</v></c>'
    return (f'<row r="{n}">' + strings.cell(f"A{n}", f"WO-{order.o_orderkey}") + f'<c r="B{n}" s="1"><v>{opened!r}</v></c>' + customer
            + f'<c r="D{n}" t="inlineStr"><is><t>{escape(order.o_orderpriority)}</t></is></c><c r="E{n}" t="b"><v>{int(order.o_orderpriority == "1-URGENT")}</v></c></row>')


def _content(book: int, orders: pd.DataFrame) -> bytes:
    strings, sheets = _Strings(), []
    for name in SHEETS:
        rows = [f'<row r="1">{strings.cell("A1", f"Book {book}")}</row>', f'<row r="{HEADER_ROW + 1}">' + "".join(
            strings.cell(f"{'ABCDE'[i]}{HEADER_ROW + 1}", h) for i, h in enumerate(OTHER_HEADERS if book % KINDS == OTHER_LAYOUT else HEADERS)) + "</row>"]
        some = orders[orders["o_orderstatus"] == name].sort_values("o_orderkey")
        rows += [_row(DATA_ROW + i, o, strings) for i, o in enumerate(some.itertuples(index=False))]
        sheets.append(f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(rows)}</sheetData></worksheet>')
    if book % KINDS == BROKEN_SHEET:
        sheets[1] = sheets[1][: -len("</sheetData></worksheet>")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>' + "".join(
            f'<sheet name="Status {s}" sheetId="{i + 1}" r:id="r{i}"/>' for i, s in enumerate(SHEETS)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(
            f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(SHEETS))) + "</Relationships>")
        z.writestr("xl/styles.xml", _STYLES)
        z.writestr("xl/sharedStrings.xml", strings.xml())
        for i, xml in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{i}.xml", xml)
    content = out.getvalue()
    return content[: len(content) // 2] if book % KINDS == NO_ZIP else content


def books_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content`` of workbooks with all orders, at most
    ``ORDERS_PER_BOOK`` in each."""
    ship_code()
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp_ntz"), "o_orderpriority")

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        book = int(key[0])
        return pd.DataFrame({"path": [f"book_{book}.xlsx"], "content": [_content(book, rows)]})

    return orders.groupBy(F.expr(f"o_orderkey div {ORDERS_PER_BOOK}").alias("book")).applyInPandas(write, "path string, content binary")
