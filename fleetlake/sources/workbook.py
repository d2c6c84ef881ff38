"""Workbook source: ``.xlsx`` files -> cell table.

Files are listed by Spark's ``binaryFile`` source, one record per file, from any
store that Spark can read.  A first pass reads each file's zip directory and
hands on one row per sheet, with the sheet's compressed bytes.  Every sheet is
then a unit of work of its own, read once by a streaming XML reader.  Texts that
sheets share go with each sheet where they are few (``FEW_TEXTS``).  Else they
are a table of their own, joined by their number, so no task needs all of them.

``Limits`` name sheets, rows and columns.  They reach the reader: other sheets
do not leave their file, and reading ends at the last wanted row.

Cell table: ``path, sheet_ix, sheet_name, row_ix, col_ix, cell_type, value``.
``cell_type`` is ``str``, ``num``, ``bool``, ``date`` (ISO text),
``cellerror``, ``sheet`` (one marker per sheet, row/col -1) or ``error``
(the file or sheet could not be read; ``value`` holds the reason).
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_code
from ..spec import ALLOWED_EXTENSIONS, EXCEL_EXTENSIONS
from .views import CELL_SCHEMA

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
_M = "{%s}" % _NS["m"]
# Built-in number formats that display dates/times (ECMA-376 18.8.30).
_DATE_FMT_IDS = set(range(14, 23)) | {45, 46, 47}
_REF = re.compile(r"([A-Z]+)(\d+)")
BATCH = 50_000
#: Compressed bytes of shared texts up to which they go with their sheets; deflate
#: makes at most some 1030 times as much of them.
FEW_TEXTS = 1 << 18
COLUMNS = ["path", "sheet_ix", "sheet_name", "row_ix", "col_ix", "cell_type", "value"]


# ---------------------------------------------------------------------------
# S9 admission
# ---------------------------------------------------------------------------


def admitted(name: Column, allowed=ALLOWED_EXTENSIONS) -> Column:
    """Has a dot and its last suffix, lower-cased, is allowed."""
    ext = F.lower(F.substring_index(name, ".", -1))
    return name.contains(".") & ext.isin(list(allowed))


def is_excel(name: Column) -> Column:
    return admitted(name, EXCEL_EXTENSIONS)


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """File listing without reading contents: ``path, length, admitted``."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
          .load(folder).select("path", "length"))
    return df.withColumn("admitted", admitted(F.col("path")))


# ---------------------------------------------------------------------------
# S1 parsing
# ---------------------------------------------------------------------------


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _is_date_format(code: str) -> bool:
    code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())
    return any(ch in code for ch in "ymdhs") and "general" not in code


def _serial_to_text(v: float, date1904: bool) -> str:
    base = datetime(1904, 1, 1) if date1904 else datetime(1899, 12, 30)
    dt = base + timedelta(days=v)
    dt = dt.replace(microsecond=0) if dt.microsecond < 500_000 else (dt + timedelta(seconds=1)).replace(microsecond=0)
    return dt.strftime("%Y-%m-%d %H:%M:%S")


def _num_text(raw: str) -> str:
    f = float(raw)
    return str(int(f)) if f.is_integer() and abs(f) < 1e16 else repr(f)


@dataclass(frozen=True)
class Limits:
    """What of each workbook is read: sheets by name or by position from 0,
    rows from the first up to the one before the second, columns by position.
    Without a limit all is read."""

    sheets: tuple[str | int, ...] | None = None
    rows: tuple[int, int] | None = None
    columns: frozenset[int] | None = None

    def sheet(self, ix: int, name: str) -> bool:
        return self.sheets is None or ix in self.sheets or name in self.sheets


class _Inflated:
    """A zip member's bytes, inflated as they are read; its checksum is compared
    once the end is reached."""

    def __init__(self, data: bytes, method: int, crc: int) -> None:
        if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise NotImplementedError(f"compression method {method}")
        self.data, self.at, self.crc, self.seen = data, 0, crc, 0
        self.inflate = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None

    def read(self, n: int = 1 << 16) -> bytes:
        out = b""
        while not out:
            if self.inflate is None:
                out, self.at = self.data[self.at : self.at + n], self.at + n
            else:
                # what did not fit the last time comes first
                some = self.inflate.unconsumed_tail
                if not some:
                    some, self.at = self.data[self.at : self.at + n], self.at + n
                if some:
                    out = self.inflate.decompress(some, n)
                if not some:
                    break
            if not out and self.at >= len(self.data):
                break
        self.seen = zlib.crc32(out, self.seen)
        if not out and self.seen != self.crc:
            raise zipfile.BadZipFile("bad checksum")
        return out


def _member(content: bytes, z: zipfile.ZipFile, name: str) -> tuple[bytes, int, int]:
    """Compressed bytes, compression method and checksum of a member."""
    info = z.getinfo(name)
    if info.flag_bits & 1:
        raise NotImplementedError("encrypted member")
    begin = info.header_offset + 30 + sum(struct.unpack("<HH", content[info.header_offset + 26 : info.header_offset + 30]))
    return content[begin : begin + info.compress_size], info.compress_type, info.CRC


STRINGS = "xl/sharedStrings.xml"


def _strings(source) -> Iterator[str]:
    """The texts that sheets share, in the order of their numbers."""
    for _, el in ET.iterparse(source):
        if el.tag == _M + "si":
            yield "".join(t.text or "" for t in el.iter(_M + "t"))
            el.clear()


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.parse(z.open("xl/styles.xml")).getroot()
    custom = {int(n.get("numFmtId")): n.get("formatCode", "") for n in root.iter(_M + "numFmt")}
    dates = set()
    xfs = root.find(_M + "cellXfs")
    for i, xf in enumerate(xfs if xfs is not None else []):
        fid = int(xf.get("numFmtId", "0"))
        if fid in _DATE_FMT_IDS or (fid in custom and _is_date_format(custom[fid])):
            dates.add(i)
    return dates


def _sheets(z: zipfile.ZipFile):
    wb = ET.parse(z.open("xl/workbook.xml")).getroot()
    pr = wb.find(_M + "workbookPr")
    date1904 = pr is not None and pr.get("date1904") in ("1", "true")
    rels = ET.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()
    target = {r.get("Id"): r.get("Target") for r in rels.iter("{%s}Relationship" % _NS["pr"])}
    out = []
    for s in wb.iter(_M + "sheet"):
        t = target[s.get("{%s}id" % _NS["r"])]
        t = t.lstrip("/")
        out.append((s.get("name"), t if t.startswith("xl/") else "xl/" + t))
    return out, date1904


def _sheet_cells(source, dates, date1904: bool, n_strings: int, limits: Limits = Limits()):
    """(row, col, cell type, text, number of the shared text) of a sheet's
    filled cells.  Rows and cells need not name their place; then they follow
    the one before.  Finished rows are detached from the tree, so a sheet of
    any length is read in constant memory."""
    row = col = -1
    first, end = limits.rows or (0, None)
    data = None
    for event, el in ET.iterparse(source, ("start", "end")):
        if event == "start":
            if el.tag == _M + "sheetData":
                data = el
            elif el.tag == _M + "row":
                row, col = int(el.get("r") or row + 2) - 1, -1
                if end is not None and row >= end:
                    return
            continue
        if el.tag == _M + "row" and data is not None:
            data.clear()
        if el.tag != _M + "c":
            continue
        m = _REF.fullmatch(el.get("r", ""))
        if m:
            col, row = _col_index(m.group(1)), int(m.group(2)) - 1
        else:
            col += 1
        if row < first or limits.columns is not None and col not in limits.columns:
            continue
        t = el.get("t", "n")
        v = el.find(_M + "v")
        raw = v.text if v is not None else None
        if t == "s" and raw is not None:
            if not 0 <= int(raw) < n_strings:
                raise IndexError("no shared string " + raw)
            yield row, col, "str", None, int(raw)
            continue
        if t == "inlineStr":
            kind, val = "str", "".join(x.text or "" for x in el.iter(_M + "t"))
        elif t in ("str", "s"):
            kind, val = "str", raw
        elif t == "b":
            kind, val = "bool", ("True" if raw == "1" else "False") if raw is not None else None
        elif t == "e":
            kind, val = "cellerror", raw
        elif raw is not None and int(el.get("s", "0")) in dates:
            kind, val = "date", _serial_to_text(float(raw), date1904)
        else:
            kind, val = "num", _num_text(raw) if raw is not None else None
        if val is not None and val != "":
            yield row, col, kind, val, None


def _reason(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


MEMBERS = pa.schema([("path", pa.string()), ("sheet_ix", pa.int32()), ("sheet_name", pa.string()), ("kind", pa.string()), ("member", pa.binary()), ("method", pa.int32()),
                     ("crc", pa.int64()), ("dates", pa.list_(pa.int32())), ("date1904", pa.bool_()), ("n_strings", pa.int64()), ("reason", pa.string()),
                     ("texts", pa.struct([("member", pa.binary()), ("method", pa.int32()), ("crc", pa.int64())]))])
MEMBER_SCHEMA = ("path string, sheet_ix int, sheet_name string, kind string, member binary, method int, crc bigint, dates array<int>, date1904 boolean, "
                 "n_strings bigint, reason string, texts struct<member: binary, method: int, crc: bigint>")
CELLS = pa.schema([("path", pa.string()), ("sheet_ix", pa.int32()), ("sheet_name", pa.string()), ("row_ix", pa.int64()), ("col_ix", pa.int32()),
                   ("cell_type", pa.string()), ("value", pa.string()), ("string_ix", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def book_members(path: str, content: bytes, limits: Limits = Limits(), few: int = 0) -> Iterator[tuple]:
    """Rows of ``MEMBERS``: the sheets of a workbook and its shared texts, or
    what is wrong with the file (F8).  Shared texts of up to ``few`` compressed
    bytes have no row but go with each sheet."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        dates = sorted(_date_styles(z))
        sheets, date1904 = _sheets(z)
        shared = _member(content, z, STRINGS) if STRINGS in z.namelist() else None
        n_strings = sum(1 for _ in _strings(_Inflated(*shared))) if shared else 0
    except Exception as e:  # unreadable file -> one error record
        yield path, -1, None, "error", None, None, None, None, None, None, _reason(e), None
        return
    texts = dict(zip(("member", "method", "crc"), shared)) if shared and len(shared[0]) <= few else None
    if shared and texts is None:
        yield path, -1, None, "strings", *shared, None, None, n_strings, None, None
    for ix, (name, member) in enumerate(sheets):
        if limits.sheet(ix, name):
            try:
                yield path, ix, name, "sheet", *_member(content, z, member), dates, date1904, n_strings, None, texts
            except Exception as e:
                yield path, ix, name, "sheet", None, None, None, None, None, None, _reason(e), None


def member_cells(m: dict, limits: Limits = Limits()) -> Iterator[pa.RecordBatch]:
    """The cells of one row of ``MEMBERS``, read once.

    They are held, compressed, until the sheet has been read: a sheet that
    cannot be read to its (wanted) end gives its marker and an error, and none
    of its cells; other sheets go on (F8)."""
    at = m["path"], m["sheet_ix"], m["sheet_name"]
    error = lambda reason: (*at, -1, -1, "error", reason, None)
    marker = [(*at, -1, -1, "sheet", None, None)] if m["kind"] == "sheet" else []
    if m["reason"] is not None:
        yield _batch([*marker, error(m["reason"])], CELLS)
        return
    held = pa.BufferOutputStream()
    try:
        with pa.ipc.new_stream(held, CELLS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            some, t = marker, m["texts"]
            texts = list(_strings(_Inflated(t["member"], t["method"], t["crc"]))) if t else None
            for *cell, string_ix in _sheet_cells(_Inflated(m["member"], m["method"], m["crc"]), set(m["dates"]), m["date1904"], m["n_strings"], limits):
                if texts is not None and string_ix is not None:
                    cell[3], string_ix = texts[string_ix], None
                some.append((*at, *cell, string_ix))
                if len(some) >= BATCH:
                    out.write_batch(_batch(some, CELLS))
                    some = []
            if some:
                out.write_batch(_batch(some, CELLS))
    except Exception as e:
        yield _batch([(*at, -1, -1, "sheet", None, None), error(_reason(e))], CELLS)
        return
    yield from pa.ipc.open_stream(held.getvalue())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time as Python objects: each may hold a large file."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def list_members(files: DataFrame, limits: Limits = Limits(), few: int = 0) -> DataFrame:
    """``binaryFile`` rows (``path``, ``content``) -> one row per sheet and
    shared texts, without reading any sheet."""
    ship_code()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in _rows(batches):
            for m in book_members(f["path"], f["content"], limits, few):
                yield _batch([m], MEMBERS)

    return files.select("path", "content").mapInArrow(listed, MEMBER_SCHEMA)


def _deal(members: DataFrame, partitions: int | None) -> DataFrame:
    """Members dealt out one by one, whatever book they are from.  Those who read
    some of them choose in their tasks, so that all share what is dealt."""
    return members.repartition(partitions or int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _joins(batch: pa.RecordBatch) -> pa.Array:
    """The sheets whose texts are rows of their own."""
    return pc.and_(pc.equal(batch.column("kind"), "sheet"), pc.and_(batch.column("texts").is_null(), pc.fill_null(pc.greater(batch.column("n_strings"), 0), False)))


def parse_members(members: DataFrame, limits: Limits = Limits(), partitions: int | None = None, joins: bool | None = None) -> DataFrame:
    """Cells of all sheets, shared texts that did not come with their sheet still
    as numbers (``string_ix``).  ``joins``: only sheets that have such texts, or
    only all else."""
    ship_code()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = pc.not_equal(batch.column("kind"), "strings")
            if joins is not None:
                wanted = pc.and_(wanted, _joins(batch) if joins else pc.invert(_joins(batch)))
            for m in _rows([batch.filter(wanted)]):
                yield from member_cells(m, limits)

    sheets = members.where("kind <> 'strings'") if joins is None else members  # none else reads what is dealt
    return _deal(sheets, partitions).mapInArrow(parse, CELL_SCHEMA + ", string_ix bigint")


def shared_strings(members: DataFrame, partitions: int | None = None) -> DataFrame:
    """``path, string_ix, string`` for the shared texts that are rows of their own."""
    ship_code()
    schema = pa.schema([("path", pa.string()), ("string_ix", pa.int64()), ("string", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in _rows(b.filter(pc.equal(b.column("kind"), "strings")) for b in batches):
            some = []
            for text in enumerate(_strings(_Inflated(m["member"], m["method"], m["crc"]))):
                some.append((m["path"], *text))
                if len(some) >= BATCH:
                    yield _batch(some, schema)
                    some = []
            if some:
                yield _batch(some, schema)

    return _deal(members, partitions).mapInArrow(parse, "path string, string_ix bigint, string string")


def read_cells(files: DataFrame, partitions: int | None = None, limits: Limits = Limits(), few: int = FEW_TEXTS) -> DataFrame:
    """``binaryFile`` rows (``path``, ``content``) -> cell table.

    Each sheet is one task's input, whatever book it is from, and is read once.
    Books whose shared texts have up to ``few`` compressed bytes need no join.
    In others, a cell with a text of its own takes a number that no shared text
    has, so such cells spread over the join as well.  Files are opened once."""
    members = list_members(files, limits, few)
    own = -1 - (F.col("row_ix") + 1) * 16384 - (F.col("col_ix") + 1)
    cells = parse_members(members, limits, partitions, joins=True).withColumn("string_ix", F.coalesce("string_ix", own))
    joined = cells.join(shared_strings(members, partitions), ["path", "string_ix"], "left").withColumn("value", F.coalesce("value", "string"))
    whole = parse_members(members, limits, partitions, joins=False)
    return whole.select(*COLUMNS).unionByName(joined.select(*COLUMNS)).where((F.col("cell_type") == "sheet") | (F.col("value") != ""))


def parse_workbook(path: str, content: bytes, limits: Limits = Limits()) -> list[tuple]:
    """All cell tuples (``COLUMNS`` order) of one small workbook, in place."""
    members = [dict(zip(MEMBERS.names, m)) for m in book_members(path, content, limits)]
    texts = [t for m in members if m["kind"] == "strings" for t in _strings(_Inflated(m["member"], m["method"], m["crc"]))]
    cells = [c for m in members if m["kind"] != "strings" for b in member_cells(m, limits) for c in zip(*b.to_pydict().values())]
    cells = [(*c[:6], c[6] if c[7] is None else texts[c[7]]) for c in cells]
    return [c for c in cells if c[5] == "sheet" or c[6] != ""]


# ---------------------------------------------------------------------------
# S4 on files: reading ends at the header
# ---------------------------------------------------------------------------


def find_header(content: bytes, marker: str) -> tuple[int | None, str | None, int | None, str | None]:
    """(sheet_ix, sheet_name, header_row, reason) of the first sheet with a cell
    whose text contains ``marker``.  Reading ends at that row; sheets that break
    off before it are passed over."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        dates = _date_styles(z)
        sheets, date1904 = _sheets(z)
        shared = _member(content, z, STRINGS) if STRINGS in z.namelist() else None
        hits, n_strings = set(), 0
        for i, text in enumerate(_strings(_Inflated(*shared)) if shared else ()):
            n_strings = i + 1
            if marker in text:
                hits.add(i)
    except Exception as e:
        return None, None, None, _reason(e)
    for ix, (name, member) in enumerate(sheets):
        try:
            for row, _, _, value, string_ix in _sheet_cells(_Inflated(*_member(content, z, member)), dates, date1904, n_strings):
                if string_ix in hits or value is not None and marker in value:
                    return ix, name, row, None
        except Exception:
            continue
    return None, None, None, None


def header_rows(files: DataFrame, marker: str = "WO No") -> DataFrame:
    """Per workbook the first sheet with ``marker`` and its row: ``path,
    sheet_ix, sheet_name, header_row, reason`` (of an unreadable file).

    As ``operators.sheets.header_discovery`` on the cell table, but no cell
    beyond the header is read, and a sheet that breaks off behind it counts."""
    ship_code()
    schema = pa.schema([("path", pa.string()), ("sheet_ix", pa.int32()), ("sheet_name", pa.string()), ("header_row", pa.int64()), ("reason", pa.string())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in _rows(batches):
            yield _batch([(f["path"], *find_header(f["content"], marker))], schema)

    return files.select("path", "content").mapInArrow(find, "path string, sheet_ix int, sheet_name string, header_row bigint, reason string")


# Names that end in an Excel suffix in any case, as a glob: other files are never opened.
EXCEL_GLOB = "*.{" + ",".join("".join(f"[{ch}{ch.upper()}]" for ch in ext) for ext in EXCEL_EXTENSIONS) + "}"


def read_workbooks(spark: SparkSession, folder: str, glob: str = EXCEL_GLOB, limits: Limits = Limits()) -> DataFrame:
    """Admitted Excel files under ``folder`` -> cell table (S1 + S9), as far as
    ``limits`` ask for it.

    Files over Spark's limit for one binary record are not opened; each
    becomes an error cell, as an unreadable file does."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
             .load(folder).where(is_excel(F.col("path"))))
    limit = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(2**31 - 1)))
    over = files.where(F.col("length") > limit).select(
        "path", F.lit(-1).alias("sheet_ix"), F.lit(None).cast("string").alias("sheet_name"),
        F.lit(-1).cast("long").alias("row_ix"), F.lit(-1).alias("col_ix"), F.lit("error").alias("cell_type"),
        F.concat(F.lit("file too long: "), F.col("length").cast("string"), F.lit(" bytes")).alias("value"))
    return read_cells(files.where(F.col("length") <= limit), limits=limits).unionByName(over)
