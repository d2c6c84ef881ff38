"""Build small .xlsx files with the standard library (no Excel writer needed)."""

from __future__ import annotations

import datetime as dt
import zipfile
from xml.sax.saxutils import escape

CT = """<?xml version="1.0" encoding="UTF-8"?>
<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">
<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>
<Default Extension="xml" ContentType="application/xml"/>
</Types>"""
RELS = """<?xml version="1.0" encoding="UTF-8"?>
<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">
<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>
</Relationships>"""
STYLES = """<?xml version="1.0" encoding="UTF-8"?>
<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">
<numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/></numFmts>
<cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="164"/></cellXfs>
</styleSheet>"""
M = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def col_letters(c: int) -> str:
    s = ""
    c += 1
    while c:
        c, r = divmod(c - 1, 26)
        s = chr(65 + r) + s
    return s


def serial(d: dt.datetime) -> float:
    delta = d - dt.datetime(1899, 12, 30)
    return delta.days + delta.seconds / 86400


def make_xlsx(path: str, sheets: list[tuple[str, list[list]]], inline: bool = False) -> str:
    """``sheets``: (name, rows); a row is a list of cell values (None = blank)."""
    sst: list[str] = []
    index: dict[str, int] = {}
    sheet_xml = []
    for _, rows in sheets:
        out = [f'<worksheet xmlns="{M}"><sheetData>']
        for r, row in enumerate(rows):
            out.append(f'<row r="{r + 1}">')
            for c, v in enumerate(row):
                ref = f"{col_letters(c)}{r + 1}"
                if v is None:
                    continue
                if isinstance(v, bool):
                    out.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
                elif isinstance(v, dt.datetime):
                    out.append(f'<c r="{ref}" s="1"><v>{serial(v)}</v></c>')
                elif isinstance(v, (int, float)):
                    out.append(f'<c r="{ref}"><v>{v}</v></c>')
                elif inline:
                    out.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>')
                else:
                    if v not in index:
                        index[v] = len(sst)
                        sst.append(v)
                    out.append(f'<c r="{ref}" t="s"><v>{index[v]}</v></c>')
            out.append("</row>")
        out.append("</sheetData></worksheet>")
        sheet_xml.append("".join(out))
    wb = [f'<workbook xmlns="{M}" xmlns:r="{R}"><sheets>']
    rels = ['<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">']
    for i, (name, _) in enumerate(sheets):
        wb.append(f'<sheet name="{escape(name)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>')
        rels.append(f'<Relationship Id="rId{i + 1}" Type="{R}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>')
    wb.append("</sheets></workbook>")
    rels.append("</Relationships>")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", CT)
        z.writestr("_rels/.rels", RELS)
        z.writestr("xl/workbook.xml", "".join(wb))
        z.writestr("xl/_rels/workbook.xml.rels", "".join(rels))
        z.writestr("xl/styles.xml", STYLES)
        sst_xml = "".join(f"<si><t xml:space=\"preserve\">{escape(s)}</t></si>" for s in sst)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{M}">{sst_xml}</sst>')
        for i, x in enumerate(sheet_xml):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", x)
    return path


HEADERS = ["WO No", "Loc", "ST", "Mileage", "Open Date", "Done Date", "Actual Finish Date",
           "Nature of Complaint", "Fault Codes", "Job Description", "SRR No.", "Mechanic Name",
           "Customer", "Customer Name", "Recommendation 4 next", "Cat", "Lead Tech", "Bill No.",
           "Intercoamt", "Custamt"]


def kardex_rows(records: list[dict], title: str = "Kardex") -> list[list]:
    """Sheet layout: title at row 0, header text repeated in rows 1-2 (as in
    the original synthetic workbook), the real header at row 3, data from 4."""
    rows: list[list] = [[title], list(HEADERS), list(HEADERS), list(HEADERS)]
    for rec in records:
        rows.append([rec.get(h) for h in HEADERS])
    return rows
