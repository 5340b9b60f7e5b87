"""Workbook files (Office Open XML): their sheets as rows of texts, read and written inside tasks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _column(reference: str) -> int:
    """The number from 0 of a cell reference's column: B7 is 1."""
    n = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _text(element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{{{MAIN}}}t"))


def sheets_of(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """Each sheet's name and rows, empty cells as ''. Raises for bytes that are no workbook."""
    book = zipfile.ZipFile(io.BytesIO(data))
    read = lambda name: ElementTree.fromstring(book.read(name))
    shared = [_text(s) for s in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in book.namelist() else []
    targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
    out = []
    for sheet in read("xl/workbook.xml").iter(f"{{{MAIN}}}sheet"):
        target = targets[sheet.get(f"{{{RELATIONS}}}id")]
        rows: list[list[str]] = []
        with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{{{MAIN}}}row":
                    continue
                values: list[str] = []
                for cell in row.iter(f"{{{MAIN}}}c"):
                    at = _column(cell.get("r") or "") if cell.get("r") else len(values)
                    values += [""] * (at - len(values))
                    plain, kind = cell.findtext(f"{{{MAIN}}}v") or "", cell.get("t")
                    values.append(shared[int(plain)] if kind == "s" else _text(cell) if kind == "inlineStr" else {"1": "TRUE", "0": "FALSE"}.get(plain, plain) if kind == "b" else plain)
                number = int(row.get("r") or len(rows) + 1)
                rows += [[] for _ in range(number - 1 - len(rows))]
                rows.append(values)
                row.clear()
        out.append((sheet.get("name"), rows))
    return out


def workbook_of(sheets: Sequence[tuple[str, Sequence[Sequence[str]]]]) -> bytes:
    """A workbook of sheets (name, rows of texts)."""
    out = io.BytesIO()
    letters = lambda n: ("" if n < 26 else letters(n // 26 - 1)) + chr(65 + n % 26)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        parts = [f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1)]
        book.writestr("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{"".join(parts)}</Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets>' + "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, (name, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, (_, rows) in enumerate(sheets, 1):
            cells = ["".join(f'<c r="{letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for c, v in enumerate(row) if v) for r, row in enumerate(rows, 1)]
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>' + "".join(f'<row r="{r}">{c}</row>' for r, c in enumerate(cells, 1)) + "</sheetData></worksheet>")
    return out.getvalue()
