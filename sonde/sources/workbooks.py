"""Tables as workbooks: the smallest XLSX files that spreadsheet programs open."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_SHEET = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, int | float) and not isinstance(value, bool):
        return f"<c><v>{value}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """Sheets by name, each a list of rows; the same bytes for the same sheets."""
    numbered = list(enumerate(sheets.items(), 1))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{_SHEET}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_SHEET}.worksheet+xml"/>' for i, _ in numbered) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {_MAIN} xmlns:r="{_OFFICE}"><sheets>' + "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, (name, _) in numbered) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in numbered) + "</Relationships>",
    }
    for i, (_, rows) in numbered:
        parts[f"xl/worksheets/sheet{i}.xml"] = f"<worksheet {_MAIN}><sheetData>" + "".join(f"<row>{''.join(map(_cell, row))}</row>" for row in rows) + "</sheetData></worksheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8"?>' + body)
    return out.getvalue()


def as_workbooks(rows: DataFrame, key: str, columns: list[str], sheet: str = "Sheet1") -> DataFrame:
    """(key, content): for each key a workbook of one sheet, its rows sorted by the columns. A workbook is one
    document, made by one task."""
    gathered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [workbook({sheet: [columns, *([r[c] for c in columns] for r in own)]}) for own in pdf["rows"]]
            yield pd.DataFrame({key: pdf[key], "content": made})

    return gathered.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, content binary")
