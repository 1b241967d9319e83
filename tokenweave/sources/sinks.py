"""Sinks: JSON reports, and workbooks written with the standard library."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_NS = "http://schemas.openxmlformats.org"


def to_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON object per row of df, as `json`, beside the keys it is kept under."""
    return df.select(*keys, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def chapter_reports(summaries: DataFrame, rows: DataFrame) -> DataFrame:
    """run_id, chapter_index, json: the report of each chapter as one document, its labels and counts and under `rows` its rows in order.

    summaries: operators.chapters.summaries; rows: operators.chapters.rows. A run is all documents of its id: one for each
    chapter, since a run of any size would not fit one task.
    """
    at = ["run_id", "chapter_index"]
    item = F.struct("row_no", *(c for c in rows.columns if c not in (*at, "row_no")))
    nested = rows.groupBy(*at).agg(F.sort_array(F.collect_list(item)).alias("rows"))
    whole = summaries.join(nested, at, "left")
    none = F.array().cast(nested.schema["rows"].dataType)
    fields = [c for c in summaries.columns if c != "run_id"]
    document = F.struct(*fields, F.coalesce("rows", none).alias("rows"))
    return whole.select(*at, F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))


def _letter(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(value, at: str, bold: bool = False) -> str:
    style = ' s="1"' if bold else ""
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"{style}><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{at}"{style}><v>{value}</v></c>'
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
    return f'<c r="{at}" t="inlineStr"{style}><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _sheet(header: list[str], rows: Iterable[tuple], widths: dict[str, int]) -> str:
    columns = "".join(f'<col min="{i}" max="{i}" width="{widths[h]}" customWidth="1"/>' for i, h in enumerate(header, 1) if h in widths)
    lines = ['<row r="1">' + "".join(_cell(h, f"{_letter(i)}1", True) for i, h in enumerate(header, 1)) + "</row>"]
    n = 1
    for row in rows:
        n += 1
        lines.append(f'<row r="{n}">' + "".join(_cell(v, f"{_letter(i)}{n}") for i, v in enumerate(row, 1)) + "</row>")
    frozen = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    filtered = f'<autoFilter ref="A1:{_letter(len(header))}{n}"/>' if n > 1 else ""
    cols = f"<cols>{columns}</cols>" if columns else ""
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS}/spreadsheetml/2006/main">{frozen}{cols}<sheetData>{"".join(lines)}</sheetData>{filtered}</worksheet>'


def workbook(sheets: list[tuple[str, list[str], Iterable[tuple], dict[str, int]]]) -> bytes:
    """An .xlsx of (name, header, rows, column widths): bold header, first row frozen, filters on.

    A workbook is one file for one reader: rows pass through the driver one by one. Larger exports go to Parquet or CSV.
    """
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{_NS}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_TYPE}.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{_NS}/package/2006/relationships"><Relationship Id="r1" Type="{_NS}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="r{i}"/>' for i, (name, *_) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_NS}/spreadsheetml/2006/main" xmlns:r="{_NS}/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{_NS}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{_NS}/package/2006/relationships">{links}<Relationship Id="s" Type="{_NS}/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>')
        fonts = "<fonts count=\"2\"><font/><font><b/></font></fonts><fills count=\"1\"><fill/></fills><borders count=\"1\"><border/></borders><cellStyleXfs count=\"1\"><xf/></cellStyleXfs>"
        z.writestr("xl/styles.xml", f'<?xml version="1.0"?><styleSheet xmlns="{_NS}/spreadsheetml/2006/main">{fonts}<cellXfs count="2"><xf fontId="0"/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        for i, (_, header, rows, widths) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet(header, rows, widths))
    return out.getvalue()


def export_workbook(rows: DataFrame, new_lemmas: DataFrame, row_columns: list[str], new_columns: list[str]) -> bytes:
    """The two sheets of one run; raises if there are no rows."""
    if rows.isEmpty():
        raise ValueError("there is nothing to export")
    order = lambda df, cols: (tuple(r) for r in df.orderBy("chapter_index", "row_no").select(*cols).toLocalIterator())
    wide = {"file": 24, "chapter_id": 18, "chapter_title": 24, "lemma": 16}
    return workbook([("Rows", row_columns, order(rows, row_columns), wide | {"form": 16, "parse": 20}), ("New lemmas by chapter", new_columns, order(new_lemmas, new_columns), wide | {"forms": 28, "parses": 28})])


def export_name(filenames: list[str], now: datetime.datetime | None = None, prefix: str = "tokenweave") -> str:
    """`prefix-name-YYYYMMDD-HHMM.xlsx` after the only file, or after their number."""
    stamp = (now or datetime.datetime.now()).strftime("%Y%m%d-%H%M")
    if len(filenames) == 1:
        name = re.sub(r"\W+", "-", re.sub(r"\.docx\Z", "", filenames[0], flags=re.I)).strip("-")
    else:
        name = f"{len(filenames)}-files"
    return f"{prefix}-{name or 'report'}-{stamp}.xlsx"


def export_name_column(filenames: Column, time: Column, prefix: str = "tokenweave") -> Column:
    """export_name() over columns."""
    one = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.get(filenames, F.lit(0)), r"(?i)\.docx\z", ""), r"(?U)\W+", "-"), "^-+|-+$", "")
    name = F.when(F.size(filenames) == 1, one).otherwise(F.concat(F.size(filenames).cast("string"), F.lit("-files")))
    return F.concat(F.lit(prefix + "-"), F.when(name == "", "report").otherwise(name), F.lit("-"), F.date_format(time, "yyyyMMdd-HHmm"), F.lit(".xlsx"))
