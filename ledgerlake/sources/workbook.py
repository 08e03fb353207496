"""Bulk workbook ingest (S2): a folder of ``.xlsx`` files -> raw ledger.

Spark lists the files (``binaryFile``) and ``mapInArrow`` decodes one
workbook per task with the standard library (an ``.xlsx`` is a zip of XML
parts). The first sheet is read, row 1 is the header and is dropped, and
cells come out as strings, so the usual positional check and cleaning
apply. Date-formatted number cells become ``yyyy-MM-dd`` text.
"""

from __future__ import annotations

import datetime as _dt
import io
import re
import zipfile
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerlake.schema import COLUMNS

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG_REL = "http://schemas.openxmlformats.org/package/2006/relationships"
# Built-in number format ids that display dates.
_DATE_FMT_IDS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_EXCEL_EPOCH = _dt.datetime(1899, 12, 30)
BATCH_ROWS = 10000


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    custom = {}
    for nf in root.findall("m:numFmts/m:numFmt", _NS):
        # Literal text: quoted, in brackets, or one character after a backslash.
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", nf.get("formatCode", "")).lower()
        custom[int(nf.get("numFmtId"))] = any(ch in code for ch in "dy")
    out = set()
    for i, xf in enumerate(root.findall("m:cellXfs/m:xf", _NS)):
        fid = int(xf.get("numFmtId", "0"))
        if fid in _DATE_FMT_IDS or custom.get(fid, False):
            out.add(i)
    return out


def _first_sheet(z: zipfile.ZipFile) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    sheet = wb.find("m:sheets/m:sheet", _NS)
    rid = sheet.get(f"{{{_REL_NS}}}id")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    for rel in rels.findall(f"{{{_PKG_REL}}}Relationship"):
        if rel.get("Id") == rid:
            target = rel.get("Target").lstrip("/")
            return target if target.startswith("xl/") else "xl/" + target
    raise ValueError("workbook has no first sheet")


def _serial_text(v: str) -> str:
    d = _EXCEL_EPOCH + _dt.timedelta(days=float(v))
    return d.strftime("%Y-%m-%d") if d.time() == _dt.time() else d.strftime("%Y-%m-%d %H:%M:%S")


def _cells(row, shared: list[str], dates: set[int]) -> dict[int, str]:
    """Texts of a row's cells by column."""
    cells: dict[int, str] = {}
    for pos, c in enumerate(row.findall("m:c", _NS)):
        i = _col_index(c.get("r")) if c.get("r") else pos
        t = c.get("t")
        v = c.find("m:v", _NS)
        if t == "s" and v is not None:
            cells[i] = shared[int(v.text)]
        elif t == "inlineStr":
            cells[i] = "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))
        elif t == "b" and v is not None:
            cells[i] = "TRUE" if v.text == "1" else "FALSE"
        elif v is not None and v.text is not None:
            style = int(c.get("s", "0"))
            cells[i] = _serial_text(v.text) if (t in (None, "n") and style in dates) else v.text
    return cells


def _streamed(z: zipfile.ZipFile, part: str, tag: str):
    """The elements ``tag`` of a part, one at a time; each is dropped when
    the next one is asked for."""
    with z.open(part) as f:
        for _, element in ET.iterparse(f):
            if element.tag == f"{{{_NS['m']}}}{tag}":
                yield element
                element.clear()


def workbook_rows(data: bytes, name: str = "workbook"):
    """Yield the data rows (header dropped) of the first sheet as lists of
    10 optional strings. The header row says how many columns there are:
    fewer than 10 are an error, those beyond 10 are dropped."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        for si in _streamed(z, "xl/sharedStrings.xml", "si"):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
    dates = _date_styles(z)
    header = True
    for row in _streamed(z, _first_sheet(z), "row"):
        cells = _cells(row, shared, dates)
        if header:
            header = False
            width = max(cells, default=-1) + 1
            if width < len(COLUMNS):
                raise ValueError(f"{name}: a ledger has {len(COLUMNS)} columns, this one has {width}")
            continue
        yield [cells.get(i) for i in range(len(COLUMNS))]


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Raw ledger (first 10 columns by position) from every ``.xlsx`` under
    ``path``; one task decodes one workbook, row by row. A workbook of fewer
    columns stops the read with its name."""
    schema = ", ".join(f"{n} string" for n in COLUMNS)
    fields = pa.schema([(n, pa.string()) for n in COLUMNS])

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                buf: list[list[str | None]] = []
                for r in workbook_rows(content, name):
                    buf.append(r)
                    if len(buf) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(col, pa.string()) for col in zip(*buf)], schema=fields)
                        buf = []
                if buf:
                    yield pa.RecordBatch.from_arrays([pa.array(col, pa.string()) for col in zip(*buf)], schema=fields)

    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.xlsx")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "content")
    )
    # Spark packs files into scan partitions by size, so large workbooks
    # get a task each and small ones share one.
    return files.mapInArrow(decode, schema)
