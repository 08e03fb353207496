"""Readers and writers: CSV / JSON / Parquet ledgers, workbooks, reports,
and the streaming loader."""

import csv
import json
import os
import tempfile

import pytest

from ledgerlake import normalize, read_ledger, totals
from ledgerlake.operators.reports import export_report
from ledgerlake.schema import COLUMNS, DISPLAY_NAMES
from ledgerlake.sources.sinks import json_records, write_report
from ledgerlake.sources.workbook import read_workbooks
from ledgerlake.streaming.ingest import start_ingest
from tests.conftest import SIX_ROWS
from tests.xlsx_writer import write_xlsx

HEADER = [DISPLAY_NAMES[c] for c in COLUMNS]


def _tmp():
    return tempfile.mkdtemp(prefix="ledgerlake-test-")


def _write_csv(path, header, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


def _rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_csv_odd_headers_and_extra_column(spark, six):
    d = _tmp()
    _write_csv(os.path.join(d, "a.csv"), [f"h{i}" for i in range(11)], [list(r) + ["extra"] for r in SIX_ROWS])
    df = normalize(read_ledger(spark, d, "csv"))
    assert _rows(df) == _rows(six)


def test_json_by_name(spark, six):
    d = _tmp()
    with open(os.path.join(d, "a.json"), "w") as f:
        for r in SIX_ROWS:
            f.write(json.dumps(dict(zip(HEADER, r))) + "\n")
    assert _rows(normalize(read_ledger(spark, d, "json"))) == _rows(six)


def test_parquet_round_trip(spark, six):
    d = os.path.join(_tmp(), "p")
    six.write.parquet(d)
    assert _rows(normalize(read_ledger(spark, d, "parquet"))) == _rows(six)


def test_workbook_equals_csv_twin(spark, six):
    d = _tmp()
    rows = [HEADER]
    for r in SIX_ROWS:
        day = int(r[0][-2:])
        serial = 45306 + (day - 15)  # 2024-01-15 is serial 45306
        rows.append([("date", serial), *r[1:6], *[float(x) for x in r[6:]]])
    write_xlsx(os.path.join(d, "ledger.xlsx"), rows)
    write_xlsx(os.path.join(d, "copy.xlsx"), rows)
    df = normalize(read_workbooks(spark, d))
    assert _rows(df) == sorted(_rows(six) * 2)


def test_report_files(spark, six):
    d = os.path.join(_tmp(), "r")
    write_report(export_report(six), d, "csv")
    back = spark.read.option("header", True).csv(d)
    assert back.count() == 7
    assert back.filter("particulars = 'TOTAL'").first()["cash_dr"] == "15000.0"
    recs = [json.loads(r[0]) for r in json_records(six).collect()]
    assert {r["entity_name"] for r in recs} >= {"ABC Corp", "GHI Inc"}


def test_streaming_ingest(spark, six):
    src, out, ck = _tmp(), os.path.join(_tmp(), "ledger"), os.path.join(_tmp(), "ck")
    _write_csv(os.path.join(src, "part1.csv"), HEADER, SIX_ROWS[:3])
    _write_csv(os.path.join(src, "part2.csv"), HEADER, SIX_ROWS[3:])
    q = start_ingest(spark, src, out, ck, available_now=True)
    q.awaitTermination(120)
    saved = spark.read.parquet(out)
    assert _rows(saved) == _rows(six)
    t = totals(saved).first()
    assert (t["row_count"], t["bank_dr"]) == (6, 15500.0)
    # A restart with no new files appends nothing (exactly-once).
    q = start_ingest(spark, src, out, ck, available_now=True)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 6


def test_streaming_picks_up_only_new_files(spark, six):
    src, out, ck = _tmp(), os.path.join(_tmp(), "ledger"), os.path.join(_tmp(), "ck")
    _write_csv(os.path.join(src, "a.csv"), HEADER, SIX_ROWS[:4])
    start_ingest(spark, src, out, ck, available_now=True).awaitTermination(120)
    assert spark.read.parquet(out).count() == 4
    _write_csv(os.path.join(src, "b.csv"), HEADER, SIX_ROWS[4:])
    start_ingest(spark, src, out, ck, available_now=True).awaitTermination(120)
    assert _rows(spark.read.parquet(out)) == _rows(six)


def test_missing_path_raises(spark):
    import pytest

    with pytest.raises(Exception):
        read_ledger(spark, os.path.join(_tmp(), "nope"), "csv").count()


def test_report_formats(spark, six):
    for fmt in ("parquet", "json"):
        d = os.path.join(_tmp(), fmt)
        write_report(export_report(six), d, fmt)
        back = spark.read.format(fmt).load(d)
        assert back.count() == 7
        assert back.filter("is_total").first()["bank_dr"] == 15500.0


def test_single_workbook_through_read_ledger(spark, six):
    d = _tmp()
    rows = [HEADER] + [[*r[:6], *[float(x) for x in r[6:]]] for r in SIX_ROWS]
    path = os.path.join(d, "one.xlsx")
    write_xlsx(path, rows)
    assert _rows(normalize(read_ledger(spark, path, "xlsx"))) == _rows(six)


def test_workbook_cell_kinds():
    """Decode inline strings, booleans, custom date formats, date-times and
    sparse rows (cells addressed by reference, gaps left empty)."""
    import zipfile

    from ledgerlake.sources.workbook import workbook_rows

    d = _tmp()
    path = os.path.join(d, "kinds.xlsx")
    write_xlsx(path, [HEADER, [("date", 45306), "T", "S", "N", "V", "P", 1.5, 0, 0, 0]])
    # Rewrite the sheet with other cell kinds and a custom date style.
    sheet = (
        '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
        '<row r="1"><c r="A1" t="inlineStr"><is><t>Date</t></is></c><c r="J1" t="inlineStr"><is><t>Bank Cr</t></is></c></row>'
        '<row r="2"><c r="A2" s="2"><v>45306.5</v></c><c r="B2" t="inlineStr"><is><t> Inline </t></is></c>'
        '<c r="D2" t="b"><v>1</v></c><c r="G2"><v>12.25</v></c></row>'
        "</sheetData></worksheet>"
    )
    styles = (
        '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
        '<numFmts count="1"><numFmt numFmtId="164" formatCode="dd/mm/yyyy hh:mm"/></numFmts>'
        '<cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>'
    )
    src = zipfile.ZipFile(path)
    parts = {n: src.read(n) for n in src.namelist()}
    src.close()
    parts["xl/worksheets/sheet1.xml"] = sheet.encode()
    parts["xl/styles.xml"] = styles.encode()
    with zipfile.ZipFile(path, "w") as z:
        for n, b in parts.items():
            z.writestr(n, b)
    rows = list(workbook_rows(open(path, "rb").read()))
    assert rows == [["2024-01-15 12:00:00", " Inline ", None, "TRUE", None, None, "12.25", None, None, None]]


@pytest.mark.parametrize("width", [9, 10, 17])
def test_workbook_width(spark, six, width):
    d = _tmp()
    write_xlsx(os.path.join(d, "good.xlsx"), [HEADER, *SIX_ROWS])
    wide = [[*r, *["x"] * 10][:width] for r in [HEADER, *SIX_ROWS]]
    write_xlsx(os.path.join(d, f"wide{width}.xlsx"), wide)
    read = read_ledger(spark, d, "xlsx")
    if width < 10:
        with pytest.raises(Exception, match="wide9.xlsx: a ledger has 10 columns, this one has 9"):
            read.collect()
    else:
        assert read.count() == 12 and len(read.columns) == 10


def test_escaped_letters_are_no_date_format(tmp_path):
    import zipfile

    from ledgerlake.sources.workbook import _date_styles

    formats = ["0.00\\ \\D\\r", "d/m/yy", '0.00" day"']
    xml = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts>' + "".join(
        f'<numFmt numFmtId="{164 + i}" formatCode="{f.replace(chr(34), "&quot;")}"/>' for i, f in enumerate(formats)
    ) + "</numFmts><cellXfs>" + "".join(f'<xf numFmtId="{164 + i}"/>' for i in range(3)) + "</cellXfs></styleSheet>"
    path = str(tmp_path / "s.xlsx")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/styles.xml", xml)
    assert _date_styles(zipfile.ZipFile(path)) == {1}


def test_streaming_json_by_display_names(spark, six):
    src, out, ck = _tmp(), os.path.join(_tmp(), "ledger"), os.path.join(_tmp(), "ck")
    with open(os.path.join(src, "a.json"), "w") as f:
        for r in SIX_ROWS:
            f.write(json.dumps(dict(zip(HEADER, r))) + "\n")
    start_ingest(spark, src, out, ck, fmt="json", available_now=True).awaitTermination(120)
    assert _rows(spark.read.parquet(out)) == _rows(six)


def test_ordered_report_ends_with_total(spark, six):
    import glob

    d = os.path.join(_tmp(), "ordered")
    write_report(export_report(six), d, "csv")
    lines = []
    for part in sorted(glob.glob(os.path.join(d, "part-*.csv"))):
        with open(part) as f:
            rows = list(csv.reader(f))
        lines += rows[1:]  # each part file has its own header
    assert len(lines) == 7
    assert lines[-1][5] == "TOTAL"
    assert [r[0] for r in lines[:-1]] == sorted(r[0] for r in lines[:-1])
