"""Cells as the decoder reads them: phonetic readings, dates, missing positions, bounds, merges beyond them."""
import io
import zipfile

import pytest

from shoal.operators import grid as G
from shoal.sources import workbook as W
from tests.xlsx_fixture import MAIN, REL

STYLES = f"""<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="164" formatCode="yyyy&quot;年&quot;m&quot;月&quot;"/>
<numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/></numFmts>
<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="20"/></cellXfs></styleSheet>"""


def book(rows, shared="", merges="", props=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}">{props}<sheets>'
                                      '<sheet name="提出用" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="a" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData>{merges}</worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{shared}</sst>')
        z.writestr("xl/styles.xml", STYLES)
    return out.getvalue()


def cells(content, **kw):
    return {(r["row"], r["col"]): r["value"] for r in W.decode_workbook("f", content, **kw) if r["kind"] == "cell"}


def test_phonetic_readings_are_left_out():
    shared = ('<si><t>東京本店</t><rPh sb="0" eb="2"><t>トウキョウ</t></rPh></si>'
              '<si><r><t>大阪</t></r><r><t>支店</t></r><rPh sb="0" eb="2"><t>オオサカ</t></rPh></si>')
    got = cells(book('<row r="4"><c r="D4" t="s"><v>0</v></c><c r="E4" t="s"><v>1</v></c></row>', shared))
    assert got == {(4, 4): "東京本店", (4, 5): "大阪支店"}


@pytest.mark.parametrize("cell, want", [
    ('<c r="A1" s="1"><v>45000</v></c>', "2023-03-15 00:00:00"),
    ('<c r="A1" s="2"><v>45000.5</v></c>', "2023-03-15 12:00:00"),
    ('<c r="A1" s="4"><v>0.25</v></c>', "06:00:00"),
    ('<c r="A1" s="3"><v>45000</v></c>', "45000"),
    ('<c r="A1"><v>1.50</v></c>', "1.5"),
    ('<c r="A1" t="d"><v>2023-03-15T10:20:30</v></c>', "2023-03-15 10:20:30"),
    ('<c r="A1" t="d"><v>2023-03-15</v></c>', "2023-03-15 00:00:00"),
])
def test_dates_and_numbers(cell, want):
    assert cells(book(f'<row r="1">{cell}</row>')) == {(1, 1): want}


def test_dates_of_the_other_epoch():
    got = cells(book('<row r="1"><c r="A1" s="1"><v>0</v></c></row>', props='<workbookPr date1904="1"/>'))
    assert got == {(1, 1): "1904-01-01 00:00:00"}


def test_missing_positions_follow_on():
    got = cells(book('<row><c><v>1</v></c><c><v>2</v></c></row><row r="5"><c r="C5"><v>3</v></c><c><v>4</v></c></row><row><c><v>5</v></c></row>'))
    assert got == {(1, 1): "1", (1, 2): "2", (5, 3): "3", (5, 4): "4", (6, 1): "5"}


def test_bounds_and_sheet():
    rows = '<row r="1"><c r="A1"><v>1</v></c><c r="C1"><v>2</v></c></row><row r="9"><c r="A9"><v>3</v></c></row>'
    assert cells(book(rows), last_row=8, last_col=2) == {(1, 1): "1"}
    assert cells(book(rows), sheet="other") == {}


def test_a_merge_over_whole_columns_is_clipped(spark):
    c = spark.createDataFrame([("f", "s", 1, 3, "x"), ("f", "s", 300, 3, "kept")], "file string, sheet string, row int, col int, value string")
    m = spark.createDataFrame([("f", "s", 1, 3, 1_048_576, 16_384)], "file string, sheet string, min_row int, min_col int, max_row int, max_col int")
    got = {(r["row"], r["col"]): r["value"] for r in G.fill_merged(c, m).collect()}
    assert got.pop((300, 3)) == "kept"
    assert got == {(r, k): "x" for r in range(1, 208) for k in range(3, 23)}


def test_record_ids_stay_distinct_at_larger_bounds(spark):
    rows = [(f, "提出用", r, c, v) for f in ("a", "b") for r in (7, 1007) for c, v in ((6, "(1)"), (7, "text"))]
    c = spark.createDataFrame(rows, "file string, sheet string, row int, col int, value string")
    got = [r["record_id"] for r in G.extract_records(c, None, G.GridParams(scan_rows=1500)).collect()]
    assert len(got) == len(set(got)) == 4
