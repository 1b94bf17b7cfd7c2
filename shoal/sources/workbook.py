"""Read many workbooks into sparse cells, merges and a per-file status.

``spark.read.format("binaryFile")`` lists the files (S2: ``*.xls*``,
non-recursive) and ships each file's bytes to one task; ``mapInPandas``
decodes it with the standard library (the package is a zip of XML parts):
shared and inline strings (without phonetic readings), numbers, dates and times in
Python ``str()`` form, booleans, and merged ranges.  A file that fails to decode, or lacks the target sheet,
becomes a status row; it never stops the others.  Files are decoded in
parallel across tasks; no file passes through the driver.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, time, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.operators import grid as G

# ---------------------------------------------------------------------------
# The status messages and the empty-result message.
MISSING_SHEET = "「{file}」に「{sheet}」シートがありません（スキップ）"
READ_ERROR = "「{file}」の読み込みエラー: {error}"
NO_RECORDS = ("有効なレコードが抽出できませんでした。\n"
              "考えられる原因:\n"
              "- 「提出用」シートがない\n"
              "- 番号行（1. や (1) など）の形式が異なる\n"
              "- データが7行目以降に存在しない")
# ---------------------------------------------------------------------------

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
_REF = re.compile(r"^([A-Z]+)(\d+)$")

DECODED_SCHEMA = ("kind STRING, file STRING, sheet STRING, row INT, col INT, value STRING, "
                  "max_row INT, max_col INT, message STRING")


def _ref(ref: str) -> tuple[int, int]:
    m = _REF.match(ref.replace("$", "").upper())
    if not m:
        raise ValueError(f"bad cell reference {ref!r}")
    return int(m.group(2)), G.column_index(m.group(1))


def _text(el) -> str:
    """The text of a string item: its own ``t`` or those of its runs; phonetic readings are left out."""
    own = el.findall("m:t", _NS) or el.findall("m:r/m:t", _NS)
    return "".join(t.text or "" for t in own)


def _number(v: str) -> str:
    """A numeric cell as Python's str() shows the loaded value (int or float)."""
    if re.fullmatch(r"[+-]?\d+", v.strip()):
        return str(int(v))
    return str(float(v))


# Built-in number formats that show dates or times.
_DATE_FORMATS = frozenset([*range(14, 23), 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47,
                           50, 51, 52, 53, 54, 55, 56, 57, 58])
_NOT_CODE = re.compile(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', re.IGNORECASE)


def date_styles(styles: bytes | None) -> set[int]:
    """Indexes of the cell styles whose number format shows a date or a time."""
    if not styles:
        return set()
    root = ET.fromstring(styles)
    own = {f.get("numFmtId") for f in root.findall("m:numFmts/m:numFmt", _NS)
           if re.search("[dmyhs]", _NOT_CODE.sub("", f.get("formatCode", "").split(";")[0]), re.IGNORECASE)}
    return {i for i, xf in enumerate(root.findall("m:cellXfs/m:xf", _NS))
            if xf.get("numFmtId") in own or int(xf.get("numFmtId") or 0) in _DATE_FORMATS}


def serial_text(v: str, from_1904: bool = False) -> str:
    """A date serial as Python's str() shows the loaded date and time; under a day, the time alone."""
    days = float(v)
    if 0 <= days < 1 and not from_1904:
        return str((datetime(1900, 1, 1) + timedelta(seconds=round(days * 86400))).time())
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 31 if days < 60 else 30)
    return str(start + timedelta(days=int(days), seconds=round((days - int(days)) * 86400)))


def _iso_text(v: str) -> str:
    v = v.strip().rstrip("Z")
    return str(datetime.fromisoformat(v)) if "-" in v else str(time.fromisoformat(v))


class _Workbook:
    """One open workbook: names and parts of its sheets, shared strings, date styles."""

    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        book = ET.fromstring(self.zip.read("xl/workbook.xml"))
        rels = ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        targets = {r.get("Id"): r.get("Target") for r in rels.findall("pr:Relationship", _NS)}
        self.sheets = []
        for s in book.findall("m:sheets/m:sheet", _NS):
            target = targets[s.get(f"{{{_NS['r']}}}id")]
            self.sheets.append((s.get("name"), target.lstrip("/") if target.startswith("/") else "xl/" + target))
        props = book.find("m:workbookPr", _NS)
        self.from_1904 = props is not None and props.get("date1904") in ("1", "true")
        self.dates = date_styles(self.zip.read("xl/styles.xml") if "xl/styles.xml" in names else None)
        self.shared = []
        if "xl/sharedStrings.xml" in names:
            self.shared = [_text(si) for si in ET.fromstring(self.zip.read("xl/sharedStrings.xml")).findall("m:si", _NS)]

    def value(self, c) -> str | None:
        kind, v = c.get("t", "n"), c.find("m:v", _NS)
        if kind == "inlineStr":
            inline = c.find("m:is", _NS)
            return _text(inline) if inline is not None else None
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.shared[int(v.text)]
        if kind == "b":
            return "True" if v.text.strip() == "1" else "False"
        if kind in ("str", "e"):
            return v.text
        if kind == "d":
            return _iso_text(v.text)
        return serial_text(v.text, self.from_1904) if int(c.get("s") or 0) in self.dates else _number(v.text)

    def rows(self, path: str, last_row: int | None, last_col: int | None):
        """``("cell", row, col, value)`` and ``("merge", r1, c1, r2, c2)``, one sheet row in memory at a time.

        A row or cell without a position follows the one before it.
        """
        row_no = 0
        with self.zip.open(path) as part:
            for _, el in ET.iterparse(part):
                if el.tag == _TAG + "row":
                    row_no = int(el.get("r") or row_no + 1)
                    col = 0
                    for c in el.findall("m:c", _NS):
                        row, col = _ref(c.get("r")) if c.get("r") else (row_no, col + 1)
                        if (last_row is None or row <= last_row) and (last_col is None or col <= last_col):
                            value = self.value(c)
                            if value is not None:
                                yield "cell", row, col, value
                    el.clear()
                elif el.tag == _TAG + "mergeCell":
                    a, _, b = el.get("ref").partition(":")
                    yield ("merge", *_ref(a), *_ref(b or a))
                    el.clear()


_TAG = "{" + _NS["m"] + "}"


def decode_workbook(name: str, content: bytes, sheet: str | None = None, last_row: int | None = None,
                    last_col: int | None = None) -> Iterator[dict]:
    """Rows of DECODED_SCHEMA for one workbook: cells, merges, and one row that names its sheets.

    With ``sheet`` only that sheet is decoded, with the bounds only cells within them.
    """
    book = _Workbook(content)
    for title, path in book.sheets:
        if sheet is None or title == sheet:
            for kind, row, col, *more in book.rows(path, last_row, last_col):
                out = dict(kind=kind, file=name, sheet=title, row=row, col=col)
                yield out | (dict(value=more[0]) if kind == "cell" else dict(max_row=more[0], max_col=more[1]))
    yield dict(kind="sheets", file=name, message="\t".join(s for s, _ in book.sheets))


#: Decoded rows in one output batch.
CHUNK_ROWS = 20_000
_COLUMNS = ["kind", "file", "sheet", "row", "col", "value", "max_row", "max_col", "message"]


def _frame(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_COLUMNS, dtype=object)
    return frame.where(frame.notna(), None)


def _decoder(sheet: str | None, last_row: int | None, last_col: int | None):
    """Decode file by file in chunks.  A file that fails gives an error row and none of its cells:
    its rows are held back until it has been read."""
    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                name = os.path.basename(str(path))
                try:
                    rows = list(decode_workbook(name, bytes(content), sheet, last_row, last_col))
                except Exception as e:  # noqa: BLE001 - a bad file is a status row
                    rows = [dict(kind="error", file=name, message=f"{type(e).__name__}: {e}")]
                for i in range(0, len(rows), CHUNK_ROWS):
                    yield _frame(rows[i:i + CHUNK_ROWS])
    return run


def list_workbooks(spark: SparkSession, folder: str, pattern: str = "*.xls*") -> DataFrame:
    """``(path, content)`` of the folder's workbooks, non-recursive, by path."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "false").load(folder).select("path", "content"))


@dataclass
class WorkbookScan:
    decoded: DataFrame

    @property
    def cells(self) -> DataFrame:
        return self.decoded.where(F.col("kind") == "cell").select("file", "sheet", "row", "col", "value")

    @property
    def merges(self) -> DataFrame:
        return self.decoded.where(F.col("kind") == "merge").select(
            "file", "sheet", F.col("row").alias("min_row"), F.col("col").alias("min_col"), "max_row", "max_col")

    def files(self) -> DataFrame:
        """Every file seen, with its decode error (null when it decoded)."""
        d = self.decoded.where(F.col("kind").isin("sheets", "error"))
        return d.select("file", F.when(F.col("kind") == "error", F.col("message")).alias("error"),
                        F.when(F.col("kind") == "sheets", F.split("message", "\t")).alias("sheets"))


def scan_workbooks(spark: SparkSession, folder: str, pattern: str = "*.xls*", sheet: str | None = None,
                   last_row: int | None = None, last_col: int | None = None) -> WorkbookScan:
    """Decode every workbook of ``folder`` once; the rows are checkpointed for the three consumers."""
    from shoal.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    return decode_files(list_workbooks(spark, folder, pattern), sheet, last_row, last_col)


def decode_files(files: DataFrame, sheet: str | None = None, last_row: int | None = None,
                 last_col: int | None = None) -> WorkbookScan:
    """Decode ``files(path, content)``, each in one task, and checkpoint the rows."""
    decoder = _decoder(sheet, last_row, last_col)
    return WorkbookScan(files.select("path", "content").mapInPandas(decoder, DECODED_SCHEMA).checkpoint())


def file_status(scan: WorkbookScan, records: DataFrame, sheet: str = G.TARGET_SHEET) -> DataFrame:
    """``(file, status, record_count, message)`` for every file."""
    counts = records.groupBy(F.col("source_file").alias("file")).agg(F.count(F.lit(1)).alias("record_count"))
    f = scan.files().join(counts, "file", "left")
    has_sheet = F.array_contains(F.coalesce("sheets", F.array().cast("array<string>")), sheet)
    status = F.when(F.col("error").isNotNull(), F.lit("error")).when(~has_sheet, F.lit("skipped")) \
        .otherwise(F.lit("success"))
    message = F.when(F.col("error").isNotNull(),
                     F.format_string(READ_ERROR.replace("{file}", "%s").replace("{error}", "%s"),
                                     F.col("file"), F.col("error"))) \
        .when(~has_sheet, F.format_string(MISSING_SHEET.replace("{file}", "%s").replace("{sheet}", "%s"),
                                          F.col("file"), F.lit(sheet)))
    return f.select("file", status.alias("status"),
                    F.when(status == "success", F.coalesce("record_count", F.lit(0))).cast("bigint").alias("record_count"),
                    message.alias("message"))


def load_workbooks(spark: SparkSession, folder: str, params: G.GridParams = G.GridParams(),
                   require_records: bool = True):
    """S1-S5 + G1-G19: ``(records, file_status, column_scores)`` from a folder of workbooks."""
    from shoal.operators.filters import require_nonempty
    scan = scan_workbooks(spark, folder, sheet=params.sheet, last_row=params.last_extracted_row)
    filled = G.filled_sheet(scan.cells, scan.merges, params)
    records = G.extract_filled(filled, params)
    status = file_status(scan, records, params.sheet)
    scores = G.score_columns(filled, params)
    if require_records:
        require_nonempty(records, NO_RECORDS)
    return records, status, scores
