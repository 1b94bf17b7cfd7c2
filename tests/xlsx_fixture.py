"""Tiny xlsx writer for tests (zip of XML parts, shared strings, merges)."""
import zipfile
from xml.sax.saxutils import escape

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def col_letters(c: int) -> str:
    s = ""
    while c:
        c, r = divmod(c - 1, 26)
        s = chr(65 + r) + s
    return s


def write_xlsx(path, sheets):
    """sheets: list of (name, {(row, col): value}, [merge refs])."""
    strings, index = [], {}

    def sid(v):
        if v not in index:
            index[v] = len(strings)
            strings.append(v)
        return index[v]

    parts = {}
    for i, (name, cells, merges) in enumerate(sheets, 1):
        rows = {}
        for (r, c), v in sorted(cells.items()):
            rows.setdefault(r, []).append((c, v))
        xml = [f'<worksheet xmlns="{MAIN}"><sheetData>']
        for r, cs in sorted(rows.items()):
            xml.append(f'<row r="{r}">')
            for c, v in cs:
                ref = f"{col_letters(c)}{r}"
                if isinstance(v, str):
                    xml.append(f'<c r="{ref}" t="s"><v>{sid(v)}</v></c>')
                else:
                    xml.append(f'<c r="{ref}"><v>{v}</v></c>')
            xml.append("</row>")
        xml.append("</sheetData>")
        if merges:
            xml.append(f'<mergeCells count="{len(merges)}">' + "".join(f'<mergeCell ref="{m}"/>' for m in merges)
                       + "</mergeCells>")
        xml.append("</worksheet>")
        parts[f"xl/worksheets/sheet{i}.xml"] = "".join(xml)
    wb = [f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>']
    rels = ['<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">']
    for i, (name, _, _) in enumerate(sheets, 1):
        wb.append(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"/>')
        rels.append(f'<Relationship Id="rId{i}" Type="{REL}/worksheet" Target="worksheets/sheet{i}.xml"/>')
    wb.append("</sheets></workbook>")
    rels.append("</Relationships>")
    parts["xl/workbook.xml"] = "".join(wb)
    parts["xl/_rels/workbook.xml.rels"] = "".join(rels)
    parts["xl/sharedStrings.xml"] = (f'<sst xmlns="{MAIN}">' + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings)
                                     + "</sst>")
    parts["[Content_Types].xml"] = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>'
    with zipfile.ZipFile(path, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)


def template_sheet(store, block, rows):
    """rows: (row, summary marker or None, detail marker or None, text, category letter)."""
    cells = {(4, 4): store, (4, 14): block, (6, 5): "番号", (6, 6): "概要", (6, 7): "詳細", (6, 18): "カテゴリ"}
    merges = ["D4:G4", "N4:O4"]
    for r, e, f, text, cat in rows:
        if e:
            cells[(r, 5)] = e
            cells[(r, 6)] = text
            merges.append(f"F{r}:O{r}")
        elif f:
            cells[(r, 6)] = f
            cells[(r, 7)] = text
            merges.append(f"G{r}:O{r}")
        cells[(r, 18)] = f"【{cat}】"
    return cells, merges
