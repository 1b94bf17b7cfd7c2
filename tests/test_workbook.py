"""Workbook bytes -> records (FIXTURES goldens A and B, status rows)."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from shoal.sources import workbook as W
from tests.xlsx_fixture import template_sheet, write_xlsx

TEMPLATE_ROWS = [
    (7, "1.", None, "接客サービスの改善", "A"),
    (8, None, "(1)", "挨拶と笑顔の教育", "A"),
    (9, None, "(2)", "声の集計と改善", "A"),
    (10, "2.", None, "販売戦略の策定", "B"),
    (11, None, "(1)", "季節商品の早期展開", "B"),
    (12, None, "(2)", "ポイントカードの活用", "B"),
    (13, "3.", None, "能力開発の支援", "C"),
    (14, None, "(1)", "月次研修会の開催", "C"),
    (15, "4.", None, "業務の効率化", "E"),
    (16, None, "(1)", "在庫管理の見直し", "E"),
    (17, None, "(2)", "光熱費の削減", "E"),
]

MULTI_ROWS = [
    (7, "1.", None, "s1", "A"), (8, None, "(1)", "d1", "A"), (9, None, "(2)", "d2", "A"),
    (10, "2.", None, "s2", "B"), (11, None, "(1)", "d3", "B"),
    (12, "3.", None, "s3", "C"), (13, None, "(1)", "d4", "C"), (14, None, "(2)", "d5", "C"),
    (15, "4.", None, "s4", "D"), (16, None, "(1)", "d6", "D"),
    (17, "5.", None, "s5", "E"), (18, None, "(1)", "d7", "E"),
]


@pytest.fixture(scope="module")
def folder():
    d = tempfile.mkdtemp(prefix="shoal-xlsx-")
    cells, merges = template_sheet("東京本店", "B001", TEMPLATE_ROWS)
    write_xlsx(os.path.join(d, "a_template.xlsx"),
               [("提出用", cells, merges), ("作成例", {(1, 1): "ignored"}, [])])
    for i, (store, block) in enumerate([("東京本店", "B001"), ("大阪支店", "B002"), ("名古屋支店", "B003")]):
        c, m = template_sheet(store, block, [(r, e, f, f"{store}{t}", cat) for r, e, f, t, cat in MULTI_ROWS])
        write_xlsx(os.path.join(d, f"b_multi_{i}.xlsx"), [("提出用", c, m)])
    write_xlsx(os.path.join(d, "c_nosheet.xlsx"), [("Sheet1", {(1, 1): "x"}, [])])
    with open(os.path.join(d, "d_corrupt.xlsx"), "wb") as fh:
        fh.write(b"not a zip file")
    return d


def test_template_and_multi(spark, folder):
    records, status, scores = W.load_workbooks(spark, folder)
    recs = records.orderBy("record_id").collect()
    tmpl = [r for r in recs if r["source_file"] == "a_template.xlsx"]
    assert len(tmpl) == 7
    assert [r["category"] for r in tmpl] == ["A", "A", "B", "B", "C", "E", "E"]
    assert [r["category_name"] for r in tmpl][:3] == ["使命", "使命", "利益"]
    assert all(r["store"] == "東京本店" and r["block"] == "B001" for r in tmpl)
    assert all(r["document_text"] == r["detail"] for r in tmpl)
    assert tmpl[0]["summary"] == "接客サービスの改善" and tmpl[0]["detail"] == "挨拶と笑顔の教育"
    multi = [r for r in recs if r["source_file"].startswith("b_multi")]
    assert len(multi) == 21
    assert len({r["store"] for r in multi}) == 3
    from collections import Counter
    assert Counter(r["category"] for r in multi) == {"A": 6, "B": 3, "C": 6, "D": 3, "E": 3}
    assert sum(1 for r in recs if r["detail"] == "") == 0
    st = {r["file"]: r for r in status.collect()}
    assert st["a_template.xlsx"]["status"] == "success" and st["a_template.xlsx"]["record_count"] == 7
    assert st["c_nosheet.xlsx"]["status"] == "skipped" and "提出用" in st["c_nosheet.xlsx"]["message"]
    assert st["d_corrupt.xlsx"]["status"] == "error"
    sc = {(r["file"], r["col"]): r for r in scores.collect()}
    assert sc[("a_template.xlsx", 18)]["matched_count"] == 11
    assert abs(sc[("a_template.xlsx", 18)]["score"] - 0.055) < 1e-12
    assert abs(sc[("b_multi_0.xlsx", 18)]["score"] - 0.06) < 1e-12
    assert sc[("a_template.xlsx", 16)]["score"] == 0.0
