"""CSV export with the cluster number and name, no internal columns."""
import glob
import tempfile

from shoal.sources.sinks import export_csv


def test_export_csv(spark):
    recs = spark.createDataFrame([(1, "s", "b", "x", "", "A", "使命", "x")],
                                 "record_id long, store string, block string, summary string, detail string, "
                                 "category string, category_name string, _document_text string")
    asg = spark.createDataFrame([(1, 0)], "record_id long, cluster int")
    cards = spark.createDataFrame([(0, "ラベル")], "cluster int, label string")
    out = tempfile.mkdtemp(prefix="shoal-csv-") + "/out"
    export_csv(recs, out, asg, cards)
    text = "".join(open(p, encoding="utf-8").read() for p in glob.glob(out + "/*.csv"))
    assert text.startswith("record_id,店舗名") and "クラスタ番号,クラスタ名" in text
    assert "_document_text" not in text and "ラベル" in text and not text.startswith("﻿")


def test_texts_read_back_as_they_were(spark):
    texts = ['say "hi", ok', " lead", "trail ", "", "two\nlines", "back\\slash", "a,b"]
    recs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "record_id long, summary string")
    asg = spark.createDataFrame([(0, 3)], "record_id long, cluster int")
    out = tempfile.mkdtemp(prefix="shoal-csv-") + "/out"
    export_csv(recs, out, asg, reference_headers=False)
    import csv
    rows = []
    for p in glob.glob(out + "/*.csv"):
        with open(p, encoding="utf-8", newline="") as f:
            rows += list(csv.reader(f))[1:]
    assert {int(r[0]): r[1] for r in rows} == dict(enumerate(texts))
    assert {int(r[0]): r[2] for r in rows} == {i: "3" if i == 0 else "" for i in range(len(texts))}
