"""Incremental ingest: a second run picks up only the new workbook."""
import os
import tempfile

from shoal.streaming.ingest import ingest_stream
from tests.test_workbook import MULTI_ROWS
from tests.xlsx_fixture import template_sheet, write_xlsx


def _write(folder, name, store):
    c, m = template_sheet(store, "B9", [(r, e, f, f"{store}{t}", cat) for r, e, f, t, cat in MULTI_ROWS])
    write_xlsx(os.path.join(folder, name), [("提出用", c, m)])


def test_incremental_ingest(spark):
    src, out, ck = (tempfile.mkdtemp(prefix=f"shoal-{k}-") for k in ("src", "out", "ck"))
    _write(src, "one.xlsx", "店A")
    ingest_stream(spark, src, out, ck).awaitTermination(300)
    assert spark.read.parquet(f"{out}/records").count() == 7
    _write(src, "two.xlsx", "店B")
    ingest_stream(spark, src, out, ck).awaitTermination(300)
    recs = spark.read.parquet(f"{out}/records")
    assert recs.count() == 14
    assert recs.select("record_id").distinct().count() == 14
    assert {r["store"] for r in recs.select("store").distinct().collect()} == {"店A", "店B"}
