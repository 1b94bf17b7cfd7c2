"""Role binding onto the canonical record schema and the row gates."""
import pytest
from pyspark.sql import functions as F

from shoal.operators import filters as FL
from shoal.sources.tables import RECORD_COLUMNS, Roles


def test_bind_defaults_and_document_text(spark):
    df = spark.createDataFrame([(7, "shop", "title", " body ", "b"), (8, "shop", "t2", "", None)],
                               "id long, shop string, title string, body string, cat string")
    out = Roles(record_id="id", store="shop", summary="title", detail="body", category="cat").bind(df)
    assert out.columns == RECORD_COLUMNS
    rows = {r["record_id"]: r for r in out.collect()}
    assert rows[7]["document_text"] == "body" and rows[7]["category_name"] == "利益" and rows[7]["block"] == ""
    assert rows[8]["document_text"] == "t2" and rows[8]["category_name"] == "未分類"


def test_min_rows_gate(spark):
    df = spark.range(2).select(F.col("id").alias("record_id"))
    with pytest.raises(FL.TooFewRecords):
        FL.require_min_rows(df, 3)
    FL.require_min_rows(spark.range(5), 3)
    with pytest.raises(FL.TooFewRecords):
        FL.require_nonempty(spark.range(0), "no records")
