from pyspark.sql import functions as F

from shoal.llm import common as C


def test_first_by_hash_takes_the_smallest_of_each_group(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), "id", F.xxhash64("id").alias("h"))
    got = C.first_by_hash(rows, "g", "h", {0: 40, 1: 5000, 7: 3}, ["id"]).collect()
    every = [(r["g"], (r["h"] % (1 << 64)) >> 11, r["id"]) for r in rows.collect()]
    want = sorted(x for x in every if x[0] == 0)[:40] + [x for x in every if x[0] == 1]
    assert sorted(r["id"] for r in got) == sorted(x[2] for x in want)


def test_attach_joins_frequent_keys_too(spark, monkeypatch):
    monkeypatch.setattr(C, "HEAVY_ROWS", 10)
    rows = spark.range(1000).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id")).alias("k"), "id")
    values = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    got = C.attach(rows, values, ["k"], "n")
    assert got.columns == ["k", "id", "top"] and got.count() == 1000
    assert got.where("k = 0 and top = 599").count() == 600
    assert "LeftAnti" in got._jdf.queryExecution().optimizedPlan().toString()
