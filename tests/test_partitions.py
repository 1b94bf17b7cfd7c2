"""Partition invariance: the same result at 1 and 8 shuffle partitions."""
import pytest

from tests.compare import rows_of_spark
from shoal.plans.queries import QUERIES
from tests.conftest import SF01


@pytest.mark.parametrize("name", ["w1_top_words", "l4_cluster_cards", "g17_emit_records", "t4_vocab_top",
                                  "m6_silhouette", "a6_cluster_stats"])
def test_same_at_1_and_8_partitions(spark, name):
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            results.append(sorted(rows_of_spark(QUERIES[name](spark, SF01))[1], key=repr))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
