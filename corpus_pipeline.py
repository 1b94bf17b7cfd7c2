"""The corpus pipeline: five stages over ``documents``, each calling one operator of ``shoal.llm``.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept,
and returns the documents with their own columns; the last adds ``shard``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoal.llm import decontam, langid, mixing, sharding, simhash
from shoal.llm.common import documents, materialise, prepare, table

#: Documents whose pooled probability is lower are rejected by the language stage, as are those without a letter.
MIN_LANG_SCORE = 0.35
#: Shingle length and largest bit distance of the near-dedup stage.
SHINGLE, MAX_BITS = 3, 3
SHARDS = 16


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents of no known language go (no letter, or too low a score).

    The network learns from the texts and non-null ``lang`` of documents that are
    not held out.  Null and empty texts have no language and go.
    """
    prepare(spark)
    return langid.keep_known(docs, langid.fit(docs), MIN_LANG_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of linked fingerprints, the document with the smallest id stays."""
    prepare(spark)
    return simhash.simhash_dedup(docs, width=SHINGLE, max_bits=MAX_BITS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold an item of ``benchmark`` go."""
    prepare(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: sources to equal weights, as many rows as came in, shuffled; a document may repeat or be left out."""
    prepare(spark)
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: 16 shards of nearly equal bytes; adds ``shard``."""
    prepare(spark)
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: The first stage is a trained network, which SQL cannot express; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each kept is written to the shared folder and read by the next."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
