"""Structured Streaming ingest of a watched workbook folder.

The reference re-reads the chosen files on every run; here new files are
picked up incrementally.  ``readStream.format("binaryFile")`` tracks which
files were seen (in the checkpoint), and every micro-batch runs the same
batch operators as :func:`shoal.sources.workbook.load_workbooks`.  Each batch
overwrites its own ``batch_id=N`` partition, so a retried batch replaces its
output instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoal.operators import grid as G
from shoal.session import ensure_checkpoint_dir
from shoal.sources import workbook as W

BATCH_ID_SHIFT = 40  # record_id = batch_id << 40 | (file ordinal * 1000 + row)


def _write_batch(output: str, params: G.GridParams):
    def run(files: DataFrame, batch_id: int) -> None:
        ensure_checkpoint_dir(files.sparkSession)
        scan = W.decode_files(files, params.sheet, params.last_extracted_row)
        recs = G.extract_records(scan.cells, scan.merges, params)
        recs = recs.withColumn("record_id", F.col("record_id") + F.lit(batch_id << BATCH_ID_SHIFT))
        recs.write.mode("overwrite").parquet(f"{output}/records/batch_id={batch_id}")
        W.file_status(scan, recs, params.sheet).write.mode("overwrite") \
            .parquet(f"{output}/file_status/batch_id={batch_id}")
    return run


def ingest_stream(spark: SparkSession, folder: str, output: str, checkpoint_location: str,
                  params: G.GridParams = G.GridParams(), available_now: bool = True,
                  max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the ingest; with ``available_now`` it processes what is there and stops."""
    schema = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
    reader = (spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.xls*")
              .option("recursiveFileLookup", "false"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.load(folder)
    writer = (stream.writeStream.foreachBatch(_write_batch(output, params))
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
