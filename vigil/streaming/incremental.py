"""Incremental scanning of newly published files with Structured Streaming.

No new rules: each micro-batch of ``files`` rows that lands in a source
directory runs through the same batch operators (text, signature,
obfuscation and code rules) inside ``foreachBatch``, and the findings are
appended to a parquet sink.  Exactly-once comes from the streaming
checkpoint plus an idempotent write keyed by the batch id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FILES


def scan_batch(batch: DataFrame, engines=("pattern",)) -> DataFrame:
    """Findings of one micro-batch (behavior engines only: manifest rules
    need a package's complete file set, so they stay in the batch scan)."""
    from ..plans.scan import collect_findings
    return collect_findings(batch, engines=engines)


def start_incremental_scan(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                           engines=("pattern",), trigger_once: bool = False, max_files_per_trigger: int = 1000):
    """Watch ``source_dir`` (parquet files with the FILES schema) and append
    findings to ``sink_dir``; returns the StreamingQuery."""
    stream = (spark.readStream.schema(FILES).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))

    def write(batch: DataFrame, batch_id: int) -> None:
        f = scan_batch(batch, engines).withColumn("batch_id", F.lit(batch_id))
        # overwrite only this batch's partition: a replayed batch rewrites the same output
        (f.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(sink_dir))

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")
    return w.start()
