"""ST5: stream-static enrichment with "is any mitigation active" (J6).

The mitigation table changes while the stream runs, so it is re-read in
every micro-batch (``foreachBatch``) and joined with the batch's rows by the
same interval-existence join as the batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from floodlens.operators.mitigate import merge_intervals, with_mitigation_active


def enrich_batch(spark: SparkSession, mitigation_table: str, bucket_s: float = 300.0):
    """A ``foreach_batch(batch, id, table)`` function for ``run_available_now``:
    writes the batch's rows with ``any_mitigation`` to ``table/batch_id=<id>``
    (overwrite, so a retried batch replaces its own output: idempotent).  The
    interval table (``start_us``, ``end_us``) is read from ``mitigation_table``."""

    def run(batch: DataFrame, batch_id: int, table: str) -> None:
        iv = spark.read.parquet(mitigation_table).select("start_us", "end_us")
        out = with_mitigation_active(batch, merge_intervals(iv), bucket_s, out="any_mitigation")
        out.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return run
