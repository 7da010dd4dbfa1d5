"""Streaming sources and the sink runner."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.session import checkpoint_dir
from floodlens.sources.adapter import TIME_DIVISOR, packets_from_events

EVENT_TIME = "event_time"
#: how long the stream waits for rows that arrive out of order
WATERMARK = "10 seconds"
#: id of the row that closes a replayed stream
CLOSING_ID = -(2 ** 63)


def replay(spark: SparkSession, sf_dir: str, slices: int = 4) -> tuple[str, int]:
    """The events as files in time order, to be streamed slice by slice, and the
    number of files a slice.  A closing row a hundred years later ends the
    stream: the watermark passes all real rows, so that what is still open
    (windows, sessions, rows that wait for their order) is emitted."""
    from floodlens.sources.adapter import read_events
    path = f"{checkpoint_dir(spark).rstrip('/')}/floodlens-replay/{uuid.uuid4().hex[:12]}"
    events = read_events(spark, sf_dir)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = events.agg(F.min(at), F.max(at)).first()
    files = max(1, events.rdd.getNumPartitions() // slices)
    if lo is not None:
        step = (hi - lo) // slices + 1
        for k in range(slices):
            events.where((at >= lo + k * step) & (at < lo + (k + 1) * step)).coalesce(files).write.mode("append").parquet(path)
    last = events.limit(1).withColumns({"event_id": F.lit(CLOSING_ID).cast(events.schema["event_id"].dataType),
                                        "ts": (F.timestamp_micros(F.lit(hi or 0)) + F.expr("INTERVAL 100 YEARS")).cast(events.schema["ts"].dataType)})
    last.write.mode("append").parquet(path)
    return path, files


def event_stream(spark: SparkSession, directory: str, glob: str = "*.parquet",
                 files_per_trigger: int | None = None) -> DataFrame:
    """``readStream`` over the parquet files of ``directory`` matching ``glob``
    (new files are picked up as they land).  The schema is taken from the
    files' footers, never inferred from rows."""
    from floodlens.session import ensure_utc
    ensure_utc(spark)
    schema = spark.read.option("pathGlobFilter", glob).parquet(directory).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(directory)


def packet_stream(spark: SparkSession, directory: str, glob: str = "*.parquet", watermark: str = WATERMARK,
                  files_per_trigger: int | None = None, divisor: int = TIME_DIVISOR) -> DataFrame:
    """The packet view over an event stream, with ``event_time`` and a watermark
    (tracked over every packet, before any slice is taken).  The row that
    closes a replay moves the watermark and goes no further."""
    pk = packets_from_events(event_stream(spark, directory, glob, files_per_trigger), divisor)
    pk = pk.withColumn(EVENT_TIME, F.timestamp_micros("ts_us")).withWatermark(EVENT_TIME, watermark)
    # Spark moves filters that don't name the event time below the watermark, which must see every
    # packet and the closing row; so every column names it (rows without a time aren't streamed)
    timed = F.col(EVENT_TIME).isNotNull()
    held = [F.col(c) if c == EVENT_TIME else F.when(timed, F.col(c)).alias(c) for c in pk.columns]
    return pk.select(*held).filter(F.col("pkt_id") != CLOSING_ID)


def late_rows(rows: DataFrame, folded: DataFrame, key: str = "pkt_id") -> DataFrame:
    """The rows of a finished stream's input that came after the watermark had
    passed them, for a side table: what the stream has not folded."""
    return rows.join(folded.select(key), key, "left_anti")


def run_available_now(df: DataFrame, name: str, mode: str = "append", foreach_batch=None,
                      out_schema=None) -> DataFrame:
    """Run a streaming query to the end of its input (``Trigger.AvailableNow``)
    into a parquet table under the shared checkpoint folder, with its own
    checkpoint location (restartable after a failure), and return the table.
    ``foreach_batch(batch_df, batch_id, table_path)`` replaces the file sink."""
    spark = df.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/floodlens-streams/{name}-{uuid.uuid4().hex[:12]}"
    table = f"{base}/table"
    w = df.writeStream.option("checkpointLocation", f"{base}/_checkpoint").outputMode(mode)
    if foreach_batch is not None:
        w = w.foreachBatch(lambda b, i: foreach_batch(b, i, table))
    else:
        w = w.format("parquet").option("path", table)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    schema = out_schema if foreach_batch is not None else df.schema
    return spark.read.schema(schema).parquet(table) if schema is not None else spark.read.parquet(table)
