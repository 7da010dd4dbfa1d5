"""ST1: streaming tumbling flow features (W9 without the EWMA) and ST4 in
its aggregate form (session windows closed after the idle gap)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.streaming.source import EVENT_TIME


def _sample_std_of_gaps(ts_list):
    """Sample std (seconds) of the gaps between the sorted µs timestamps of a
    window; ``lag`` is refused on streams, so gaps come from the collected
    timestamps after the aggregation."""
    a = F.array_sort(ts_list)
    n = F.size(a)
    gaps = F.zip_with(F.slice(a, 2, n), F.slice(a, 1, n - 1), lambda x, y: (x - y).cast("double") / 1_000_000.0)
    m = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g) / (n - 1)
    ss = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + (g - m) * (g - m))
    return F.sqrt(ss / (n - 2))


def flow_features_stream(pk: DataFrame, width: str = "1 second", keys=("src_ip", "dst_ip")) -> DataFrame:
    """One row per (flow, aligned window) once the watermark closes the window."""
    n = F.col("packet_count_1s")
    agg = (pk.groupBy(F.window(EVENT_TIME, width), *keys)
           .agg(F.count(F.lit(1)).alias("packet_count_1s"),
                F.sum(F.col("size").cast("long")).alias("byte_count_1s"),
                F.avg(F.col("size").cast("double")).alias("avg_pkt_size"),
                F.stddev_samp(F.col("size").cast("double")).alias("_ss"),
                F.collect_list("ts_us").alias("_ts")))
    return agg.select(
        *keys, F.unix_micros(F.col("window.end")).alias("window_end_us"), "packet_count_1s", "byte_count_1s",
        "avg_pkt_size",
        F.when(n >= 2, F.coalesce("_ss", F.lit(0.0))).otherwise(0.0).alias("pkt_size_std"),
        F.when(n >= 3, _sample_std_of_gaps(F.col("_ts"))).otherwise(0.0).alias("inter_arrival_std"))


def session_windows_stream(pk: DataFrame, gap: str, key: str = "session_id") -> DataFrame:
    """ST4: a session ends when it has been idle longer than ``gap``; its row is
    emitted (and its state dropped) once the watermark passes the end."""
    s = (pk.groupBy(F.session_window(EVENT_TIME, gap), key)
         .agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("last_us"),
              F.count(F.lit(1)).alias("packets")))
    return s.select(key, "start_us", "last_us", "packets")
