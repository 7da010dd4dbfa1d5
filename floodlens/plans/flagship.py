"""The flagship query: per-source detection summary with latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.operators.report import attacker_stats, latencies
from floodlens.plans.detector import detector
from floodlens.plans.fixture import ALL_SOURCES, CHUNK_S, ENTRY_TH
from floodlens.sources.adapter import packets


def flagship(spark: SparkSession, sf_dir: str, th=ENTRY_TH, dims=ALL_SOURCES) -> DataFrame:
    det = detector(packets(spark, sf_dir), th, dims, CHUNK_S)  # a written table
    drops = det.groupBy("src_ip").agg(F.min(F.when(F.col("trigger"), F.col("ts_us"))).alias("drop_us"))
    return attacker_stats(det).join(drops, "src_ip", "left").join(latencies(det), "src_ip", "left").orderBy("src_ip")
