"""Dimension lookups.

The dimension tables are the fixed topology (<= 25 rows each), so they are
broadcast: their size is bounded by construction, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.config import SEGMENT_PATTERN, Dims


def watchlist_df(spark: SparkSession, dims: Dims = Dims()) -> DataFrame:
    rows = [(ip, host, dpid, SEGMENT_PATTERN.format(dpid=dpid, host=host))
            for ip, host, dpid in (dims.watchlist or ())]
    return spark.createDataFrame(rows, "w_ip string, w_host string, w_dpid int, w_segment string")


def switch_df(spark: SparkSession, dims: Dims = Dims()) -> DataFrame:
    return spark.createDataFrame(list(dims.switches), "s_dpid int, s_name string")


def host_df(spark: SparkSession, dims: Dims = Dims()) -> DataFrame:
    return spark.createDataFrame(list(dims.host_table), "h_host string, h_ip string, h_dpid int")


def with_watchlist(df: DataFrame, ip: str = "src_ip", dims: Dims = Dims()) -> DataFrame:
    """J1 + J2: host (default UNKNOWN), segment switch and description
    (defaults NORMAL_HOST / UNKNOWN_SEGMENT), ``is_watched``."""
    if not dims.watchlist:  # no watchlist: every source is detected
        return (df.withColumn("attacker_host", F.lit("UNKNOWN"))
                .withColumn("attacker_segment", F.lit("NORMAL_HOST"))
                .withColumn("segment_description", F.lit("UNKNOWN_SEGMENT"))
                .withColumn("segment_dpid", F.lit(None).cast("int"))
                .withColumn("is_watched", F.lit(True)))
    w = F.broadcast(watchlist_df(df.sparkSession, dims))
    return (df.join(w, F.col(ip) == F.col("w_ip"), "left")
            .withColumn("attacker_host", F.coalesce("w_host", F.lit("UNKNOWN")))
            .withColumn("attacker_segment", F.coalesce("w_segment", F.lit("NORMAL_HOST")))
            .withColumn("segment_description", F.coalesce("w_segment", F.lit("UNKNOWN_SEGMENT")))
            .withColumn("segment_dpid", F.col("w_dpid"))
            .withColumn("is_watched", F.col("w_ip").isNotNull())
            .drop("w_ip", "w_host", "w_dpid", "w_segment"))


def with_switch_name(df: DataFrame, dpid: str = "dpid", out: str = "dpid_name", dims: Dims = Dims()) -> DataFrame:
    """Dpid -> switch name, default 'unknown'."""
    s = F.broadcast(switch_df(df.sparkSession, dims))
    return (df.join(s, F.col(dpid) == F.col("s_dpid"), "left")
            .withColumn(out, F.coalesce("s_name", F.lit("unknown"))).drop("s_dpid", "s_name"))


def with_role(df: DataFrame, ip: str = "src_ip", future: list[str] | None = None,
              dims: Dims = Dims()) -> DataFrame:
    """Role of a source: attacker (watchlisted), future attacker (listed in
    ``future``, e.g. in a baseline run), else normal."""
    w = F.broadcast(watchlist_df(df.sparkSession, dims).select("w_ip"))
    watched = F.col("w_ip").isNotNull()
    role = F.when(watched & F.lit(future is not None), "future attacker").when(watched, "attacker")
    if future:
        role = F.when(F.col(ip).isin(future), "future attacker").when(watched, "attacker")
    return (df.join(w, F.col(ip) == F.col("w_ip"), "left")
            .withColumn("role", role.otherwise("normal")).drop("w_ip"))


def with_display_label(df: DataFrame, ip: str = "src_ip", out: str = "label", dims: Dims = Dims()) -> DataFrame:
    """``host (ip)`` for watchlisted ips, the ip otherwise."""
    w = F.broadcast(watchlist_df(df.sparkSession, dims).select("w_ip", "w_host"))
    return (df.join(w, F.col(ip) == F.col("w_ip"), "left")
            .withColumn(out, F.coalesce(F.concat(F.col("w_host"), F.lit(" ("), F.col(ip), F.lit(")")), F.col(ip)))
            .drop("w_ip", "w_host"))


def with_host(df: DataFrame, ip: str, out: str, dims: Dims = Dims()) -> DataFrame:
    """Topology host name and access switch of an ip (null when not a host)."""
    h = F.broadcast(host_df(df.sparkSession, dims))
    return (df.join(h, F.col(ip) == F.col("h_ip"), "left")
            .withColumnRenamed("h_host", out).withColumnRenamed("h_dpid", f"{out}_dpid").drop("h_ip"))
