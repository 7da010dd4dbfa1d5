"""Filters and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodlens.config import CAPTURE_TCP_PORTS, CAPTURE_UDP_PORTS
from floodlens.functions import columns as C

EVENT_STRING_COLS = ("severity", "event_type", "detection_status", "mitigation_status", "phase",
                     "session_id", "protocol_name", "src_ip", "dst_ip", "src_mac", "dst_mac",
                     "dpid_name", "attack_type", "attacker_segment", "event_note", "action", "reason",
                     "attacker_hostname", "segment_description", "note")


def prep(df: DataFrame, ts_col: str = "timestamp", tz: str | None = None,
         numeric: tuple = ("packet_rate", "packet_count", "threat_score")) -> DataFrame:
    """P1 on a text event/mitigation log: timestamp -> ``ts_us`` (bad -> null),
    numeric columns -> double (bad -> null), string columns null -> '' and
    trimmed.  Absent columns are skipped."""
    out = df
    if ts_col in df.columns:
        out = out.withColumn("ts_us", C.parse_ts_us(ts_col, tz=tz))
    for c in numeric:
        if c in df.columns:
            out = out.withColumn(c, C.to_double(c))
    for c in EVENT_STRING_COLS:
        if c in df.columns:
            out = out.withColumn(c, C.clean_str(c))
    return out


def capture_filter(df: DataFrame, proto: str = "protocol", sport: str = "sport",
                   dport: str = "dport") -> DataFrame:
    """icmp or arp or tcp port 5001/8080 or udp port 6001 (either end)."""
    tcp = [str(p) for p in CAPTURE_TCP_PORTS]
    udp = [str(p) for p in CAPTURE_UDP_PORTS]
    p = F.col(proto)
    keep = (p.isin("ICMP", "ARP")
            | ((p == "TCP") & (F.col(sport).isin(tcp) | F.col(dport).isin(tcp)))
            | ((p == "UDP") & (F.col(sport).isin(udp) | F.col(dport).isin(udp))))
    return df.filter(keep)


def admit_packets(df: DataFrame) -> DataFrame:
    """F5 on ``PACKET_OBS``: not LLDP, IPv4 present, ICMP only as echo request."""
    return df.filter((F.col("eth_type") != 0x88CC) & (F.col("eth_type") == 0x0800)
                     & F.col("src_ip").isNotNull()
                     & ((F.col("ip_proto") != 1) | (F.col("icmp_type") == 8)))


def edge_cleanup(df: DataFrame, edge_rate: float = 5.0, rate: str = "packet_rate_ewma") -> DataFrame:
    """drop label-1 rows with rate < edge (a null rate is kept)."""
    return df.filter(~((F.col("label") == 1) & F.coalesce(F.col(rate) < edge_rate, F.lit(False))))


def rate_range(df: DataFrame, lo: float = 10.0, hi: float = 200.0, rate: str = "packet_rate_ewma") -> DataFrame:
    """F8: closed range."""
    return df.filter(F.col(rate).between(lo, hi))


def pivot_slice(df: DataFrame, pivot: DataFrame, half_width_s: float = 30.0, pivot_col: str = "pivot_us") -> DataFrame:
    """rows within +-half_width (closed) of a one-row pivot (e.g. the first drop).
    The pivot is a single aggregated row, so it is broadcast."""
    hw = int(round(half_width_s * 1_000_000))
    p = F.broadcast(pivot.select(pivot_col))
    return (df.join(p, (F.col("ts_us") >= F.col(pivot_col) - hw) & (F.col("ts_us") <= F.col(pivot_col) + hw))
            .drop(pivot_col))


def drop_incomplete(df: DataFrame, cols=("ts_us", "packet_rate")) -> DataFrame:
    """F11."""
    return df.dropna(subset=list(cols))


def near_duplicates(df: DataFrame, tol_us: int, content: list[str], ts: str = "ts_us",
                    tie: str = "pkt_id") -> DataFrame:
    """Flag packets whose content hash and length equal an earlier packet
    within ``tol_us`` (``is_dup``).  Partitioned by (hash, len, time bucket);
    the previous packet of a bucket's first row comes from a one-row-per-bucket
    carry, so one hot payload does not land in a single task."""
    h = F.xxhash64(*[F.col(c) for c in content])
    bucket_us = max(tol_us * 1000, 1_000_000)
    x = (df.withColumn("_h", h).withColumn("_b", F.floor(F.col(ts) / F.lit(bucket_us)).cast("long")))
    w = Window.partitionBy("_h", "size", "_b").orderBy(ts, tie)
    x = x.withColumn("_prev", F.lag(ts).over(w))
    last = x.groupBy("_h", "size", "_b").agg(F.max(ts).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy("_h", "size").orderBy("_b"))) \
        .select("_h", "size", "_b", "_carry")
    return (x.join(carry, ["_h", "size", "_b"], "left")
            .withColumn("_p", F.coalesce("_prev", "_carry"))
            .withColumn("is_dup", F.coalesce(F.col(ts) - F.col("_p") <= tol_us, F.lit(False)))
            .drop("_h", "_b", "_prev", "_carry", "_p"))
