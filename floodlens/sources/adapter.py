"""Packet view over the driver's ``events`` table.

The driver's tables carry no packets, so the tests present ``events`` as a
packet stream: user -> source host, event id -> destination (every third
event goes to the victim), event type -> protocol, value -> size.  Time is
compressed by ``time_divisor`` (30 days -> 60 s at the default) so that the
1 s rate window sees more than one packet.  The same projection is written
as SQL for the DuckDB oracle (``ADAPTER_SQL``); only the time expression
differs between the engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIME_DIVISOR = 43200

_ADAPTER = """
SELECT event_id AS pkt_id, {ts_us} AS ts_us,
  concat('10.0.0.', CAST(user_id % 25 + 1 AS {string})) AS src_ip,
  concat('10.0.0.', CAST(CASE WHEN event_id % 3 = 0 THEN 25 ELSE event_id % 25 + 1 END AS {string})) AS dst_ip,
  CASE event_type WHEN 'view' THEN 'ICMP' WHEN 'click' THEN 'ICMP' WHEN 'purchase' THEN 'TCP'
                  WHEN 'signup' THEN 'UDP' ELSE 'ARP' END AS protocol,
  CAST(floor(value) AS INT) + 42 AS size,
  CAST(user_id % 5 + 2 AS INT) AS dpid
FROM {events}
"""


def adapter_sql(engine: str = "duckdb", events: str = "events", divisor: int = TIME_DIVISOR) -> str:
    if engine == "duckdb":
        ts = f"epoch_us(ts) // {divisor}"
        return _ADAPTER.format(ts_us=ts, string="VARCHAR", events=events)
    ts = f"unix_micros(CAST(ts AS TIMESTAMP)) DIV {divisor}"
    return _ADAPTER.format(ts_us=ts, string="STRING", events=events)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from floodlens.session import ensure_utc
    ensure_utc(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def packets_from_events(events: DataFrame, divisor: int = TIME_DIVISOR) -> DataFrame:
    """``PACKETS`` view (pkt_id, ts_us, src_ip, dst_ip, protocol, size, dpid)."""
    ev = events
    dst_n = F.when(F.col("event_id") % 3 == 0, F.lit(25)).otherwise(F.col("event_id") % 25 + 1)
    proto = (F.when(F.col("event_type").isin("view", "click"), "ICMP")
             .when(F.col("event_type") == "purchase", "TCP")
             .when(F.col("event_type") == "signup", "UDP")
             .otherwise("ARP"))
    return ev.select(
        F.col("event_id").alias("pkt_id"),
        F.expr(f"unix_micros(CAST(ts AS TIMESTAMP)) DIV {divisor}").alias("ts_us"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 25 + 1).cast("string")).alias("src_ip"),
        F.concat(F.lit("10.0.0."), dst_n.cast("string")).alias("dst_ip"),
        proto.alias("protocol"),
        (F.floor("value").cast("int") + 42).alias("size"),
        (F.col("user_id") % 5 + 2).cast("int").alias("dpid"),
    )


def packets(spark: SparkSession, sf_dir: str, divisor: int = TIME_DIVISOR) -> DataFrame:
    return packets_from_events(read_events(spark, sf_dir), divisor)


# ----------------------------------------------------------------------------
# Derived raw views (the driver ships no logs or captures): text event log
# and packet observations, each with a rule-derived share of malformed values.
# ----------------------------------------------------------------------------
def event_text(pk: DataFrame) -> DataFrame:
    """A text event log as the collector writes it: naive timestamp text,
    numbers as text, padded / missing strings.  Every 50th timestamp and
    every 40th rate are unparsable, every 30th source is missing."""
    pid = F.col("pkt_id")
    ts_txt = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return pk.select(
        "pkt_id",
        F.when(pid % 50 == 0, F.lit("not-a-time")).otherwise(ts_txt).alias("timestamp"),
        F.when(pid % 40 == 0, F.lit("n/a")).otherwise(F.col("size").cast("string")).alias("packet_rate"),
        F.when(pid % 30 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(" "), F.col("src_ip"), F.lit(" "))).alias("src_ip"),
        F.col("protocol").alias("protocol_name"))


EVENT_TEXT_SQL = """et AS (SELECT pkt_id,
  CASE WHEN pkt_id % 50 = 0 THEN 'not-a-time' ELSE strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S.%f') END
    AS timestamp,
  CASE WHEN pkt_id % 40 = 0 THEN 'n/a' ELSE CAST(size AS VARCHAR) END AS packet_rate,
  CASE WHEN pkt_id % 30 = 0 THEN NULL ELSE ' ' || src_ip || ' ' END AS src_ip,
  protocol AS protocol_name FROM pk)"""


def observations(pk: DataFrame) -> DataFrame:
    """``PACKET_OBS``-like rows: eth_type (ARP 0x0806, every 19th frame LLDP
    0x88cc, every 23rd IPv6 0x86dd, else IPv4), ip_proto, icmp_type (every
    7th ICMP is a reply)."""
    pid, proto = F.col("pkt_id"), F.col("protocol")
    eth = (F.when(pid % 19 == 0, 0x88CC).when(proto == "ARP", 0x0806).when(pid % 23 == 0, 0x86DD)
           .otherwise(0x0800))
    ipp = F.when(proto == "ICMP", 1).when(proto == "TCP", 6).when(proto == "UDP", 17)
    return pk.select("pkt_id", "ts_us", "src_ip", "dst_ip", "size", "dpid", eth.alias("eth_type"),
                     F.when(eth == 0x0800, ipp).alias("ip_proto"),
                     F.when((eth == 0x0800) & (proto == "ICMP"),
                            F.when(pid % 7 == 0, 0).otherwise(8)).alias("icmp_type"))


OBS_SQL = """ob AS (SELECT pkt_id, ts_us, src_ip, dst_ip, size, dpid, eth_type,
  CASE WHEN eth_type = 2048 THEN (CASE protocol WHEN 'ICMP' THEN 1 WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 END) END
    AS ip_proto,
  CASE WHEN eth_type = 2048 AND protocol = 'ICMP' THEN (CASE WHEN pkt_id % 7 = 0 THEN 0 ELSE 8 END) END AS icmp_type
FROM (SELECT *, CASE WHEN pkt_id % 19 = 0 THEN 35020 WHEN protocol = 'ARP' THEN 2054 WHEN pkt_id % 23 = 0 THEN 34525
                     ELSE 2048 END AS eth_type FROM pk) t)"""


def host_mac_text(ip: str):
    """Ethernet address of a host of the view, from the last octet of its address."""
    octet = F.element_at(F.split(ip, r"\."), -1).cast("int")
    return F.concat(F.lit("00:00:00:00:00:"), F.lpad(F.lower(F.hex(octet)), 2, "0"))


HOST_MAC_SQL = "'00:00:00:00:00:' || lpad(lower(hex(CAST(string_split({ip}, '.')[-1] AS INTEGER))), 2, '0')"


def whole_observations(pk: DataFrame) -> DataFrame:
    """``PACKET_OBS`` rows: ``observations`` with addresses and ports.  A switch
    meets a source at the port of its number; TCP goes to port 80 and UDP to
    53 from one of seven source ports, and every 11th packet shows no ports."""
    pid, ported = F.col("pkt_id"), F.col("ip_proto").isin(6, 17) & (F.col("pkt_id") % 11 != 0)
    return observations(pk).withColumns({
        "src_mac": host_mac_text("src_ip"), "dst_mac": host_mac_text("dst_ip"),
        "in_port": F.element_at(F.split("src_ip", r"\."), -1).cast("int") % 5 + 1,
        "src_port": F.when(ported, (1024 + pid % 7).cast("int")),
        "dst_port": F.when(ported, F.when(F.col("ip_proto") == 6, 80).otherwise(53))})


WHOLE_OBS_SQL = f"""wo AS (SELECT *, {HOST_MAC_SQL.format(ip='src_ip')} AS src_mac, {HOST_MAC_SQL.format(ip='dst_ip')} AS dst_mac,
  CAST(string_split(src_ip, '.')[-1] AS INTEGER) % 5 + 1 AS in_port,
  CASE WHEN ip_proto IN (6, 17) AND pkt_id % 11 <> 0 THEN 1024 + pkt_id % 7 END AS src_port,
  CASE WHEN ip_proto IN (6, 17) AND pkt_id % 11 <> 0 THEN CASE ip_proto WHEN 6 THEN 80 ELSE 53 END END AS dst_port
FROM ob)"""
