"""Packet-capture field text (S4, S8) and its typed packet table.

A capture is read as exported field text: 13 ``|``-separated fields per
packet, no header.  Blank and ragged lines are skipped.  The text reader
is used rather than the CSV reader because column pruning changes the CSV
reader's handling of ragged rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.functions import columns as C
from floodlens.schemas import PCAP_FIELD_NAMES

N_FIELDS = len(PCAP_FIELD_NAMES)
FIELD_COLS = [n.replace(".", "_") for n in PCAP_FIELD_NAMES]


def split_fields(lines: DataFrame, col: str = "value") -> DataFrame:
    """Text lines -> the 13 string fields (``PCAP_FIELDS``); keeps other columns."""
    parts = F.split(F.col(col), r"\|", -1)
    keep = [c for c in lines.columns if c != col]
    return (lines.withColumn("_p", parts)
            .filter(F.size("_p") == N_FIELDS)
            .select(*keep, *[F.col("_p")[i].alias(n) for i, n in enumerate(FIELD_COLS)]))


def first_value(c: str):
    """Repeated fields are exported comma-joined: keep the first occurrence."""
    return F.split(F.col(c), ",", 2)[0]


def typed_packets(fields: DataFrame) -> DataFrame:
    """``PCAP_PACKET``: epoch -> ts_us (bad -> 0), len -> size (bad -> 0),
    endpoints (P5), protocol (P3), host names (P7)."""
    f = {c: first_value(c) for c in FIELD_COLS}
    keep = [c for c in fields.columns if c not in FIELD_COLS]
    out = fields.select(
        *keep,
        C.epoch_text_to_us(f["frame_time_epoch"]).alias("ts_us"),
        C.int_or_zero(f["frame_len"]).alias("size"),
        C.endpoint(f["ip_src"], f["arp_src_proto_ipv4"]).alias("src"),
        C.endpoint(f["ip_dst"], f["arp_dst_proto_ipv4"]).alias("dst"),
        C.protocol_from_fields(f["arp_opcode"], f["ip_proto"]).alias("protocol"),
        C.l4_port(f["tcp_srcport"], f["udp_srcport"]).alias("sport"),
        C.l4_port(f["tcp_dstport"], f["udp_dstport"]).alias("dport"),
        f["icmp_type"].alias("icmp_type"),
    )
    return out.withColumn("src_host", C.ip_to_host("src")).withColumn("dst_host", C.ip_to_host("dst"))


def read_capture_text(spark: SparkSession, path: str) -> DataFrame:
    """Field text file(s) -> typed packets."""
    return typed_packets(split_fields(spark.read.text(path)))


def read_captures(spark: SparkSession, directory: str, pattern: str | None = None) -> DataFrame:
    """All per-host captures of a directory in one read.  The host is the
    ``capture_host=<host>`` folder when the captures are laid out that way,
    else the file name without its extension."""
    lines = spark.read.text(f"{directory}/{pattern}" if pattern else directory)
    if "capture_host" not in lines.columns:
        lines = lines.withColumn("capture_host",
                                 F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1))
    return typed_packets(split_fields(lines))


# ------------------------------------------------------------------------
# Field text derived from the packet view (the driver ships no captures).
# ------------------------------------------------------------------------
def _sport(pkt_id):
    return (F.lit(40000) + pkt_id % 20000).cast("string")


def capture_lines(pk: DataFrame, keep: tuple = ()) -> DataFrame:
    """One exported line per packet of the packet view (``value`` + ``pkt_id`` + ``dpid``).

    ICMP -> proto 1 with echo request (every 7th is a reply), TCP -> 6 to port
    5001/8080, UDP -> 17 to port 6001, ARP -> opcode 1 with empty ip fields.
    Every 97th ARP line is ragged (12 fields) and must be skipped by the scan."""
    pid = F.col("pkt_id")
    proto = F.col("protocol")
    epoch = F.concat(F.expr("CAST(ts_us DIV 1000000 AS STRING)"), F.lit("."),
                     F.lpad(F.expr("CAST(ts_us % 1000000 AS STRING)"), 6, "0"))
    e = F.lit("")
    is_ip = proto != "ARP"
    ipp = F.when(proto == "ICMP", "1").when(proto == "TCP", "6").when(proto == "UDP", "17").otherwise("")
    fields = [
        epoch, F.col("size").cast("string"),
        F.when(is_ip, F.col("src_ip")).otherwise(e), F.when(is_ip, F.col("dst_ip")).otherwise(e),
        ipp, F.when(~is_ip, "1").otherwise(e),
        F.when(~is_ip, F.col("src_ip")).otherwise(e), F.when(~is_ip, F.col("dst_ip")).otherwise(e),
        F.when(proto == "TCP", _sport(pid)).otherwise(e),
        F.when(proto == "TCP", F.when(pid % 2 == 0, "5001").otherwise("8080")).otherwise(e),
        F.when(proto == "UDP", _sport(pid)).otherwise(e),
        F.when(proto == "UDP", "6001").otherwise(e),
        F.when(proto == "ICMP", F.when(pid % 7 == 0, "0").otherwise("8")).otherwise(e),
    ]
    line = F.concat_ws("|", *fields)
    ragged = (proto == "ARP") & (pid % 97 == 0)
    line = F.when(ragged, F.concat_ws("|", *fields[:-1])).otherwise(line)
    return pk.select("pkt_id", "dpid", *keep, line.alias("value"))


CAPTURE_LINES_SQL = """
SELECT pkt_id, dpid, CASE WHEN protocol = 'ARP' AND pkt_id % 97 = 0 THEN {ragged} ELSE {full} END AS value
FROM pk"""


def capture_lines_sql() -> str:
    e = "''"
    sport = "CAST(40000 + pkt_id % 20000 AS VARCHAR)"
    f = [
        "CAST(ts_us // 1000000 AS VARCHAR) || '.' || lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0')",
        "CAST(size AS VARCHAR)",
        f"CASE WHEN protocol <> 'ARP' THEN src_ip ELSE {e} END",
        f"CASE WHEN protocol <> 'ARP' THEN dst_ip ELSE {e} END",
        "CASE protocol WHEN 'ICMP' THEN '1' WHEN 'TCP' THEN '6' WHEN 'UDP' THEN '17' ELSE '' END",
        f"CASE WHEN protocol = 'ARP' THEN '1' ELSE {e} END",
        f"CASE WHEN protocol = 'ARP' THEN src_ip ELSE {e} END",
        f"CASE WHEN protocol = 'ARP' THEN dst_ip ELSE {e} END",
        f"CASE WHEN protocol = 'TCP' THEN {sport} ELSE {e} END",
        f"CASE WHEN protocol = 'TCP' THEN (CASE WHEN pkt_id % 2 = 0 THEN '5001' ELSE '8080' END) ELSE {e} END",
        f"CASE WHEN protocol = 'UDP' THEN {sport} ELSE {e} END",
        f"CASE WHEN protocol = 'UDP' THEN '6001' ELSE {e} END",
        f"CASE WHEN protocol = 'ICMP' THEN (CASE WHEN pkt_id % 7 = 0 THEN '0' ELSE '8' END) ELSE {e} END",
    ]
    return CAPTURE_LINES_SQL.format(full=" || '|' || ".join(f), ragged=" || '|' || ".join(f[:-1]))


def host_captures(pk: DataFrame) -> DataFrame:
    """Per-host capture lines: every IP packet is seen by its source host's
    capture and, 1-5 µs later, by its destination host's capture, so the
    merged capture holds near-duplicates (``capture_host``, ``value``)."""
    src = F.struct(F.col("ts_us").alias("t"), C.ip_to_host("src_ip").alias("h"))
    dst = F.struct((F.col("ts_us") + 1 + F.col("pkt_id") % 5).alias("t"), C.ip_to_host("dst_ip").alias("h"))
    seen = pk.withColumn("_seen", F.explode(F.when(F.col("protocol") == "ARP", F.array(src)).otherwise(F.array(src, dst))))
    shifted = seen.withColumns({"ts_us": F.col("_seen.t"), "capture_host": F.col("_seen.h")}).drop("_seen")
    return capture_lines(shifted, keep=("capture_host",))


HOST_CAPTURES_SQL = """hc AS (
  SELECT p.pkt_id, s.ts_us, p.src_ip, p.dst_ip, p.protocol, p.size, p.dpid, s.capture_host
  FROM pk p JOIN (
    SELECT pkt_id, ts_us, {src_host} AS capture_host FROM pk
    UNION ALL
    SELECT pkt_id, ts_us + 1 + pkt_id % 5, {dst_host} FROM pk WHERE protocol <> 'ARP') s ON p.pkt_id = s.pkt_id)"""
