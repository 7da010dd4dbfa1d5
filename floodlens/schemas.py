"""Explicit schemas of every table the pipeline reads or writes (no inference)."""

from pyspark.sql import types as T

S, I, L, D, TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _schema(*cols):
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


PACKET_OBS = _schema(
    ("pkt_id", L), ("ts", TS), ("dpid", I), ("in_port", I), ("src_mac", S), ("dst_mac", S),
    ("eth_type", I), ("ip_proto", I), ("src_ip", S), ("dst_ip", S), ("src_port", I),
    ("dst_port", I), ("icmp_type", I), ("size", I),
)

# Packet view used by the operators: event time as microseconds.
PACKETS = _schema(
    ("pkt_id", L), ("ts_us", L), ("src_ip", S), ("dst_ip", S), ("protocol", S),
    ("size", I), ("dpid", I),
)

TRAFFIC_EVENT = _schema(
    ("timestamp", S), ("severity", S), ("event_type", S), ("detection_status", S),
    ("mitigation_status", S), ("phase", S), ("session_id", S), ("protocol_name", S),
    ("src_ip", S), ("dst_ip", S), ("src_port", S), ("dst_port", S), ("src_mac", S),
    ("dst_mac", S), ("dpid", S), ("dpid_name", S), ("in_port", S), ("out_port", S),
    ("packet_rate", S), ("packet_count", S), ("threat_score", S), ("attack_type", S),
    ("final_prediction", S), ("attacker_segment", S), ("event_note", S),
)

MITIGATION_EVENT = _schema(
    ("timestamp", S), ("src_ip", S), ("attacker_hostname", S), ("dpid", S), ("dpid_name", S),
    ("segment_description", S), ("action", S), ("reason", S), ("idle_timeout", S),
    ("hard_timeout", S), ("note", S),
)

FLOW_FEATURES = _schema(
    ("timestamp_window_end", S), ("src_ip", S), ("dst_ip", S), ("is_to_victim", S),
    ("packet_rate_ewma", S), ("packet_count_1s", S), ("byte_count_1s", S),
    ("avg_pkt_size", S), ("pkt_size_std", S), ("inter_arrival_std", S), ("label_hint", S),
)

FEATURE_COLUMNS = (
    "is_to_victim", "packet_rate_ewma", "packet_count_1s", "byte_count_1s",
    "avg_pkt_size", "pkt_size_std", "inter_arrival_std",
)

PCAP_FIELD_NAMES = (
    "frame.time_epoch", "frame.len", "ip.src", "ip.dst", "ip.proto", "arp.opcode",
    "arp.src.proto_ipv4", "arp.dst.proto_ipv4", "tcp.srcport", "tcp.dstport",
    "udp.srcport", "udp.dstport", "icmp.type",
)
PCAP_FIELDS = _schema(*[(n.replace(".", "_"), S) for n in PCAP_FIELD_NAMES])

PCAP_PACKET = _schema(
    ("timestamp", D), ("size", I), ("src", S), ("dst", S), ("protocol", S), ("ts_us", L),
    ("src_host", S), ("dst_host", S),
)
