"""Scalar column builders: cleaning, coercion and classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from floodlens.config import OFPP_FLOOD, SESSION_LABELS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------------ P1 / P2
TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def parse_ts_us(text, fmt: str = TS_FORMAT, tz: str | None = None) -> Column:
    """Naive local text -> epoch µs; unparsable -> null.  ``tz`` converts a
    naive local wall time to UTC first (Q1)."""
    ts = F.try_to_timestamp(F.trim(_c(text)), F.lit(fmt))
    if tz:
        ts = F.to_utc_timestamp(ts, tz)
    return F.unix_micros(ts)


def to_double(text) -> Column:
    """Numeric coercion that never raises under ANSI: bad -> null."""
    return F.trim(_c(text).cast("string")).try_cast("double")


def clean_str(text) -> Column:
    """null -> '' and trimmed."""
    return F.trim(F.coalesce(_c(text).cast("string"), F.lit("")))


def feature_value(text) -> Column:
    """Coerce a feature to double, null/bad -> 0.0."""
    return F.coalesce(to_double(text), F.lit(0.0))


def label_value(text) -> Column:
    """Label -> int, null/bad -> 0."""
    return F.coalesce(to_double(text).cast("int"), F.lit(0))


# ------------------------------------------------------------------ P3 / P4
def protocol_from_fields(arp_opcode, ip_proto) -> Column:
    """ARP if the ARP opcode is non-empty, else ip.proto 1/6/17, else OTHER."""
    p = F.trim(F.coalesce(_c(ip_proto), F.lit("")))
    return (F.when(F.trim(F.coalesce(_c(arp_opcode), F.lit(""))) != "", "ARP")
            .when(p == "1", "ICMP").when(p == "6", "TCP").when(p == "17", "UDP").otherwise("OTHER"))


def protocol_from_eth(eth_type, ip_proto) -> Column:
    """0x0806 ARP; 0x0800 with 1/6/17; else OTHER."""
    e, p = _c(eth_type), _c(ip_proto)
    return (F.when(e == 0x0806, "ARP")
            .when((e == 0x0800) & (p == 1), "ICMP").when((e == 0x0800) & (p == 6), "TCP")
            .when((e == 0x0800) & (p == 17), "UDP").otherwise("OTHER"))


# ------------------------------------------------------------------ P5-P7
def endpoint(ip, arp_ip) -> Column:
    """P5: ip address, else ARP protocol address, else '' (empty counts as missing)."""
    return F.coalesce(F.nullif(_c(ip), F.lit("")), F.nullif(_c(arp_ip), F.lit("")), F.lit(""))


def epoch_text_to_us(text) -> Column:
    """Epoch-seconds text -> µs exactly (decimal, not a double product); bad -> 0."""
    d = _c(text).try_cast("decimal(20,6)")
    return F.coalesce((d * F.lit(1_000_000)).try_cast("bigint"), F.lit(0).cast("bigint"))


def int_or_zero(text) -> Column:
    """Int, bad -> 0."""
    return F.coalesce(_c(text).try_cast("int"), F.lit(0))


def ip_to_host(ip) -> Column:
    """No dot -> 'unknown'; integer last octet -> 'hN'; otherwise the ip itself."""
    ip = _c(ip)
    last = F.element_at(F.split(ip, r"\."), -1)
    n = last.try_cast("int")
    return (F.when(~ip.contains("."), "unknown")
            .when(n.isNotNull(), F.concat(F.lit("h"), n.cast("string"))).otherwise(ip))


# ------------------------------------------------------------------ P9-P11
def l4_port(tcp_port, udp_port) -> Column:
    """TCP port first, else UDP port, else ''."""
    return F.coalesce(F.nullif(_c(tcp_port).cast("string"), F.lit("")),
                      F.nullif(_c(udp_port).cast("string"), F.lit("")), F.lit(""))


def is_to_victim(dst, victim: str) -> Column:
    """P10."""
    return (_c(dst) == F.lit(victim)).cast("int")


def host_mac(ip, watch_ips: list[str]) -> Column:
    """``00:00:00:00:00:XX`` from the last octet, only for watchlisted ips."""
    o = F.element_at(F.split(_c(ip), r"\."), -1).try_cast("int")
    mac = F.concat(F.lit("00:00:00:00:00:"), F.lpad(F.lower(F.hex(o)), 2, "0"))
    return F.when(_c(ip).isin(watch_ips) & o.isNotNull(), mac)


def out_port_or_flood(port) -> Column:
    return F.coalesce(_c(port).cast("long"), F.lit(OFPP_FLOOD).cast("long"))


# ------------------------------------------------------------------ P19-P23
def feature_rounding(df_cols: dict) -> dict:
    """Rate 4 dp, size mean 2, size std 4, gap std 6 (``F.round``, half up)."""
    digits = {"packet_rate_ewma": 4, "packet_rate": 4, "avg_pkt_size": 2, "pkt_size_std": 4,
              "inter_arrival_std": 6}
    return {k: F.round(v, digits[k]) if k in digits else v for k, v in df_cols.items()}


def hms(ts_us) -> Column:
    """P20: ``HH:mm:ss`` of an epoch-µs value, null -> 'N/A'."""
    return F.coalesce(F.date_format(F.timestamp_micros(_c(ts_us)), "HH:mm:ss"), F.lit("N/A"))


def truncate_ms(ts_us) -> Column:
    """P20: millisecond truncation of an epoch-µs value."""
    return F.unix_micros(F.date_trunc("MILLISECOND", F.timestamp_micros(_c(ts_us))))


def session_label(label: str | None) -> Column:
    """Validated on the driver; unknown -> 'unlabeled'."""
    return F.lit(label if label in SESSION_LABELS else "unlabeled")
