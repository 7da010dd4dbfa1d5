"""Registered queries: cleaning, coercion, classification, slices
(P1-P11, P19-P23, F2, F4, F5, F11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodlens.functions import columns as C
from floodlens.functions.numeric import q, q_sql
from floodlens.operators import clean as CL
from floodlens.operators import dims as DM
from floodlens.operators.rates import session_id, tumbling_flow_features
from floodlens.plans.detector import baseline_slice, sql_prelude
from floodlens.plans.eventlog import watchlist_values_sql
from floodlens.plans.fixture import CHUNK_S, FIXTURE_TH, WATCHED
from floodlens.plans.registry import register
from floodlens.sources import adapter as A
from floodlens.sources.capture import capture_lines, capture_lines_sql, split_fields, typed_packets

DIMS = WATCHED
V = DIMS.victim
WL = ", ".join(f"'{ip}'" for ip in DIMS.watch_ips)


def W(*ctes) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


PK = sql_prelude()
CAP = f"cl AS ({capture_lines_sql()})"
# SQL twin of split_fields + typed_packets
FIELDS = """cf AS (SELECT pkt_id, dpid, string_split(value, '|') AS p FROM cl WHERE len(string_split(value, '|')) = 13),
cp AS (SELECT pkt_id, dpid,
  coalesce(TRY_CAST(TRY_CAST(string_split(p[1], ',')[1] AS DECIMAL(20,6)) * 1000000 AS BIGINT), 0) AS ts_us,
  coalesce(TRY_CAST(string_split(p[2], ',')[1] AS INTEGER), 0) AS size,
  coalesce(nullif(string_split(p[3], ',')[1], ''), nullif(string_split(p[7], ',')[1], ''), '') AS src,
  coalesce(nullif(string_split(p[4], ',')[1], ''), nullif(string_split(p[8], ',')[1], ''), '') AS dst,
  CASE WHEN trim(coalesce(string_split(p[6], ',')[1], '')) <> '' THEN 'ARP'
       WHEN trim(coalesce(string_split(p[5], ',')[1], '')) = '1' THEN 'ICMP'
       WHEN trim(coalesce(string_split(p[5], ',')[1], '')) = '6' THEN 'TCP'
       WHEN trim(coalesce(string_split(p[5], ',')[1], '')) = '17' THEN 'UDP' ELSE 'OTHER' END AS protocol,
  coalesce(nullif(string_split(p[9], ',')[1], ''), nullif(string_split(p[11], ',')[1], ''), '') AS sport,
  coalesce(nullif(string_split(p[10], ',')[1], ''), nullif(string_split(p[12], ',')[1], ''), '') AS dport,
  string_split(p[13], ',')[1] AS icmp_type
FROM cf)"""
HOST = ("CASE WHEN NOT contains({x}, '.') THEN 'unknown' "
        "WHEN TRY_CAST(string_split({x}, '.')[-1] AS INTEGER) IS NOT NULL "
        "THEN 'h' || CAST(TRY_CAST(string_split({x}, '.')[-1] AS INTEGER) AS VARCHAR) ELSE {x} END")


def _cap(spark, sf):
    return typed_packets(split_fields(capture_lines(A.packets(spark, sf))))


# -------------------------------------------------------------------- P1 / F11
@register("p01_prep", W(PK, A.EVENT_TEXT_SQL) + """
SELECT pkt_id, epoch_us(try_strptime(trim(timestamp), '%Y-%m-%d %H:%M:%S.%f')) AS ts_us,
       TRY_CAST(trim(packet_rate) AS DOUBLE) AS packet_rate, trim(coalesce(src_ip, '')) AS src_ip,
       trim(coalesce(protocol_name, '')) AS protocol_name
FROM et""")
def p01(spark, sf):
    return (CL.prep(A.event_text(A.packets(spark, sf)), numeric=("packet_rate",))
            .select("pkt_id", "ts_us", "packet_rate", "src_ip", "protocol_name"))


@register("f11_drop_incomplete", W(PK, A.EVENT_TEXT_SQL) + """
SELECT protocol_name, count(*) AS n FROM (
  SELECT epoch_us(try_strptime(trim(timestamp), '%Y-%m-%d %H:%M:%S.%f')) AS ts_us,
         TRY_CAST(trim(packet_rate) AS DOUBLE) AS packet_rate, protocol_name FROM et) t
WHERE ts_us IS NOT NULL AND packet_rate IS NOT NULL GROUP BY protocol_name""")
def f11(spark, sf):
    p = CL.prep(A.event_text(A.packets(spark, sf)), numeric=("packet_rate",))
    return CL.drop_incomplete(p).groupBy("protocol_name").agg(F.count(F.lit(1)).alias("n"))


# -------------------------------------------------------------------------- P2
@register("p02_feature_coercion", W(PK, A.EVENT_TEXT_SQL) + """
SELECT pkt_id, coalesce(TRY_CAST(trim(packet_rate) AS DOUBLE), 0.0) AS packet_rate_ewma,
       coalesce(CAST(TRY_CAST(trim(CASE WHEN pkt_id % 3 = 0 THEN 'x' ELSE '1' END) AS DOUBLE) AS INTEGER), 0)
         AS label
FROM et""")
def p02(spark, sf):
    et = A.event_text(A.packets(spark, sf))
    lab = F.when(F.col("pkt_id") % 3 == 0, F.lit("x")).otherwise(F.lit("1"))
    return et.select("pkt_id", C.feature_value("packet_rate").alias("packet_rate_ewma"),
                     C.label_value(lab).alias("label"))


# ---------------------------------------------------------------- P3-P7, S4 path
@register("p03_classify_protocol", W(PK, CAP, FIELDS) + "SELECT protocol, count(*) AS n FROM cp GROUP BY protocol")
def p03(spark, sf):
    return _cap(spark, sf).groupBy("protocol").agg(F.count(F.lit(1)).alias("n"))


@register("p04_protocol_from_eth", W(PK, A.OBS_SQL) + """
SELECT CASE WHEN eth_type = 2054 THEN 'ARP' WHEN eth_type = 2048 AND ip_proto = 1 THEN 'ICMP'
            WHEN eth_type = 2048 AND ip_proto = 6 THEN 'TCP' WHEN eth_type = 2048 AND ip_proto = 17 THEN 'UDP'
            ELSE 'OTHER' END AS protocol, count(*) AS n FROM ob GROUP BY 1""")
def p04(spark, sf):
    ob = A.observations(A.packets(spark, sf))
    return (ob.select(C.protocol_from_eth("eth_type", "ip_proto").alias("protocol"))
            .groupBy("protocol").agg(F.count(F.lit(1)).alias("n")))


@register("p05_endpoints", W(PK, CAP, FIELDS) + "SELECT pkt_id, src, dst FROM cp")
def p05(spark, sf):
    return _cap(spark, sf).select("pkt_id", "src", "dst")


@register("p06_epoch_and_length", W(PK, CAP, FIELDS) + "SELECT pkt_id, ts_us, size FROM cp")
def p06(spark, sf):
    return _cap(spark, sf).select("pkt_id", "ts_us", "size")


@register("p07_ip_to_host", W(PK) + f"""
SELECT pkt_id, {HOST.format(x='ip')} AS host FROM (
  SELECT pkt_id, CASE WHEN pkt_id % 13 = 0 THEN 'fe80::1' WHEN pkt_id % 17 = 0 THEN '10.0.0.x' ELSE src_ip END AS ip
  FROM pk) t""")
def p07(spark, sf):
    pk = A.packets(spark, sf)
    ip = (F.when(F.col("pkt_id") % 13 == 0, "fe80::1").when(F.col("pkt_id") % 17 == 0, "10.0.0.x")
          .otherwise(F.col("src_ip")))
    return pk.select("pkt_id", C.ip_to_host(ip).alias("host"))


@register("p08_session_id", W(PK, CAP, FIELDS) + """
SELECT pkt_id, CASE WHEN protocol IN ('TCP', 'UDP') AND sport <> '' AND dport <> ''
  THEN src || ':' || sport || '->' || dst || ':' || dport || ':' || protocol
  ELSE src || '->' || dst || ':' || protocol END AS session_id FROM cp""")
def p08(spark, sf):
    c = _cap(spark, sf)
    return c.select("pkt_id", session_id("src", "dst", "protocol", "sport", "dport").alias("session_id"))


@register("p09_l4_ports", W(PK, CAP, FIELDS) + "SELECT pkt_id, sport, dport FROM cp")
def p09(spark, sf):
    return _cap(spark, sf).select("pkt_id", "sport", "dport")


@register("p10_is_to_victim", W(PK) + f"""
SELECT CAST(dst_ip = '{V}' AS INTEGER) AS is_to_victim, count(*) AS n FROM pk GROUP BY 1""")
def p10(spark, sf):
    return (A.packets(spark, sf).select(C.is_to_victim("dst_ip", V).alias("is_to_victim"))
            .groupBy("is_to_victim").agg(F.count(F.lit(1)).alias("n")))


@register("p11_host_mac", W(PK) + f"""
SELECT src_ip, CASE WHEN src_ip IN ({WL}) THEN '00:00:00:00:00:' ||
  lpad(lower(hex(CAST(string_split(src_ip, '.')[-1] AS INTEGER))), 2, '0') END AS mac
FROM (SELECT DISTINCT src_ip FROM pk) t""")
def p11(spark, sf):
    return (A.packets(spark, sf).select("src_ip").distinct()
            .select("src_ip", C.host_mac("src_ip", DIMS.watch_ips).alias("mac")))


# ------------------------------------------------------------------ P19-P23
@register("p20_time_format", W(PK) + """
SELECT pkt_id, coalesce(strftime(make_timestamp(t), '%H:%M:%S'), 'N/A') AS hms,
       epoch_us(date_trunc('millisecond', make_timestamp(ts_us))) AS ts_ms_us
FROM (SELECT pkt_id, ts_us, CASE WHEN pkt_id % 10 = 0 THEN NULL ELSE ts_us END AS t FROM pk) x""")
def p20(spark, sf):
    pk = A.packets(spark, sf)
    t = F.when(F.col("pkt_id") % 10 == 0, F.lit(None).cast("long")).otherwise(F.col("ts_us"))
    return pk.select("pkt_id", C.hms(t).alias("hms"), C.truncate_ms("ts_us").alias("ts_ms_us"))


@register("p21_role_tag", W(PK) + f"""
SELECT src_ip, CASE WHEN src_ip IN ({WL}) THEN 'attacker' ELSE 'normal' END AS role, count(*) AS n
FROM pk GROUP BY ALL""")
def p21(spark, sf):
    return (DM.with_role(A.packets(spark, sf), "src_ip", dims=DIMS).groupBy("src_ip", "role")
            .agg(F.count(F.lit(1)).alias("n")))


@register("p22_display_label", W(PK, watchlist_values_sql(DIMS)) + """
SELECT src_ip, coalesce(w_host || ' (' || src_ip || ')', src_ip) AS label
FROM (SELECT DISTINCT src_ip FROM pk) p LEFT JOIN wl ON p.src_ip = wl.w_ip""")
def p22(spark, sf):
    return DM.with_display_label(A.packets(spark, sf).select("src_ip").distinct(), "src_ip", "label", DIMS)


@register("p23_session_label", W(PK) + """
SELECT CASE WHEN ts_us < (SELECT (min(ts_us) + max(ts_us)) // 2 FROM pk) THEN 'normal' ELSE 'attack' END
  AS label_hint, count(*) AS n FROM pk GROUP BY 1""")
def p23(spark, sf):
    from floodlens.operators.report import scenario_split
    pk = scenario_split(A.packets(spark, sf))
    normal = pk.filter(F.col("scenario") == "baseline").withColumn("label_hint", C.session_label("normal"))
    attack = pk.filter(F.col("scenario") == "attack").withColumn("label_hint", C.session_label("attack"))
    return normal.unionByName(attack).groupBy("label_hint").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ F2 / F4 / F5
@register("f02_baseline_slice", W(PK) + f"""
SELECT src_ip, count(*) AS n FROM pk WHERE protocol = 'ICMP' AND dst_ip = '{V}' AND src_ip NOT IN ({WL})
GROUP BY src_ip""")
def f02(spark, sf):
    return baseline_slice(A.packets(spark, sf), DIMS).groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"))


@register("f04_capture_filter", W(PK, CAP, FIELDS) + """
SELECT protocol, count(*) AS n FROM cp
WHERE protocol IN ('ICMP', 'ARP') OR (protocol = 'TCP' AND (sport IN ('5001', '8080') OR dport IN ('5001', '8080')))
   OR (protocol = 'UDP' AND (sport IN ('6001') OR dport IN ('6001')))
GROUP BY protocol""")
def f04(spark, sf):
    return CL.capture_filter(_cap(spark, sf)).groupBy("protocol").agg(F.count(F.lit(1)).alias("n"))


@register("f05_packet_admission", W(PK, A.OBS_SQL) + """
SELECT count(*) AS n, count(DISTINCT src_ip) AS sources FROM ob
WHERE eth_type <> 35020 AND eth_type = 2048 AND src_ip IS NOT NULL AND (ip_proto <> 1 OR icmp_type = 8)""")
def f05(spark, sf):
    ob = CL.admit_packets(A.observations(A.packets(spark, sf)))
    return ob.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src_ip").alias("sources"))


__all__ = ["q", "q_sql"]
