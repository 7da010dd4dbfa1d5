"""Registered queries: event routing and mitigation (P16, J1-J6, J9, A6, A9,
A14, A22, A23, W15, F9)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from floodlens.operators import dims as DM
from floodlens.operators.mitigate import DROP_NOTE, exclude_post_drop, mitigation_log, pre_post_counts
from floodlens.operators.clean import pivot_slice
from floodlens.plans import eventlog
from floodlens.plans.detector import sql_prelude
from floodlens.plans.fixture import CHUNK_S, FIXTURE_TH, WATCHED
from floodlens.plans.registry import register
from floodlens.schemas import TRAFFIC_EVENT
from floodlens.session import checkpoint_dir
from floodlens.sources.adapter import packets, whole_observations
from floodlens.sources.io import append_log, read_event_log

TH, DIMS = FIXTURE_TH, WATCHED
V = DIMS.victim
WL = ", ".join(f"'{ip}'" for ip in DIMS.watch_ips)
PIVOT_HALF_S = 5.0  # the driver's 30 days are compressed to 60 s; +-5 s is the zoom around the first drop
EV = "WITH RECURSIVE " + eventlog.sql_ctes(TH, DIMS) + "\n"


def _build(spark, sf):
    return eventlog.build(packets(spark, sf), TH, DIMS, CHUNK_S)


EV_COLS = ["pkt_id", "ts_us", "severity", "event_type", "detection_status", "mitigation_status", "phase",
           "session_id", "protocol_name", "src_ip", "dst_ip", "dpid", "dpid_name", "packet_rate",
           "threat_score", "attack_type", "final_prediction", "attacker_segment", "event_note"]


@register("p16_event_routing", EV + f"SELECT {', '.join(EV_COLS)} FROM ev")
def p16(spark, sf):
    return _build(spark, sf)[0].select(*EV_COLS)


@register("p16_event_rows", "WITH RECURSIVE " + eventlog.sql_ctes(TH, DIMS, eventlog.sql_whole_flows()) + """,
pc AS (SELECT pkt_id, src_port, dst_port, src_mac, dst_mac, in_port,
              count(*) OVER (PARTITION BY session_id ORDER BY ts_us, pkt_id ROWS UNBOUNDED PRECEDING) AS packet_count FROM fl)
SELECT strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S.%f') AS timestamp, severity, event_type, detection_status,
       mitigation_status, phase, session_id, protocol_name, src_ip, dst_ip, CAST(src_port AS INTEGER) AS src_port,
       CAST(dst_port AS INTEGER) AS dst_port, src_mac, dst_mac, CAST(dpid AS INTEGER) AS dpid, dpid_name,
       CAST(in_port AS INTEGER) AS in_port, out_port, packet_rate, packet_count, threat_score, attack_type,
       CAST(final_prediction AS INTEGER) AS final_prediction, attacker_segment, event_note
FROM ev JOIN pc USING (pkt_id) JOIN op USING (pkt_id)""")
def p16rows(spark, sf):
    """The whole event row (25 columns): ported sessions, admitted packets only,
    learned ports, running counts; appended to a text log (S6) and scanned (S1)."""
    ev = eventlog.build_whole(whole_observations(packets(spark, sf)), TH, DIMS, CHUNK_S)[0]
    path = f"{checkpoint_dir(spark)}/event-rows-{uuid.uuid4().hex}"
    append_log(eventlog.log_text(ev), path)
    types = {"packet_rate": "double", "packet_count": "long", "out_port": "long", "src_port": "int", "dst_port": "int",
             "dpid": "int", "in_port": "int", "threat_score": "int", "final_prediction": "int"}
    return read_event_log(spark, path).select(*[F.col(n).cast(types.get(n, "string")).alias(n) for n in TRAFFIC_EVENT.names])


@register("j06_mitigation_active", EV + f"""
SELECT protocol_name, phase, count(*) AS n FROM ev WHERE NOT (protocol_name = 'ICMP' AND dst_ip = '10.0.0.25'
  AND src_ip IN ({WL})) GROUP BY protocol_name, phase""")
def j06(spark, sf):
    ev = _build(spark, sf)[0]
    watched = (F.col("protocol_name") == "ICMP") & (F.col("dst_ip") == V) & F.col("src_ip").isin(DIMS.watch_ips)
    return ev.filter(~watched).groupBy("protocol_name", "phase").agg(F.count(F.lit(1)).alias("n"))


@register("a06_first_drop", EV + "SELECT src_ip, drop_us FROM drops")
def a06(spark, sf):
    from floodlens.operators.mitigate import first_drops
    return first_drops(mitigation_log(eventlog.activations(packets(spark, sf), TH, DIMS, CHUNK_S), TH, DIMS))


@register("a14_action_distribution", EV + """
SELECT action, count(*) AS n FROM (SELECT 'DROP_ICMP' AS action FROM acts UNION ALL
  SELECT 'RELEASE_DROP' FROM acts) t GROUP BY action""")
def a14(spark, sf):
    log = mitigation_log(eventlog.activations(packets(spark, sf), TH, DIMS, CHUNK_S), TH, DIMS)
    return log.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@register("s02_mitigation_rows", EV + f"""
SELECT d.drop_us AS ts_us, d.src_ip, coalesce(w_host, 'UNKNOWN') AS attacker_hostname, w_dpid AS dpid,
       coalesce(s_name, 'unknown') AS dpid_name, coalesce(w_segment, 'UNKNOWN_SEGMENT') AS segment_description,
       'DROP_ICMP' AS action, 'ATTACK_CONFIRMED_DELAY_PASSED' AS reason, 0 AS idle_timeout,
       {int(TH.hard_timeout_s)} AS hard_timeout, replace('{DROP_NOTE}', '%s', d.src_ip) AS note
FROM acts d LEFT JOIN wl ON d.src_ip = wl.w_ip LEFT JOIN sw ON wl.w_dpid = sw.s_dpid""")
def s02rows(spark, sf):
    acts = eventlog.activations(packets(spark, sf), TH, DIMS, CHUNK_S)
    return mitigation_log(acts, TH, DIMS, with_release=False)


@register("j04_first_drop_enrichment", EV + """
SELECT a.src_ip, a.first_seen_us, a.last_seen_us, a.rows, d.drop_us
FROM (SELECT src_ip, min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us, count(*) AS rows FROM ev
      WHERE protocol_name = 'ICMP' AND dst_ip = '10.0.0.25' GROUP BY src_ip) a
LEFT JOIN drops d ON a.src_ip = d.src_ip""")
def j04(spark, sf):
    ev, _, drops = _build(spark, sf)
    st = (ev.filter((F.col("protocol_name") == "ICMP") & (F.col("dst_ip") == V)).groupBy("src_ip")
          .agg(F.min("ts_us").alias("first_seen_us"), F.max("ts_us").alias("last_seen_us"),
               F.count(F.lit(1)).alias("rows")))
    return st.join(drops, "src_ip", "left")


CLEAN = f"""
, cl AS (SELECT * FROM pk p WHERE NOT EXISTS (SELECT 1 FROM drops d WHERE d.src_ip = p.src_ip
          AND p.ts_us >= d.drop_us AND p.protocol = 'ICMP' AND p.dst_ip = '{V}'))
"""


@register("j05_post_drop_exclusion", EV + CLEAN + """
SELECT src_ip, protocol, count(*) AS n FROM cl GROUP BY src_ip, protocol""")
def j05(spark, sf):
    pk = packets(spark, sf)
    drops = eventlog.first_drops(pk, TH, DIMS, CHUNK_S)
    return exclude_post_drop(pk, drops, V).groupBy("src_ip", "protocol").agg(F.count(F.lit(1)).alias("n"))


@register("a09_pre_post_counts", EV + f"""
SELECT p.src_ip, min(p.ts_us) AS first_us, max(p.ts_us) AS last_us,
       count_if(d.drop_us IS NULL OR p.ts_us < d.drop_us) AS pre_drop,
       count_if(d.drop_us IS NOT NULL AND p.ts_us >= d.drop_us) AS post_drop, min(d.drop_us) AS drop_us
FROM pk p LEFT JOIN drops d ON p.src_ip = d.src_ip
WHERE p.protocol = 'ICMP' AND p.dst_ip = '{V}' AND p.src_ip IN ({WL})
GROUP BY p.src_ip""")
def a09(spark, sf):
    pk = packets(spark, sf)
    drops = eventlog.first_drops(pk, TH, DIMS, CHUNK_S)
    atk = pk.filter((F.col("protocol") == "ICMP") & (F.col("dst_ip") == V) & F.col("src_ip").isin(DIMS.watch_ips))
    return pre_post_counts(atk, drops)


@register("a23_pre_post_totals", EV + f"""
SELECT p.src_ip, count_if(d.drop_us IS NULL OR p.ts_us < d.drop_us) AS pre_drop,
       count_if(d.drop_us IS NOT NULL AND p.ts_us >= d.drop_us) AS post_drop
FROM pk p LEFT JOIN drops d ON p.src_ip = d.src_ip
WHERE p.protocol = 'ICMP' AND p.dst_ip = '{V}' AND p.src_ip IN ({WL})
GROUP BY ROLLUP (p.src_ip)""")
def a23(spark, sf):
    pk = packets(spark, sf)
    drops = eventlog.first_drops(pk, TH, DIMS, CHUNK_S)
    atk = pk.filter((F.col("protocol") == "ICMP") & (F.col("dst_ip") == V) & F.col("src_ip").isin(DIMS.watch_ips))
    j = atk.join(drops, "src_ip", "left")
    return j.rollup("src_ip").agg(
        F.count_if(F.col("drop_us").isNull() | (F.col("ts_us") < F.col("drop_us"))).alias("pre_drop"),
        F.count_if(F.col("drop_us").isNotNull() & (F.col("ts_us") >= F.col("drop_us"))).alias("post_drop"))


@register("a22_excluded_packets", EV + CLEAN + """
SELECT r.n AS raw_packets, c.n AS clean_packets, r.n - c.n AS excluded,
       CASE WHEN r.n = 0 THEN 0.0 ELSE (r.n - c.n) * 100.0 / r.n END AS excluded_pct
FROM (SELECT count(*) AS n FROM pk) r, (SELECT count(*) AS n FROM cl) c""")
def a22(spark, sf):
    from floodlens.operators.report import excluded_summary
    pk = packets(spark, sf)
    drops = eventlog.first_drops(pk, TH, DIMS, CHUNK_S)
    return excluded_summary(pk, exclude_post_drop(pk, drops, V))


@register("j09_raw_clean_diff", EV + CLEAN + """
SELECT coalesce(r.protocol, c.protocol) AS protocol, coalesce(r.n, 0) AS raw_n, coalesce(c.n, 0) AS clean_n,
       coalesce(r.n, 0) - coalesce(c.n, 0) AS diff
FROM (SELECT protocol, count(*) AS n FROM pk GROUP BY protocol) r
FULL OUTER JOIN (SELECT protocol, count(*) AS n FROM cl GROUP BY protocol) c ON r.protocol = c.protocol""")
def j09(spark, sf):
    from floodlens.operators.report import raw_clean_diff
    pk = packets(spark, sf)
    drops = eventlog.first_drops(pk, TH, DIMS, CHUNK_S)
    return raw_clean_diff(pk, drops, V)


@register("w15_activity_interval", EV + f"""
SELECT p.src_ip, min(p.ts_us) AS first_us, max(p.ts_us) AS last_us, min(d.drop_us) AS drop_us
FROM pk p LEFT JOIN drops d ON p.src_ip = d.src_ip
WHERE p.protocol = 'ICMP' AND p.dst_ip = '{V}' AND p.src_ip IN ({WL})
GROUP BY p.src_ip""")
def w15(spark, sf):
    pk = packets(spark, sf)
    drops = eventlog.first_drops(pk, TH, DIMS, CHUNK_S)
    atk = pk.filter((F.col("protocol") == "ICMP") & (F.col("dst_ip") == V) & F.col("src_ip").isin(DIMS.watch_ips))
    return (atk.groupBy("src_ip").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
            .join(drops, "src_ip", "left"))


@register("f09_pivot_slice", EV + f"""
SELECT p.src_ip, count(*) AS n FROM pk p, (SELECT min(drop_us) AS pv FROM drops) x
WHERE p.ts_us BETWEEN x.pv - {int(PIVOT_HALF_S * 1e6)} AND x.pv + {int(PIVOT_HALF_S * 1e6)}
  AND p.protocol = 'ICMP' AND p.dst_ip = '{V}'
GROUP BY p.src_ip""")
def f09(spark, sf):
    pk = packets(spark, sf)
    drops = eventlog.first_drops(pk, TH, DIMS, CHUNK_S)
    pv = drops.agg(F.min("drop_us").alias("pivot_us"))
    sl = pivot_slice(pk.filter((F.col("protocol") == "ICMP") & (F.col("dst_ip") == V)), pv, PIVOT_HALF_S)
    return sl.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------- dimension lookups
@register("j01_watchlist_lookup", "WITH " + sql_prelude() + ",\n" + eventlog.watchlist_values_sql(DIMS) + """
SELECT src_ip, coalesce(w_host, 'UNKNOWN') AS attacker_host, count(*) AS n
FROM pk LEFT JOIN wl ON pk.src_ip = wl.w_ip GROUP BY src_ip, coalesce(w_host, 'UNKNOWN')""")
def j01(spark, sf):
    return (DM.with_watchlist(packets(spark, sf), "src_ip", DIMS).groupBy("src_ip", "attacker_host")
            .agg(F.count(F.lit(1)).alias("n")))


@register("j02_segment_lookup", "WITH " + sql_prelude() + ",\n" + eventlog.watchlist_values_sql(DIMS) + """
SELECT src_ip, w_dpid AS segment_dpid, coalesce(w_segment, 'NORMAL_HOST') AS attacker_segment,
       coalesce(w_segment, 'UNKNOWN_SEGMENT') AS segment_description, count(*) AS n
FROM pk LEFT JOIN wl ON pk.src_ip = wl.w_ip GROUP BY ALL""")
def j02(spark, sf):
    return (DM.with_watchlist(packets(spark, sf), "src_ip", DIMS)
            .groupBy("src_ip", "segment_dpid", "attacker_segment", "segment_description")
            .agg(F.count(F.lit(1)).alias("n")))


@register("j03_switch_lookup", "WITH " + sql_prelude() + ",\n" + eventlog.switch_values_sql(DIMS) + """
SELECT dpid, coalesce(s_name, 'unknown') AS dpid_name, count(*) AS n
FROM (SELECT CAST(size % 8 AS INTEGER) AS dpid FROM pk) p LEFT JOIN sw ON p.dpid = sw.s_dpid GROUP BY ALL""")
def j03(spark, sf):
    pk = packets(spark, sf).select((F.col("size") % 8).cast("int").alias("dpid"))
    return DM.with_switch_name(pk, "dpid", "dpid_name", DIMS).groupBy("dpid", "dpid_name") \
        .agg(F.count(F.lit(1)).alias("n"))
