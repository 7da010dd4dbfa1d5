"""Traffic event log (P16 routing) and mitigation log derived from packets.

Routing per packet (ARP and non-echo ICMP write no row):
TCP/UDP -> tcp_normal/udp_normal; ICMP not to the victim -> icmp_non_victim;
ICMP to the victim from an unwatched source -> icmp_to_victim; from a
watched source -> the detector row (icmp_normal / rate_warning /
flood_confirmed), suppressed while its own drop is active (Q2; with
``log_suppressed`` a LIMITED / attacker_blocked row is written instead).
Phase of unwatched rows: MITIGATED while any drop is active (J6).
The mitigation table holds the full cycle of each source (ST3): a drop lasts
the hard timeout, then the detection state starts anew and can drop again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodlens.config import OFPP_FLOOD, Dims, Thresholds
from floodlens.functions.columns import protocol_from_eth
from floodlens.functions.numeric import q
from floodlens.operators import detect as D
from floodlens.operators.clean import admit_packets
from floodlens.operators.detect import detection_state, mitigation_trigger
from floodlens.operators.dims import with_switch_name, with_watchlist
from floodlens.operators.mitigate import (intervals, merge_intervals, mitigation_cycle, mitigation_log,
                                          with_mitigation_active, with_own_mitigation)
from floodlens.operators.rates import packet_rates, running_session_stats, session_episodes, session_id
from floodlens.operators.sequence import CHUNK
from floodlens.operators.timeline import last_seen_port
from floodlens.plans.detector import detector, flows
from floodlens.schemas import TRAFFIC_EVENT
from floodlens.session import materialize
from floodlens.sources.adapter import OBS_SQL, WHOLE_OBS_SQL


def cycle(det_in: DataFrame, th: Thresholds) -> tuple[DataFrame, DataFrame]:
    """(detector rows, activations) of the full mitigation cycle over rated rows
    of one session a source.  Rows under a drop aren't judged (NORMAL); after
    the release a new detection state starts, so the rows between two drops
    are an episode with islands of its own."""
    det = materialize(mitigation_trigger(detection_state(det_in, th, key="_episode"), th), "detector")
    acts = materialize(mitigation_cycle(det, th), "activations")
    one = Window.partitionBy("src_ip").orderBy("drop_us")  # activations of a source: its span over the hard timeout
    again = acts.select(F.col("src_ip").alias("_src"), F.col("release_us").alias("_from"),
                        F.lead("drop_us", 1, 2 ** 62).over(one).alias("_to"))
    rows = with_own_mitigation(det_in, intervals(acts, th), "_dropped")
    held = rows.filter("_dropped").drop("_dropped").withColumns(
        {"detection_status": F.lit("NORMAL"), "final_prediction": F.lit(0), "trigger": F.lit(False)})
    cond = (F.col("src_ip") == F.col("_src")) & (F.col("ts_us") >= F.col("_from")) & (F.col("ts_us") <= F.col("_to"))
    judged = (rows.filter("NOT _dropped").drop("_dropped").join(again, cond, "left")  # episodes don't overlap
              .withColumn("_turn", F.concat_ws("#", "_episode", F.col("_from").cast("string"))).drop("_src", "_from", "_to"))
    judged = mitigation_trigger(detection_state(judged, th, key="_turn"), th)
    return judged.select(*held.columns).unionByName(held), acts


def build(pk: DataFrame, th: Thresholds, dims: Dims, chunk_s: float, log_suppressed: bool = False):
    """Returns (event_log, mitigation_log, first_drops)."""
    return _route(flows(pk), th, dims, chunk_s, log_suppressed)


#: what a whole event row has beyond the packet view's columns
LINK_COLUMNS = ("src_port", "dst_port", "src_mac", "dst_mac", "in_port")


def build_whole(obs: DataFrame, th: Thresholds, dims: Dims, chunk_s: float, log_suppressed: bool = False):
    """``build`` over ``PACKET_OBS`` rows: the event log has ports, Ethernet
    addresses, switch ports and the running packet count of its session too.

    Every frame but LLDP teaches its switch the port of its source (J7); only
    admitted packets (F5: IPv4, ICMP as echo request) of TCP, UDP and ICMP
    write rows.  TCP and UDP sessions with both ports are told apart by them
    (P8).  A suppressed packet counts in its session, as it is counted before
    it is judged.  Null ports are empty text in the log."""
    seen = last_seen_port(obs.filter(F.col("eth_type") != 0x88CC), chunk_s).select("pkt_id", "out_port")
    fl = admit_packets(obs).withColumn("protocol", protocol_from_eth("eth_type", "ip_proto"))
    fl = fl.filter(F.col("protocol").isin("ICMP", "TCP", "UDP"))
    fl = fl.withColumn("session_id", session_id(sport="src_port", dport="dst_port"))
    return _route(fl, th, dims, chunk_s, log_suppressed, seen)


def log_text(ev: DataFrame) -> DataFrame:
    """Whole event rows as the text columns of ``TRAFFIC_EVENT``, in its order."""
    named = ev.withColumn("timestamp", F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return named.select(*[F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in TRAFFIC_EVENT.names])


def _route(fl: DataFrame, th: Thresholds, dims: Dims, chunk_s: float, log_suppressed: bool, seen: DataFrame | None = None):
    """(event_log, mitigation_log, first_drops) of packets with their ``session_id``;
    with ``seen`` (the ``out_port`` of each packet) the rows are whole."""
    fl = with_watchlist(fl, "src_ip", dims)
    fl = session_episodes(fl, "session_id", th, chunk_s).drop(CHUNK)
    r = materialize(packet_rates(fl, "_episode", th, chunk_s), "rates")
    link: tuple[str, ...] = ()
    if seen is not None:
        counted = running_session_stats(r, "_episode", th, chunk_s).drop("start_us", "last_seen_us")
        r = materialize(counted.join(seen, "pkt_id", "left"), "whole-rates")
        link = (*LINK_COLUMNS, "out_port", "packet_count")
    to_v = (F.col("protocol") == "ICMP") & (F.col("dst_ip") == F.lit(dims.victim))
    det, acts = cycle(r.filter(to_v & F.col("is_watched")), th)
    drops = acts.groupBy("src_ip").agg(F.min("drop_us").alias("drop_us"))
    iv = intervals(acts, th)
    merged = merge_intervals(iv)
    other = r.filter(~(to_v & F.col("is_watched"))).withColumn("detection_status", F.lit("NORMAL")) \
        .withColumn("final_prediction", F.lit(0)).withColumn("trigger", F.lit(False))
    cols = [c for c in other.columns]
    det = det.select(*cols)
    rows = det.unionByName(other)
    rows = with_own_mitigation(rows, iv, "mitigated")
    rows = with_mitigation_active(rows, merged, out="any_mitigation")
    watched_row = to_v & F.col("is_watched")
    rows = rows.filter(~(watched_row & F.col("mitigated")) | F.lit(log_suppressed))
    mit = watched_row & F.col("mitigated")
    status = F.when(mit, "DROP_ACTIVE").otherwise(F.col("detection_status"))
    sev = (F.when(~watched_row, "INFO").when(mit, "INFO")
           .when(F.col("detection_status") == "ATTACK_CONFIRMED", "ALERT")
           .when(F.col("detection_status") == "WARNING", "WARNING").otherwise("INFO"))
    etype = (F.when(~watched_row, "NORMAL").when(mit, "LIMITED")
             .when(F.col("detection_status") == "ATTACK_CONFIRMED", "ATTACK")
             .when(F.col("detection_status") == "WARNING", "SUSPICIOUS").otherwise("NORMAL"))
    note = (F.when(F.col("protocol") == "TCP", "tcp_normal").when(F.col("protocol") == "UDP", "udp_normal")
            .when(F.col("dst_ip") != F.lit(dims.victim), "icmp_non_victim")
            .when(~F.col("is_watched"), "icmp_to_victim").when(mit, "attacker_blocked")
            .when(F.col("detection_status") == "ATTACK_CONFIRMED", "flood_confirmed")
            .when(F.col("detection_status") == "WARNING", "rate_warning").otherwise("icmp_normal"))
    ph = (F.when(F.col("dst_ip") != F.lit(dims.victim), F.when(F.col("protocol") == "ICMP", "NORMAL")
                 .otherwise(F.when(F.col("any_mitigation"), "MITIGATED").otherwise("NORMAL")))
          .when(~watched_row, F.when(F.col("any_mitigation"), "MITIGATED").otherwise("NORMAL"))
          .otherwise(D.phase(F.col("detection_status"), mit)))
    logged_rate = F.when(mit, F.lit(0.0)).otherwise(F.col("packet_rate"))
    pred = F.when(mit, F.lit(0)).otherwise(F.col("final_prediction"))
    ev = rows.select(
        "pkt_id", "ts_us", sev.alias("severity"), etype.alias("event_type"),
        status.alias("detection_status"),
        F.when(mit, "DROP_ACTIVE").otherwise("OFF").alias("mitigation_status"), ph.alias("phase"),
        "session_id", F.col("protocol").alias("protocol_name"), "src_ip", "dst_ip", "dpid", *link,
        q(logged_rate, 4).alias("packet_rate"),
        F.when(watched_row, D.threat_score(logged_rate, pred)).otherwise(F.lit(5)).alias("threat_score"),
        F.when(watched_row, D.attack_type(F.col("protocol"), pred, mit))
        .otherwise(F.when(F.col("protocol") == "ICMP", "BENIGN_ICMP").otherwise("BENIGN_TRAFFIC"))
        .alias("attack_type"),
        F.when(watched_row, pred).otherwise(F.lit(0)).alias("final_prediction"),
        F.when(watched_row, F.col("attacker_segment")).otherwise("NORMAL_HOST").alias("attacker_segment"),
        note.alias("event_note"))
    ev = with_switch_name(ev, "dpid", "dpid_name", dims)
    # the event log is the pipeline's written table: reports read it, never recompute it
    ev = materialize(ev, "event-log")
    return ev, mitigation_log(acts, th, dims), drops


# ------------------------------------------------------------------ SQL twin
def watchlist_values_sql(dims: Dims) -> str:
    from floodlens.config import SEGMENT_PATTERN
    vals = ", ".join(f"('{ip}', '{h}', {d}, '{SEGMENT_PATTERN.format(dpid=d, host=h)}')"
                     for ip, h, d in dims.watchlist)
    return f"wl AS (SELECT * FROM (VALUES {vals}) t(w_ip, w_host, w_dpid, w_segment))"


def switch_values_sql(dims: Dims) -> str:
    vals = ", ".join(f"({d}, '{n}')" for d, n in dims.switches)
    return f"sw AS (SELECT * FROM (VALUES {vals}) t(s_dpid, s_name))"


def sql_whole_flows() -> str:
    """``fl`` over whole observations, and ``op``, the port that each frame leaves by."""
    return f"""{OBS_SQL}, {WHOLE_OBS_SQL},
pu AS (SELECT dpid, src_mac AS mac, ts_us, pkt_id, 0 AS kind, CAST(in_port AS BIGINT) AS port FROM wo WHERE eth_type <> 35020
       UNION ALL SELECT dpid, dst_mac, ts_us, pkt_id, 1, CAST(NULL AS BIGINT) FROM wo WHERE eth_type <> 35020),
op AS (SELECT pkt_id, coalesce(lp, {OFPP_FLOOD}) AS out_port FROM (
         SELECT *, last_value(port IGNORE NULLS) OVER (PARTITION BY dpid, mac ORDER BY ts_us, pkt_id, kind
                                                       ROWS UNBOUNDED PRECEDING) AS lp FROM pu) t WHERE kind = 1),
fl AS (SELECT *, CASE WHEN protocol <> 'ICMP' AND src_port IS NOT NULL AND dst_port IS NOT NULL
                      THEN src_ip || ':' || src_port || '->' || dst_ip || ':' || dst_port || ':' || protocol
                      ELSE src_ip || '->' || dst_ip || ':' || protocol END AS session_id
       FROM (SELECT *, CASE ip_proto WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' END AS protocol FROM wo
             WHERE eth_type = 2048 AND src_ip IS NOT NULL AND (ip_proto <> 1 OR icmp_type = 8)) t
       WHERE protocol IS NOT NULL)"""


def sql_ctes(th: Thresholds, dims: Dims, flows_sql: str | None = None) -> str:
    """CTEs (of a WITH RECURSIVE) ending in ``ev`` (event log), ``acts``, ``drops`` and ``iv`` (activation intervals)."""
    from floodlens.plans.detector import sql_cycle, sql_flows, sql_prelude, sql_rates
    v = dims.victim
    H = th.hard_timeout_us
    score = ("CASE WHEN {p} = 0 THEN (CASE WHEN {r} >= 40 THEN 25 WHEN {r} >= 20 THEN 12 ELSE 5 END) "
             "ELSE (CASE WHEN {r} >= 350 THEN 95 WHEN {r} >= 250 THEN 85 WHEN {r} >= 150 THEN 70 "
             "WHEN {r} >= 100 THEN 55 ELSE 40 END) END").format(p="_pred", r="_lrate")
    parts = [
        sql_prelude(), flows_sql or sql_flows(), sql_rates(th, "fl", "rt"), watchlist_values_sql(dims), switch_values_sql(dims),
        "r2 AS (SELECT rt.*, w_ip IS NOT NULL AS is_watched, w_segment FROM rt LEFT JOIN wl ON rt.src_ip = wl.w_ip)",
        f"sl AS (SELECT * FROM r2 WHERE protocol = 'ICMP' AND dst_ip = '{v}' AND is_watched)",
        sql_cycle(th, "sl"),
        f"iv AS (SELECT src_ip, drop_us AS start_us, drop_us + {H} AS end_us FROM acts)",
        "allr AS (SELECT pkt_id, ts_us, session_id, protocol, src_ip, dst_ip, dpid, packet_rate, is_watched, "
        "w_segment, detection_status, final_prediction FROM det UNION ALL "
        "SELECT pkt_id, ts_us, session_id, protocol, src_ip, dst_ip, dpid, packet_rate, is_watched, w_segment, "
        f"'NORMAL', 0 FROM r2 WHERE NOT (protocol = 'ICMP' AND dst_ip = '{v}' AND is_watched))",
        "rm AS (SELECT a.*, "
        "EXISTS (SELECT 1 FROM iv WHERE iv.src_ip = a.src_ip AND a.ts_us >= iv.start_us AND a.ts_us < iv.end_us) "
        "AS mitigated, "
        "EXISTS (SELECT 1 FROM iv WHERE a.ts_us >= iv.start_us AND a.ts_us < iv.end_us) AS any_mitigation, "
        f"(protocol = 'ICMP' AND dst_ip = '{v}' AND is_watched) AS _wr FROM allr a)",
        "rk AS (SELECT *, _wr AND mitigated AS _mit FROM rm WHERE NOT (_wr AND mitigated))",
        "rl AS (SELECT *, CASE WHEN _mit THEN 0.0 ELSE packet_rate END AS _lrate, "
        "CASE WHEN _mit THEN 0 ELSE final_prediction END AS _pred FROM rk)",
        f"""ev AS (SELECT pkt_id, ts_us,
  CASE WHEN NOT _wr THEN 'INFO' WHEN _mit THEN 'INFO' WHEN detection_status = 'ATTACK_CONFIRMED' THEN 'ALERT'
       WHEN detection_status = 'WARNING' THEN 'WARNING' ELSE 'INFO' END AS severity,
  CASE WHEN NOT _wr THEN 'NORMAL' WHEN _mit THEN 'LIMITED' WHEN detection_status = 'ATTACK_CONFIRMED' THEN 'ATTACK'
       WHEN detection_status = 'WARNING' THEN 'SUSPICIOUS' ELSE 'NORMAL' END AS event_type,
  CASE WHEN _mit THEN 'DROP_ACTIVE' ELSE detection_status END AS detection_status,
  CASE WHEN _mit THEN 'DROP_ACTIVE' ELSE 'OFF' END AS mitigation_status,
  CASE WHEN dst_ip <> '{v}' THEN (CASE WHEN protocol = 'ICMP' THEN 'NORMAL'
                                      WHEN any_mitigation THEN 'MITIGATED' ELSE 'NORMAL' END)
       WHEN NOT _wr THEN (CASE WHEN any_mitigation THEN 'MITIGATED' ELSE 'NORMAL' END)
       WHEN _mit THEN 'MITIGATED' WHEN detection_status IN ('WARNING', 'ATTACK_CONFIRMED') THEN 'ATTACK'
       ELSE 'NORMAL' END AS phase,
  session_id, protocol AS protocol_name, src_ip, dst_ip, dpid,
  {q_sql_('_lrate', 4)} AS packet_rate,
  CAST(CASE WHEN _wr THEN {score} ELSE 5 END AS INTEGER) AS threat_score,
  CASE WHEN _wr THEN (CASE WHEN protocol <> 'ICMP' THEN 'BENIGN_TRAFFIC' WHEN _mit THEN 'ICMP_FLOOD_DROPPED'
                           WHEN _pred = 1 THEN 'ICMP_FLOOD' ELSE 'BENIGN_ICMP' END)
       WHEN protocol = 'ICMP' THEN 'BENIGN_ICMP' ELSE 'BENIGN_TRAFFIC' END AS attack_type,
  CASE WHEN _wr THEN _pred ELSE 0 END AS final_prediction,
  CASE WHEN _wr THEN coalesce(w_segment, 'NORMAL_HOST') ELSE 'NORMAL_HOST' END AS attacker_segment,
  CASE WHEN protocol = 'TCP' THEN 'tcp_normal' WHEN protocol = 'UDP' THEN 'udp_normal'
       WHEN dst_ip <> '{v}' THEN 'icmp_non_victim' WHEN NOT is_watched THEN 'icmp_to_victim'
       WHEN _mit THEN 'attacker_blocked' WHEN detection_status = 'ATTACK_CONFIRMED' THEN 'flood_confirmed'
       WHEN detection_status = 'WARNING' THEN 'rate_warning' ELSE 'icmp_normal' END AS event_note,
  coalesce(s_name, 'unknown') AS dpid_name
FROM rl LEFT JOIN sw ON rl.dpid = sw.s_dpid)""",
    ]
    return ",\n".join(parts)


def q_sql_(e, d):
    from floodlens.functions.numeric import q_sql
    return q_sql(e, d)


def activations(pk: DataFrame, th: Thresholds, dims: Dims, chunk_s: float) -> DataFrame:
    """Every activation of the watched sources, without building the whole
    event log: a session's rates depend on its own packets only, so the
    detector over the attack slice alone gives the same triggers."""
    return mitigation_cycle(detector(pk, th, dims, chunk_s), th)


def first_drops(pk: DataFrame, th: Thresholds, dims: Dims, chunk_s: float) -> DataFrame:
    """The first activation of every watched source."""
    from floodlens.operators.detect import first_activation
    return first_activation(detector(pk, th, dims, chunk_s))
