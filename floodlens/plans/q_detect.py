"""Registered queries: rates, detector, trigger, per-attacker stats
(W6-W8, W12-W14, W17, P12-P17, F1-F3, A5, A7, A8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodlens.functions.numeric import q, q_sql
from floodlens.operators import detect as D
from floodlens.operators.rates import packet_rates, running_session_stats, session_id
from floodlens.plans.detector import (attack_slice, detector, flows, sql_attack_slice, sql_detect, sql_detector,
                                      sql_flows, sql_prelude, sql_rates)
from floodlens.plans.fixture import ALL_SOURCES, CHUNK_S, FIXTURE_TH, WATCHED
from floodlens.plans.registry import register
from floodlens.session import materialize
from floodlens.sources.adapter import packets

TH, DIMS = FIXTURE_TH, ALL_SOURCES
WL = ", ".join(f"'{ip}'" for ip in WATCHED.watch_ips)
SILENT = [*WATCHED.watch_ips, "10.0.9.9"]  # a watchlist with a host that never sends


def W(*ctes) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _rates(spark, sf):
    return packet_rates(flows(packets(spark, sf)), "session_id", TH, CHUNK_S)


def _det(spark, sf):
    return detector(packets(spark, sf), TH, DIMS, CHUNK_S)


RATES_SQL = W(sql_prelude(), sql_flows(), sql_rates(TH, "fl", "rt"))
DET_SQL = W(sql_detector(TH, DIMS))


# ---------------------------------------------------------------- W6 / W7 / W8
@register("w06_trailing_window", RATES_SQL + f"""
SELECT pkt_id, session_id, ts_us, pkt_count_1s, byte_count_1s,
       {q_sql('avg_pkt_size')} AS avg_pkt_size, {q_sql('pkt_size_std')} AS pkt_size_std
FROM rt""")
def w06(spark, sf):
    return _rates(spark, sf).select("pkt_id", "session_id", "ts_us", "pkt_count_1s", "byte_count_1s",
                                    q("avg_pkt_size").alias("avg_pkt_size"),
                                    q("pkt_size_std").alias("pkt_size_std"))


@register("w07_gap_std", RATES_SQL + f"""
SELECT pkt_id, session_id, pkt_count_1s, {q_sql('inter_arrival_std', 9)} AS inter_arrival_std FROM rt""")
def w07(spark, sf):
    return _rates(spark, sf).select("pkt_id", "session_id", "pkt_count_1s",
                                    q("inter_arrival_std", 9).alias("inter_arrival_std"))


@register("w08_ewma_rate", RATES_SQL + f"""
SELECT pkt_id, session_id, ts_us, raw_rate, {q_sql('packet_rate')} AS packet_rate FROM rt""")
def w08(spark, sf):
    return _rates(spark, sf).select("pkt_id", "session_id", "ts_us", "raw_rate",
                                    q("packet_rate").alias("packet_rate"))


@register("w12_session_stats", W(sql_prelude(), sql_flows()) + """
SELECT pkt_id, session_id, min(ts_us) OVER (PARTITION BY session_id) AS start_us, ts_us AS last_seen_us,
       count(*) OVER (PARTITION BY session_id ORDER BY ts_us, pkt_id ROWS UNBOUNDED PRECEDING) AS packet_count
FROM fl""")
def w12(spark, sf):
    return (running_session_stats(flows(packets(spark, sf)), "session_id", TH, CHUNK_S)
            .select("pkt_id", "session_id", "start_us", "last_seen_us", "packet_count"))


# ------------------------------------------------------------------ detector
@register("w13_detection_state", DET_SQL + f"""
SELECT pkt_id, session_id, ts_us, {q_sql('packet_rate')} AS packet_rate, final_prediction,
       detection_status, warning_since_us, alert_first_seen_us
FROM det""")
def w13(spark, sf):
    return _det(spark, sf).select("pkt_id", "session_id", "ts_us", q("packet_rate").alias("packet_rate"),
                                  "final_prediction", "detection_status", "warning_since_us",
                                  "alert_first_seen_us")


@register("w14_mitigation_trigger", DET_SQL + """
SELECT src_ip, min(ts_us) AS drop_us, count(*) AS trigger_rows FROM det WHERE trigger GROUP BY src_ip""")
def w14(spark, sf):
    return (_det(spark, sf).filter("trigger").groupBy("src_ip")
            .agg(F.min("ts_us").alias("drop_us"), F.count(F.lit(1)).alias("trigger_rows")))


@register("w14_countdown", DET_SQL + """
SELECT pkt_id, src_ip, countdown_s, trigger FROM det WHERE detection_status = 'ATTACK_CONFIRMED'""")
def w14c(spark, sf):
    return (_det(spark, sf).filter(F.col("detection_status") == "ATTACK_CONFIRMED")
            .select("pkt_id", "src_ip", "countdown_s", "trigger"))


@register("w17_transitions", DET_SQL + f"""
SELECT pkt_id, session_id, from_status, detection_status AS to_status, {q_sql('packet_rate')} AS packet_rate
FROM (SELECT *, lag(detection_status, 1, 'NORMAL') OVER (PARTITION BY session_id ORDER BY ts_us, pkt_id)
        AS from_status FROM det) t
WHERE from_status <> detection_status""")
def w17(spark, sf):
    return (D.transitions(_det(spark, sf))
            .select("pkt_id", "session_id", "from_status", "to_status", q("packet_rate").alias("packet_rate")))


# ------------------------------------------------------- scalar ladders on rows
_RULE = "CASE WHEN packet_rate >= 2.0 AND pkt_count_1s >= 2 THEN 1 WHEN pkt_id % 7 = 0 THEN NULL ELSE 0 END"


@register("p17_model_prediction", "WITH " + ",\n".join([sql_prelude(), sql_attack_slice(DIMS), sql_rates(TH, "sl", "rt"), sql_detect(TH, "rt", _RULE)]) + """
SELECT pkt_id, final_prediction, detection_status, warning_since_us, alert_first_seen_us FROM det""")
def p17_model(spark, sf):
    """P17 with a model's predictions in the loop: null ones count as 0, rates
    below the warning are never alerts, and confirmation follows the model."""
    sl = attack_slice(packets(spark, sf), DIMS).withColumn("session_id", session_id())
    r = materialize(packet_rates(sl, "session_id", TH, CHUNK_S), "rates").withColumn("prediction", F.expr(_RULE))
    return (D.detection_state(r, TH, model_pred="prediction")
            .select("pkt_id", "final_prediction", "detection_status", "warning_since_us", "alert_first_seen_us"))


@register("p17_prediction_guard", DET_SQL + """
SELECT final_prediction, count(*) AS n FROM det GROUP BY final_prediction""")
def p17(spark, sf):
    return _det(spark, sf).groupBy("final_prediction").agg(F.count(F.lit(1)).alias("n"))


_SCORE_SQL = """CASE WHEN {p} = 0 THEN (CASE WHEN {r} >= 40 THEN 25 WHEN {r} >= 20 THEN 12 ELSE 5 END)
  ELSE (CASE WHEN {r} >= 350 THEN 95 WHEN {r} >= 250 THEN 85 WHEN {r} >= 150 THEN 70
             WHEN {r} >= 100 THEN 55 ELSE 40 END) END"""


@register("p12_threat_score", RATES_SQL + f"""
SELECT pkt_id, CAST({_SCORE_SQL.format(p='CASE WHEN raw_rate * 10 >= 50 THEN 1 ELSE 0 END', r='raw_rate * 10')}
         AS INTEGER) AS threat_score,
       CAST({_SCORE_SQL.format(p='0', r='raw_rate * 10')} AS INTEGER) AS benign_score
FROM rt""")
def p12(spark, sf):
    r = F.col("raw_rate") * 10
    return _rates(spark, sf).select(
        "pkt_id", D.threat_score(r, F.when(r >= 50, 1).otherwise(0)).alias("threat_score"),
        D.threat_score(r, F.lit(0)).alias("benign_score"))


@register("p13_risk_band", RATES_SQL + f"""
SELECT pkt_id, CAST(CASE WHEN s <= 5 THEN 1 WHEN s <= 25 THEN 2 WHEN s <= 55 THEN 3 ELSE 4 END AS INTEGER)
  AS risk_band FROM (SELECT pkt_id, {_SCORE_SQL.format(p='CASE WHEN raw_rate * 10 >= 50 THEN 1 ELSE 0 END',
                                                       r='raw_rate * 10')} AS s FROM rt) t""")
def p13(spark, sf):
    r = F.col("raw_rate") * 10
    return _rates(spark, sf).select(
        "pkt_id", D.risk_band(D.threat_score(r, F.when(r >= 50, 1).otherwise(0))).alias("risk_band"))


@register("p14_attack_type", W(sql_prelude(), sql_flows()) + """
SELECT pkt_id, CASE WHEN protocol <> 'ICMP' THEN 'BENIGN_TRAFFIC' WHEN size > 400 THEN 'ICMP_FLOOD_DROPPED'
  WHEN size > 200 THEN 'ICMP_FLOOD' ELSE 'BENIGN_ICMP' END AS attack_type FROM fl""")
def p14(spark, sf):
    fl = flows(packets(spark, sf))
    pred = F.when(F.col("size") > 200, 1).otherwise(0)
    return fl.select("pkt_id", D.attack_type(F.col("protocol"), pred, F.col("size") > 400).alias("attack_type"))


@register("p15_phase", DET_SQL + """
SELECT pkt_id, CASE WHEN trigger THEN 'MITIGATED' WHEN detection_status IN ('WARNING', 'ATTACK_CONFIRMED')
  THEN 'ATTACK' ELSE 'NORMAL' END AS phase FROM det""")
def p15(spark, sf):
    d = _det(spark, sf)
    return d.select("pkt_id", D.phase(F.col("detection_status"), F.col("trigger")).alias("phase"))


# ------------------------------------------------------------- F1 / F3 slices
@register("f01_attack_slice", W(sql_prelude()) + f"""
SELECT src_ip, count(*) AS n FROM pk
WHERE src_ip IN ({WL}) AND dst_ip = '10.0.0.25' AND protocol = 'ICMP'
GROUP BY src_ip""")
def f01(spark, sf):
    return attack_slice(packets(spark, sf), WATCHED).groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"))


@register("f03_state_subsets", DET_SQL + """
SELECT detection_status, count(*) AS n FROM det WHERE detection_status IN ('WARNING', 'ATTACK_CONFIRMED', 'DROP_ACTIVE')
GROUP BY detection_status""")
def f03(spark, sf):
    return (_det(spark, sf).filter(F.col("detection_status").isin("WARNING", "ATTACK_CONFIRMED", "DROP_ACTIVE"))
            .groupBy("detection_status").agg(F.count(F.lit(1)).alias("n")))


# ------------------------------------------------------ A5 / A7 / A8 per source
@register("a05_attacker_stats", DET_SQL + f"""
SELECT src_ip, min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us,
       min(CASE WHEN detection_status = 'WARNING' THEN ts_us END) AS first_warn_us,
       min(CASE WHEN detection_status = 'ATTACK_CONFIRMED' THEN ts_us END) AS first_conf_us,
       {q_sql('max(packet_rate)')} AS max_rate, {q_sql('avg(packet_rate)')} AS avg_rate, count(*) AS total_pkts
FROM det GROUP BY src_ip""")
def a05(spark, sf):
    from floodlens.operators.report import attacker_stats
    return attacker_stats(_det(spark, sf))


@register("a05_watchlist_stats", "WITH " + ",\n".join([sql_prelude(), sql_attack_slice(WATCHED), sql_rates(TH, "sl", "rt"), sql_detect(TH, "rt")]) + f""",
spine AS (SELECT unnest([{', '.join(repr(ip) for ip in SILENT)}]) AS src_ip)
SELECT spine.src_ip, min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us,
       min(CASE WHEN detection_status = 'WARNING' THEN ts_us END) AS first_warn_us,
       min(CASE WHEN detection_status = 'ATTACK_CONFIRMED' THEN ts_us END) AS first_conf_us,
       {q_sql('max(packet_rate)')} AS max_rate, {q_sql('avg(packet_rate)')} AS avg_rate, nullif(count(det.src_ip), 0) AS total_pkts
FROM spine LEFT JOIN det ON det.src_ip = spine.src_ip GROUP BY spine.src_ip""")
def a05_watchlist(spark, sf):
    """A5 for a watchlist, one host of which never sends."""
    from floodlens.operators.report import attacker_stats
    return attacker_stats(detector(packets(spark, sf), TH, WATCHED, CHUNK_S), watch=SILENT)


@register("a07_global_firsts", DET_SQL + """
SELECT min(CASE WHEN detection_status = 'WARNING' THEN ts_us END) AS first_warning_us,
       min(CASE WHEN detection_status = 'ATTACK_CONFIRMED' THEN ts_us END) AS first_confirmed_us,
       min(CASE WHEN trigger THEN ts_us END) AS first_drop_us
FROM det""")
def a07(spark, sf):
    d = _det(spark, sf)
    return d.agg(F.min(F.when(F.col("detection_status") == "WARNING", F.col("ts_us"))).alias("first_warning_us"),
                 F.min(F.when(F.col("detection_status") == "ATTACK_CONFIRMED", F.col("ts_us")))
                 .alias("first_confirmed_us"),
                 F.min(F.when(F.col("trigger"), F.col("ts_us"))).alias("first_drop_us"))


@register("a08_latency", DET_SQL + """
, st AS (SELECT src_ip, min(CASE WHEN detection_status = 'WARNING' THEN ts_us END) AS fw,
              min(CASE WHEN detection_status = 'ATTACK_CONFIRMED' THEN ts_us END) AS fc,
              min(CASE WHEN trigger THEN ts_us END) AS dr FROM det GROUP BY src_ip)
SELECT src_ip, fc - fw AS detect_latency_us, dr - fc AS mitigation_latency_us FROM st""")
def a08(spark, sf):
    from floodlens.operators.report import latencies
    return latencies(_det(spark, sf))
