"""Registered queries: the streaming operators (ST1-ST7).

Each query replays the driver's ``events`` table in time slices, streams them
through the packet view (several micro-batches, ``Trigger.AvailableNow``) into
a checkpointed parquet sink and returns the sink table.  Where the stream
equals a batch operator, the oracle is that operator's SQL, uncut: the closing
row of the replay flushes windows, sessions and waiting rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodlens.functions.numeric import q, q_sql
from floodlens.operators.mitigate import intervals, mitigation_cycle
from floodlens.operators.rates import session_id, session_spans
from floodlens.plans import eventlog
from floodlens.plans.detector import (detector, sql_attack_slice, sql_cycle, sql_detector, sql_flows,
                                      sql_prelude, sql_rates)
from floodlens.plans.fixture import ALL_SOURCES, CHUNK_S, FIXTURE_TH, WATCHED
from floodlens.plans.q_timeline import THROTTLE_S, W9_SQL
from floodlens.plans.registry import register
from floodlens.session import write_table
from floodlens.sources.adapter import packets
from floodlens.streaming.detector import activations, detector_stream
from floodlens.streaming.enrich import enrich_batch
from floodlens.streaming.features import flow_features_stream, session_windows_stream
from floodlens.streaming.source import packet_stream, replay, run_available_now
from floodlens.streaming.throttle import throttle_stream

TH = FIXTURE_TH
V = ALL_SOURCES.victim
# Idle gap that ends a session (reference: 300 s), scaled to the packet view's time
SESSION_GAP_S = 5.0
SESSION_GAP_US = int(SESSION_GAP_S * 1_000_000)
# Interval of the sweeps that take stale sessions (reference: 120 s for an age of 300 s)
SWEEP_S = 2.0
SWEEP_TH = TH.with_(session_max_age_s=SESSION_GAP_S)
# The packet view's 60 s are streamed in four slices; rows may be this much out of order
DELAY = "2 seconds"


def W(*ctes) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _packets(spark, sf):
    path, files = replay(spark, sf)
    return packet_stream(spark, path, watermark=DELAY, files_per_trigger=files)


def _flows_stream(spark, sf):
    pk = _packets(spark, sf)
    return pk.filter(F.col("protocol").isin("ICMP", "TCP", "UDP")).withColumn("session_id", session_id())


def _slice_stream(spark, sf):
    pk = _packets(spark, sf)
    return (pk.filter((F.col("protocol") == "ICMP") & (F.col("dst_ip") == F.lit(V)))
            .withColumn("session_id", session_id()))


# ------------------------------------------------------------------------ ST1
@register("st01_flow_features_stream", W9_SQL + f"""
SELECT src_ip, dst_ip, window_end_us, packet_count_1s, byte_count_1s, {q_sql('avg_pkt_size')} AS avg_pkt_size,
       {q_sql('pkt_size_std')} AS pkt_size_std, {q_sql('inter_arrival_std', 9)} AS inter_arrival_std
FROM w9c""")
def st01(spark, sf):
    icmp = _packets(spark, sf).filter(F.col("protocol") == "ICMP")
    out = run_available_now(flow_features_stream(icmp), "st01")
    return out.select("src_ip", "dst_ip", "window_end_us", "packet_count_1s", "byte_count_1s",
                      q("avg_pkt_size").alias("avg_pkt_size"), q("pkt_size_std").alias("pkt_size_std"),
                      q("inter_arrival_std", 9).alias("inter_arrival_std"))


# ------------------------------------------------------------------------ ST2
@register("st02_detector_stream", W(sql_detector(TH, ALL_SOURCES)) + f"""
SELECT pkt_id, session_id, ts_us, {q_sql('packet_rate')} AS packet_rate, final_prediction,
       detection_status, warning_since_us, alert_first_seen_us, trigger
FROM det""")
def st02(spark, sf):
    det = run_available_now(detector_stream(_slice_stream(spark, sf), TH), "st02")
    return det.select("pkt_id", "session_id", "ts_us", q("packet_rate").alias("packet_rate"), "final_prediction",
                      "detection_status", "warning_since_us", "alert_first_seen_us", "trigger")


# ------------------------------------------------------------------------ ST3
@register("st03_first_activation_stream", W(sql_detector(TH, ALL_SOURCES)) + """
SELECT src_ip, min(ts_us) AS drop_us FROM det WHERE trigger GROUP BY src_ip""")
def st03_first(spark, sf):
    det = run_available_now(detector_stream(_slice_stream(spark, sf), TH, mitigate=True), "st03")
    return activations(det, TH).filter(F.col("activation") == 1).select("src_ip", "drop_us")


_CYCLE = f"""WITH RECURSIVE {sql_prelude()},
{sql_attack_slice(ALL_SOURCES)}, {sql_rates(TH, 'sl', 'rt')}, {sql_cycle(TH, 'rt')}
SELECT src_ip, drop_us, release_us, activation FROM acts"""


@register("st03_mitigation_cycle_stream", _CYCLE)
def st03_stream(spark, sf):
    """Every activation of the full cycle (suppression, expiry, re-activation)."""
    det = run_available_now(detector_stream(_slice_stream(spark, sf), TH, mitigate=True), "st03")
    return activations(det, TH)


@register("st03_mitigation_cycle", _CYCLE)
def st03_batch(spark, sf):
    """The same cycle in batch: a fold per source over its hot detector rows."""
    return mitigation_cycle(detector(packets(spark, sf), TH, ALL_SOURCES, CHUNK_S), TH, slice_s=CHUNK_S)


# ------------------------------------------------------------------------ ST4
_ISLANDS = f""",
g AS (SELECT session_id, ts_us, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us, pkt_id)
        < {SESSION_GAP_US} THEN 0 ELSE 1 END AS new_session FROM fl),
i AS (SELECT *, sum(new_session) OVER (PARTITION BY session_id ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS k FROM g),
s AS (SELECT session_id, min(ts_us) AS start_us, max(ts_us) AS last_us, count(*) AS packets FROM i GROUP BY session_id, k)
"""


@register("st04_session_eviction",
          W(sql_prelude(), sql_flows()).rstrip("\n") + _ISLANDS + "SELECT session_id, start_us, last_us, packets FROM s")
def st04(spark, sf):
    """Sessions split where a session was idle for at least the gap (batch
    ``session_window``)."""
    fl = packets(spark, sf).filter(F.col("protocol").isin("ICMP", "TCP", "UDP")).withColumn("session_id", session_id())
    fl = fl.withColumn("event_time", F.timestamp_micros("ts_us"))
    s = (fl.groupBy(F.session_window("event_time", f"{SESSION_GAP_US} microseconds"), "session_id")
         .agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("last_us"), F.count(F.lit(1)).alias("packets")))
    return s.select("session_id", "start_us", "last_us", "packets")


@register("st04_session_eviction_stream",
          W(sql_prelude(), sql_flows()).rstrip("\n") + _ISLANDS
          + "SELECT session_id, start_us, last_us, packets FROM s")
def st04_stream(spark, sf):
    s = session_windows_stream(_flows_stream(spark, sf), f"{SESSION_GAP_US} microseconds")
    return run_available_now(s, "st04")


_SWEPT = f""",
g AS (SELECT session_id, ts_us, pkt_id, CASE WHEN ts_us - ts_us % {int(SWEEP_S * 1e6)}
        - lag(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us, pkt_id) <= {SESSION_GAP_US} THEN 0 ELSE 1 END AS new_session FROM fl),
i AS (SELECT *, sum(new_session) OVER (PARTITION BY session_id ORDER BY ts_us, pkt_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT session_id, min(ts_us) AS start_us, max(ts_us) AS last_us, count(*) AS packets FROM i GROUP BY session_id, k"""


@register("st04_swept_sessions", W(sql_prelude(), sql_flows()).rstrip("\n") + _SWEPT)
def st04_swept(spark, sf):
    """Sessions as the periodic sweep ends them: one that comes back before the
    sweep that would have taken it goes on."""
    fl = packets(spark, sf).filter(F.col("protocol").isin("ICMP", "TCP", "UDP")).withColumn("session_id", session_id())
    return session_spans(fl, th=SWEEP_TH, chunk_s=CHUNK_S, sweep_s=SWEEP_S)


@register("st04_swept_sessions_stream", W(sql_prelude(), sql_flows()).rstrip("\n") + _SWEPT)
def st04_swept_stream(spark, sf):
    """The same from the detector's session counters, whose state the sweeps empty."""
    det = run_available_now(detector_stream(_flows_stream(spark, sf), SWEEP_TH, sweep_s=SWEEP_S), "st04-swept")
    return (det.groupBy("session_id", "start_us")
            .agg(F.max("ts_us").alias("last_us"), F.max("packet_count").alias("packets")))


# ------------------------------------------------------------------------ ST5
@register("st05_mitigation_enrichment_stream", "WITH RECURSIVE " + eventlog.sql_ctes(TH, WATCHED) + """
SELECT protocol, EXISTS (SELECT 1 FROM iv WHERE pk.ts_us >= iv.start_us AND pk.ts_us < iv.end_us) AS any_mitigation,
       count(*) AS n
FROM pk GROUP BY ALL""")
def st05(spark, sf):
    acts = eventlog.activations(packets(spark, sf), TH, WATCHED, CHUNK_S)
    path = write_table(intervals(acts, TH), "mitigation-intervals")
    pk = _packets(spark, sf).drop("event_time")
    out = run_available_now(pk, "st05", foreach_batch=enrich_batch(spark, path))
    return out.groupBy("protocol", "any_mitigation").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------ ST6
@register("st06_throttle_stream", f"""WITH RECURSIVE {sql_prelude()}, {sql_flows()},
e AS (SELECT session_id AS key, ts_us, pkt_id,
             row_number() OVER (PARTITION BY session_id ORDER BY ts_us, pkt_id) AS rn FROM fl),
walk(key, rn, ts_us, pkt_id, last_kept, kept) AS (
  SELECT key, rn, ts_us, pkt_id, ts_us, true FROM e WHERE rn = 1
  UNION ALL
  SELECT e.key, e.rn, e.ts_us, e.pkt_id,
         CASE WHEN e.ts_us - w.last_kept >= {int(THROTTLE_S * 1e6)} THEN e.ts_us ELSE w.last_kept END,
         e.ts_us - w.last_kept >= {int(THROTTLE_S * 1e6)}
  FROM walk w JOIN e ON e.key = w.key AND e.rn = w.rn + 1)
SELECT key, ts_us, pkt_id FROM walk WHERE kept""")
def st06(spark, sf):
    return run_available_now(throttle_stream(_flows_stream(spark, sf), "session_id", THROTTLE_S), "st06")


# ------------------------------------------------------------------------ ST7
@register("st07_session_counters_stream", W(sql_prelude(), sql_flows()) + """
SELECT pkt_id, session_id, min(ts_us) OVER (PARTITION BY session_id) AS start_us, ts_us AS last_seen_us,
       count(*) OVER (PARTITION BY session_id ORDER BY ts_us, pkt_id ROWS UNBOUNDED PRECEDING) AS packet_count
FROM fl""")
def st07(spark, sf):
    det = run_available_now(detector_stream(_flows_stream(spark, sf), TH), "st07")
    return det.select("pkt_id", "session_id", "start_us", F.col("ts_us").alias("last_seen_us"), "packet_count")
