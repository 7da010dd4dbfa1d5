"""Registered queries: scenario reports, distributions, top-k, set operations
(A1-A4, A10, A15-A21, A24, F10, T1-T3, U2, J8, J10)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from floodlens.functions.numeric import q, q_sql
from floodlens.operators import dims as DM
from floodlens.operators import report as R
from floodlens.plans import eventlog
from floodlens.plans.fixture import CHUNK_S, FIXTURE_TH, WATCHED
from floodlens.plans.q_clean import CAP, FIELDS, PK, _cap
from floodlens.plans.registry import register
from floodlens.sources.adapter import packets

TH, DIMS = FIXTURE_TH, WATCHED
V = DIMS.victim
WL = ", ".join(f"'{ip}'" for ip in DIMS.watch_ips)
EVS = ("WITH RECURSIVE " + eventlog.sql_ctes(TH, DIMS) + """,
evs AS (SELECT *, CASE WHEN ts_us < (SELECT (min(ts_us) + max(ts_us)) // 2 FROM ev) THEN 'baseline' ELSE 'attack' END
          AS scenario FROM ev)
""")
PKS = f"""WITH {PK},
pks AS (SELECT *, CASE WHEN ts_us < (SELECT (min(ts_us) + max(ts_us)) // 2 FROM pk) THEN 'baseline' ELSE 'attack' END
          AS scenario FROM pk)
"""


def _evs(spark, sf):
    ev = eventlog.build(packets(spark, sf), TH, DIMS, CHUNK_S)[0]
    return R.scenario_split(ev)


def _pks(spark, sf):
    return R.scenario_split(packets(spark, sf))


@register("a01_scenario_summary", EVS + f"""
SELECT scenario, count(*) AS rows, {q_sql('(max(ts_us) - min(ts_us)) / 1000000.0')} AS duration_s,
       count(DISTINCT src_ip) AS unique_src, count(DISTINCT dst_ip) AS unique_dst,
       {q_sql('avg(packet_rate)')} AS mean_rate, {q_sql('max(packet_rate)')} AS max_rate
FROM evs GROUP BY scenario""")
def a01(spark, sf):
    return R.scenario_summary(_evs(spark, sf))


@register("a02_protocol_share", PKS + f"""
SELECT scenario, protocol, count(*) AS count,
       {q_sql('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY scenario)')} AS pct
FROM pks GROUP BY scenario, protocol""")
def a02(spark, sf):
    return R.share(_pks(spark, sf), "protocol", ["scenario"])


_STATES = "(VALUES ('NORMAL', 0), ('WARNING', 1), ('ATTACK_CONFIRMED', 2), ('DROP_ACTIVE', 3)) e(state, ord)"


@register("a03_state_distribution", EVS + f"""
SELECT e.state, e.ord, coalesce(c.n, 0) AS count,
       CASE WHEN t.n = 0 THEN 0.0 ELSE {q_sql('coalesce(c.n, 0) * 100.0 / t.n')} END AS pct
FROM {_STATES} LEFT JOIN (SELECT detection_status AS state, count(*) AS n FROM ev GROUP BY 1) c ON e.state = c.state,
     (SELECT count(*) AS n FROM ev) t""")
def a03(spark, sf):
    return R.state_distribution(eventlog.build(packets(spark, sf), TH, DIMS, CHUNK_S)[0])


@register("a04_state_distribution_present", EVS + f"""
SELECT e.state, e.ord, c.n AS count, {q_sql('c.n * 100.0 / sum(c.n) OVER ()')} AS pct
FROM {_STATES} JOIN (SELECT detection_status AS state, count(*) AS n FROM ev GROUP BY 1) c ON e.state = c.state""")
def a04(spark, sf):
    return R.state_distribution(eventlog.build(packets(spark, sf), TH, DIMS, CHUNK_S)[0], present_only=True)


_BASE = f"protocol_name = 'ICMP' AND dst_ip = '{V}' AND src_ip NOT IN ({WL})"


@register("a15_selectivity", EVS + f"""
SELECT count(*) AS baseline_rows, count_if(phase IN ('ATTACK', 'MITIGATED')) AS delivered_during_attack,
       count_if(phase = 'MITIGATED') AS delivered_during_mitigation
FROM ev WHERE {_BASE}""")
def a15(spark, sf):
    ev = eventlog.build(packets(spark, sf), TH, DIMS, CHUNK_S)[0]
    b = ev.filter((F.col("protocol_name") == "ICMP") & (F.col("dst_ip") == V) & ~F.col("src_ip").isin(DIMS.watch_ips))
    return b.agg(F.count(F.lit(1)).alias("baseline_rows"),
                 F.count_if(F.col("phase").isin("ATTACK", "MITIGATED")).alias("delivered_during_attack"),
                 F.count_if(F.col("phase") == "MITIGATED").alias("delivered_during_mitigation"))


@register("f10_baseline_attack_phase", EVS + f"""
SELECT src_ip, phase, count(*) AS n FROM ev WHERE {_BASE} AND phase IN ('ATTACK', 'MITIGATED') GROUP BY ALL""")
def f10(spark, sf):
    ev = eventlog.build(packets(spark, sf), TH, DIMS, CHUNK_S)[0]
    b = ev.filter((F.col("protocol_name") == "ICMP") & (F.col("dst_ip") == V) & ~F.col("src_ip").isin(DIMS.watch_ips))
    return (b.filter(F.col("phase").isin("ATTACK", "MITIGATED")).groupBy("src_ip", "phase")
            .agg(F.count(F.lit(1)).alias("n")))


@register("a18_scenario_deltas", EVS + f""",
s AS (SELECT scenario, count(*) AS rows, avg(packet_rate) AS mean_rate, max(packet_rate) AS max_rate
      FROM evs GROUP BY scenario)
SELECT CASE WHEN b.rows = 0 THEN 0.0 ELSE {q_sql('(a.rows - b.rows) * 100.0 / b.rows')} END AS rows_pct_change,
       CASE WHEN b.mean_rate = 0 THEN 0.0 ELSE {q_sql('a.mean_rate / b.mean_rate')} END AS mean_rate_x,
       CASE WHEN b.max_rate = 0 THEN 0.0 ELSE {q_sql('a.max_rate / b.max_rate')} END AS max_rate_x
FROM s a, s b WHERE a.scenario = 'attack' AND b.scenario = 'baseline'""")
def a18(spark, sf):
    s = (_evs(spark, sf).groupBy("scenario")
         .agg(F.count(F.lit(1)).alias("rows"), F.avg("packet_rate").alias("mean_rate"),
              F.max("packet_rate").alias("max_rate")))
    a = s.filter(F.col("scenario") == "attack").select([F.col(c).alias("a_" + c) for c in s.columns])
    b = s.filter(F.col("scenario") == "baseline").select([F.col(c).alias("b_" + c) for c in s.columns])
    return a.crossJoin(b).select(  # two one-row tables
        R.pct_change(F.col("a_rows"), F.col("b_rows")).alias("rows_pct_change"),
        R.ratio(F.col("a_mean_rate"), F.col("b_mean_rate")).alias("mean_rate_x"),
        R.ratio(F.col("a_max_rate"), F.col("b_max_rate")).alias("max_rate_x"))


@register("a19_protocols_string", PKS + """
SELECT scenario, string_agg(protocol, ', ' ORDER BY n DESC, protocol) AS protocols
FROM (SELECT scenario, protocol, count(*) AS n FROM pks GROUP BY ALL) t GROUP BY scenario""")
def a19(spark, sf):
    return R.protocols_string(_pks(spark, sf), "protocol", ["scenario"])


@register("a20_clean_verdict", EVS + """
SELECT scenario, count_if(detection_status IN ('WARNING', 'ATTACK_CONFIRMED', 'DROP_ACTIVE')) AS flagged_rows,
       count_if(detection_status IN ('WARNING', 'ATTACK_CONFIRMED', 'DROP_ACTIVE')) = 0 AS is_clean
FROM evs GROUP BY scenario""")
def a20(spark, sf):
    flagged = F.col("detection_status").isin("WARNING", "ATTACK_CONFIRMED", "DROP_ACTIVE")
    return (_evs(spark, sf).groupBy("scenario").agg(F.count_if(flagged).alias("flagged_rows"))
            .withColumn("is_clean", F.col("flagged_rows") == 0))


@register("a21_claim_checks", EVS + f""",
cl AS (SELECT * FROM pk p WHERE NOT EXISTS (SELECT 1 FROM drops d WHERE d.src_ip = p.src_ip
        AND p.ts_us >= d.drop_us AND p.protocol = 'ICMP' AND p.dst_ip = '{V}')),
m AS (SELECT
  (SELECT count(*) FROM ev WHERE src_ip NOT IN ({WL}) AND detection_status <> 'NORMAL') AS false_alarms,
  (SELECT count(*) FROM ev WHERE detection_status = 'ATTACK_CONFIRMED') AS confirmed_rows,
  (SELECT count(*) FROM drops) AS drops,
  (SELECT count(*) FROM cl p JOIN drops d ON p.src_ip = d.src_ip WHERE p.protocol = 'ICMP' AND p.dst_ip = '{V}'
     AND p.ts_us >= d.drop_us) AS attacker_rows_after_drop,
  (SELECT count(*) FROM ev WHERE {_BASE} AND phase = 'MITIGATED') AS baseline_during_mitigation,
  (SELECT count(*) FROM (SELECT src_ip, min(CASE WHEN detection_status = 'ATTACK_CONFIRMED' THEN ts_us END) AS fc
                          FROM ev GROUP BY src_ip) f JOIN drops d ON f.src_ip = d.src_ip
     WHERE f.fc IS NULL OR d.drop_us < f.fc) AS inconsistent_timings)
SELECT claim, evidence, pass FROM m, LATERAL (VALUES
  ('no_false_positive', false_alarms, false_alarms = 0),
  ('detected', confirmed_rows, confirmed_rows > 0),
  ('mitigated', drops, drops > 0),
  ('effective', attacker_rows_after_drop, attacker_rows_after_drop = 0),
  ('selective', baseline_during_mitigation, baseline_during_mitigation > 0),
  ('timing_consistent', inconsistent_timings, inconsistent_timings = 0)) v(claim, evidence, pass)""")
def a21(spark, sf):
    from floodlens.operators.mitigate import exclude_post_drop
    pk = packets(spark, sf)
    ev, _, drops = eventlog.build(pk, TH, DIMS, CHUNK_S)
    return R.claim_checks(ev, drops, exclude_post_drop(pk, drops, V), DIMS)


@register("j08_scenario_alignment", PKS + """
SELECT coalesce(a.protocol, b.protocol) AS protocol, coalesce(b.n, 0) AS baseline, coalesce(a.n, 0) AS attack
FROM (SELECT protocol, count(*) AS n FROM pks WHERE scenario = 'attack' GROUP BY 1) a
FULL OUTER JOIN (SELECT protocol, count(*) AS n FROM pks WHERE scenario = 'baseline' GROUP BY 1) b
  ON a.protocol = b.protocol""")
def j08(spark, sf):
    s = _pks(spark, sf)
    return R.align_counts(s.filter(F.col("scenario") == "baseline"), s.filter(F.col("scenario") == "attack"),
                          "protocol", "baseline", "attack")


@register("a24_protocol_note", PKS + """
SELECT protocol, CASE WHEN protocol = 'ICMP' AND attack > 2 * baseline THEN 'spike'
                      WHEN baseline > 0 AND attack > 0 THEN 'normal mix' ELSE 'one-sided' END AS note
FROM (SELECT coalesce(a.protocol, b.protocol) AS protocol, coalesce(b.n, 0) AS baseline, coalesce(a.n, 0) AS attack
      FROM (SELECT protocol, count(*) AS n FROM pks WHERE scenario = 'attack' GROUP BY 1) a
      FULL OUTER JOIN (SELECT protocol, count(*) AS n FROM pks WHERE scenario = 'baseline' GROUP BY 1) b
      ON a.protocol = b.protocol) t""")
def a24(spark, sf):
    s = _pks(spark, sf)
    j = R.align_counts(s.filter(F.col("scenario") == "baseline"), s.filter(F.col("scenario") == "attack"),
                       "protocol", "baseline", "attack")
    return j.select("protocol", R.protocol_note(F.col("protocol"), F.col("baseline"), F.col("attack")).alias("note"))


@register("u02_protocol_union", PKS + """
SELECT DISTINCT protocol FROM (SELECT protocol FROM pks WHERE scenario = 'baseline'
  UNION ALL SELECT protocol FROM pks WHERE scenario = 'attack') t""")
def u02(spark, sf):
    s = _pks(spark, sf)
    return (s.filter(F.col("scenario") == "baseline").select("protocol")
            .union(s.filter(F.col("scenario") == "attack").select("protocol")).distinct())


# ------------------------------------------------------------------ top-k / sorts
@register("t01_top_sources", f"""WITH {PK}
SELECT src_ip, count, {q_sql('count * 100.0 / t')} AS pct,
       CASE WHEN src_ip IN ({WL}) THEN 'attacker' ELSE 'normal' END AS role
FROM (SELECT src_ip, count(*) AS count, sum(count(*)) OVER () AS t FROM pk GROUP BY src_ip) x
ORDER BY count DESC, src_ip LIMIT 5""")
def t01(spark, sf):
    top = R.top_n(packets(spark, sf), "src_ip", 5)
    return DM.with_role(top, "src_ip", dims=DIMS)


@register("t02_sorted_counts", f"""WITH {PK}
SELECT dst_ip, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, dst_ip) AS rank
FROM pk GROUP BY dst_ip""")
def t02(spark, sf):
    from floodlens.operators.sequence import global_rank
    c = packets(spark, sf).groupBy("dst_ip").agg(F.count(F.lit(1)).alias("count"))
    return global_rank(c, [F.desc("count"), F.asc("dst_ip")])


@register("t03_attacker_order", f"""WITH {PK}
SELECT src_ip, row_number() OVER (ORDER BY src_ip) AS rank
FROM (SELECT DISTINCT src_ip FROM pk WHERE src_ip IN ({WL})) t""")
def t03(spark, sf):
    s = packets(spark, sf).filter(F.col("src_ip").isin(DIMS.watch_ips)).select("src_ip").distinct()
    # at most one row per watchlisted host: one window is bounded by the watchlist
    return s.withColumn("rank", F.row_number().over(Window.orderBy("src_ip")))


# ---------------------------------------------------------------- capture reports
@register("a10_packet_summary", f"WITH {PK}, {CAP}, {FIELDS}" + f"""
SELECT count(*) AS packets, sum(CAST(size AS BIGINT)) AS bytes,
       {q_sql('(max(ts_us) - min(ts_us)) / 1000000.0')} AS duration_s,
       CASE WHEN max(ts_us) > min(ts_us) THEN {q_sql('count(*) / ((max(ts_us) - min(ts_us)) / 1000000.0)')}
            ELSE 0.0 END AS pps,
       {q_sql('avg(size)')} AS mean_size, {q_sql('median(CAST(size AS DOUBLE))')} AS median_size,
       count(DISTINCT src) AS unique_src, count(DISTINCT dst) AS unique_dst
FROM cp""")
def a10(spark, sf):
    return R.packet_summary(_cap(spark, sf))


@register("a16_size_histogram", f"WITH {PK}, {CAP}, {FIELDS}" + f""",
mm AS (SELECT CAST(min(size) AS DOUBLE) AS lo, CAST(max(size) AS DOUBLE) AS hi FROM cp),
b AS (SELECT CASE WHEN hi = lo THEN 1 ELSE least(CAST(floor(50 * (CAST(size AS DOUBLE) - lo) / (hi - lo)) AS BIGINT) + 1, 50)
             END AS bin, count(*) AS n FROM cp, mm GROUP BY 1)
SELECT s.bin, {q_sql('lo + (s.bin - 1) * ((hi - lo) / 50.0)')} AS lo, {q_sql('lo + s.bin * ((hi - lo) / 50.0)')} AS hi,
       coalesce(b.n, 0) AS count
FROM (SELECT unnest(range(1, 51)) AS bin) s CROSS JOIN mm LEFT JOIN b ON s.bin = b.bin""")
def a16(spark, sf):
    return R.histogram(_cap(spark, sf), "size", 50)


@register("a16_size_markers", f"WITH {PK}, {CAP}, {FIELDS}" + f"""
SELECT {q_sql('avg(size)')} AS mean, {q_sql('median(CAST(size AS DOUBLE))')} AS median FROM cp""")
def a16_markers(spark, sf):
    return R.value_markers(_cap(spark, sf), "size")


@register("a17_box_stats", f"WITH {PK}, {CAP}, {FIELDS}" + f""",
qs AS (SELECT protocol, quantile_cont(CAST(size AS DOUBLE), [0.25, 0.5, 0.75]) AS qq FROM cp GROUP BY protocol),
b AS (SELECT protocol, qq[1] AS q1, qq[2] AS med, qq[3] AS q3, qq[1] - 1.5 * (qq[3] - qq[1]) AS lo,
             qq[3] + 1.5 * (qq[3] - qq[1]) AS hi FROM qs)
SELECT cp.protocol, {q_sql('q1')} AS q1, {q_sql('med')} AS median, {q_sql('q3')} AS q3,
       {q_sql('min(CASE WHEN size BETWEEN lo AND hi THEN CAST(size AS DOUBLE) END)')} AS whisker_lo,
       {q_sql('max(CASE WHEN size BETWEEN lo AND hi THEN CAST(size AS DOUBLE) END)')} AS whisker_hi,
       count_if(NOT (size BETWEEN lo AND hi)) AS outliers
FROM cp JOIN b ON cp.protocol = b.protocol GROUP BY cp.protocol, q1, med, q3""")
def a17(spark, sf):
    return R.box_stats(_cap(spark, sf), "size", "protocol")


@register("j10_cross_plane", EVS + f""", {CAP}, {FIELDS}
SELECT coalesce(c.src_ip, d.src) AS src_ip, coalesce(c.n, 0) AS control_events, coalesce(d.n, 0) AS data_packets
FROM (SELECT src_ip, count(*) AS n FROM ev WHERE protocol_name = 'ICMP' AND dst_ip = '{V}' GROUP BY 1) c
FULL OUTER JOIN (SELECT src, count(*) AS n FROM cp WHERE protocol = 'ICMP' AND dst = '{V}' GROUP BY 1) d
  ON c.src_ip = d.src""")
def j10(spark, sf):
    pk = packets(spark, sf)
    ev = eventlog.build(pk, TH, DIMS, CHUNK_S)[0]
    c = ev.filter((F.col("protocol_name") == "ICMP") & (F.col("dst_ip") == V))
    d = _cap(spark, sf).filter((F.col("protocol") == "ICMP") & (F.col("dst") == V)).withColumnRenamed("src", "src_ip")
    return R.align_counts(c, d, "src_ip", "control_events", "data_packets")
