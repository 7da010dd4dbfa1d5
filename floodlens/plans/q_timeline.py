"""Registered queries: time series, segments, flow features, dedupe,
throttle, as-of port (W1-W5, W9-W11, W16, W18, J7, P19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodlens.functions import columns as C
from floodlens.functions.numeric import q_sql
from floodlens.operators import timeline as TL
from floodlens.operators.clean import near_duplicates, pivot_slice
from floodlens.operators.mitigate import exclude_post_drop
from floodlens.operators.rates import packet_rates, tumbling_flow_features
from floodlens.operators.report import attacker_stats
from floodlens.plans import eventlog
from floodlens.plans.detector import flows, sql_flows, sql_rates
from floodlens.plans.fixture import CHUNK_S, FIXTURE_TH, WATCHED
from floodlens.plans.q_clean import FIELDS, HOST, PK, _cap
from floodlens.plans.registry import register
from floodlens.session import materialize
from floodlens.sources import capture as CP
from floodlens.sources.adapter import HOST_MAC_SQL, host_mac_text, packets

TH, DIMS = FIXTURE_TH, WATCHED
V = DIMS.victim
WL = ", ".join(f"'{ip}'" for ip in DIMS.watch_ips)
EV = "WITH RECURSIVE " + eventlog.sql_ctes(TH, DIMS) + "\n"
RATES = f"WITH {PK}, {sql_flows()}, {sql_rates(TH, 'fl', 'rt')}\n"
PIVOT_HALF_S = 5.0


def dense_sql(src: str, keys: str, width_us: int, agg: str) -> str:
    k = keys
    return f""", b AS (SELECT {k}, ts_us // {width_us} AS bin, CAST({agg} AS DOUBLE) AS v FROM {src} GROUP BY ALL),
r AS (SELECT {k}, min(bin) AS lo, max(bin) AS hi FROM b GROUP BY ALL),
s AS (SELECT {k}, unnest(range(lo, hi + 1)) AS bin FROM r)
SELECT {', '.join('s.' + x.strip() for x in k.split(','))}, s.bin * {width_us} AS bin_start_us,
       {q_sql('coalesce(b.v, 0.0)')} AS value
FROM s LEFT JOIN b USING ({k}, bin)"""


def _rates(spark, sf):
    return materialize(packet_rates(flows(packets(spark, sf)), "session_id", TH, CHUNK_S), "rates")


# ---------------------------------------------------------------- W1-W5
@register("w01_dense_mean_rate", RATES + dense_sql("rt", "protocol", 2_000_000, "avg(packet_rate)"))
def w01(spark, sf):
    return TL.dense_bins(_rates(spark, sf), ["protocol"], 2.0, "mean", "packet_rate")


_GROUP = f"CASE WHEN src_ip IN ({WL}) THEN 'attacker' ELSE 'baseline' END"


@register("w02_dense_sum_rate", RATES + f", g AS (SELECT *, {_GROUP} AS grp FROM rt WHERE protocol = 'ICMP' "
          f"AND dst_ip = '{V}')" + dense_sql("g", "grp", 2_000_000, "sum(packet_rate)"))
def w02(spark, sf):
    r = _rates(spark, sf).filter((F.col("protocol") == "ICMP") & (F.col("dst_ip") == V))
    g = r.withColumn("grp", F.when(F.col("src_ip").isin(DIMS.watch_ips), "attacker").otherwise("baseline"))
    return TL.dense_bins(g, ["grp"], 2.0, "sum", "packet_rate")


CAPS = f"WITH {PK}, cl AS ({CP.capture_lines_sql()}), {FIELDS}\n"


@register("w03_dense_pps", CAPS + dense_sql("cp", "protocol", 2_000_000, "count(*) / 2.0"))
def w03(spark, sf):
    return TL.dense_bins(_cap(spark, sf), ["protocol"], 2.0, "pps")


_CLEAN = f""", cln AS (SELECT * FROM pk p WHERE NOT EXISTS (SELECT 1 FROM drops d WHERE d.src_ip = p.src_ip
          AND p.ts_us >= d.drop_us AND p.protocol = 'ICMP' AND p.dst_ip = '{V}')),
g AS (SELECT ts_us, {_GROUP} AS grp FROM pk WHERE protocol = 'ICMP' AND dst_ip = '{V}'
      UNION ALL SELECT ts_us, 'clean_attacker' FROM cln WHERE protocol = 'ICMP' AND dst_ip = '{V}'
        AND src_ip IN ({WL}))"""


@register("w04_dense_counts", EV + _CLEAN + dense_sql("g", "grp", 1_000_000, "count(*)"))
def w04(spark, sf):
    pk = packets(spark, sf)
    drops = eventlog.first_drops(pk, TH, DIMS, CHUNK_S)
    to_v = pk.filter((F.col("protocol") == "ICMP") & (F.col("dst_ip") == V))
    g = to_v.withColumn("grp", F.when(F.col("src_ip").isin(DIMS.watch_ips), "attacker").otherwise("baseline"))
    clean = (exclude_post_drop(pk, drops, V)
             .filter((F.col("protocol") == "ICMP") & (F.col("dst_ip") == V) & F.col("src_ip").isin(DIMS.watch_ips))
             .withColumn("grp", F.lit("clean_attacker")))
    return TL.dense_bins(g.select("ts_us", "grp").unionByName(clean.select("ts_us", "grp")), ["grp"], 1.0, "count")


@register("w05_pivot_bins", EV + f""", g AS (SELECT p.* FROM pk p, (SELECT min(drop_us) AS pv FROM drops) x
  WHERE p.ts_us BETWEEN x.pv - {int(PIVOT_HALF_S * 1e6)} AND x.pv + {int(PIVOT_HALF_S * 1e6)}
    AND p.protocol = 'ICMP' AND p.dst_ip = '{V}' AND p.src_ip IN ({WL}))""" + dense_sql("g", "src_ip", 1_000_000,
                                                                                       "count(*)"))
def w05(spark, sf):
    pk = packets(spark, sf)
    drops = eventlog.first_drops(pk, TH, DIMS, CHUNK_S)
    atk = pk.filter((F.col("protocol") == "ICMP") & (F.col("dst_ip") == V) & F.col("src_ip").isin(DIMS.watch_ips))
    sl = pivot_slice(atk, drops.agg(F.min("drop_us").alias("pivot_us")), PIVOT_HALF_S)
    return TL.dense_bins(sl, ["src_ip"], 1.0, "count")


# ------------------------------------------------------------------- W9 / P19
W9_SQL = f"""WITH {PK},
w9a AS (SELECT src_ip, dst_ip, ts_us // 1000000 AS win, size, ts_us, pkt_id,
          (ts_us - lag(ts_us) OVER (PARTITION BY src_ip, dst_ip, ts_us // 1000000 ORDER BY ts_us, pkt_id)) / 1000000.0
          AS gap FROM pk WHERE protocol = 'ICMP'),
w9b AS (SELECT src_ip, dst_ip, win, count(*) AS packet_count_1s, sum(CAST(size AS BIGINT)) AS byte_count_1s,
          avg(CAST(size AS DOUBLE)) AS avg_pkt_size, stddev_samp(CAST(size AS DOUBLE)) AS ss, stddev_samp(gap) AS gs
        FROM w9a GROUP BY ALL),
w9c AS (SELECT *, CASE WHEN packet_count_1s >= 2 THEN coalesce(ss, 0.0) ELSE 0.0 END AS pkt_size_std,
          CASE WHEN packet_count_1s >= 3 THEN coalesce(gs, 0.0) ELSE 0.0 END AS inter_arrival_std,
          (win + 1) * 1000000 AS window_end_us, CAST(packet_count_1s AS DOUBLE) / 1.0 AS raw_rate FROM w9b),
w9 AS (SELECT *, list_reduce(list(raw_rate) OVER (PARTITION BY src_ip, dst_ip ORDER BY win
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          lambda acc, x: CAST({TH.alpha!r} AS DOUBLE) * x + CAST({1 - TH.alpha!r} AS DOUBLE) * acc,
          CAST(0.0 AS DOUBLE)) AS packet_rate_ewma,
          CAST(dst_ip = '{V}' AS INTEGER) AS is_to_victim FROM w9c)
"""


def _w9(spark, sf):
    icmp = packets(spark, sf).filter(F.col("protocol") == "ICMP")
    return tumbling_flow_features(icmp, TH, 1.0, chunk_s=CHUNK_S, victim=V)


@register("w09_flow_features", W9_SQL + f"""
SELECT src_ip, dst_ip, window_end_us, is_to_victim, packet_count_1s, byte_count_1s,
       {q_sql('avg_pkt_size')} AS avg_pkt_size, {q_sql('pkt_size_std')} AS pkt_size_std,
       {q_sql('inter_arrival_std', 9)} AS inter_arrival_std, {q_sql('packet_rate_ewma')} AS packet_rate_ewma
FROM w9""")
def w09(spark, sf):
    from floodlens.functions.numeric import q
    f = _w9(spark, sf)
    return f.select("src_ip", "dst_ip", "window_end_us", "is_to_victim", "packet_count_1s", "byte_count_1s",
                    q("avg_pkt_size").alias("avg_pkt_size"), q("pkt_size_std").alias("pkt_size_std"),
                    q("inter_arrival_std", 9).alias("inter_arrival_std"),
                    q("packet_rate_ewma").alias("packet_rate_ewma"))


@register("p19_feature_rounding", W9_SQL + """
SELECT src_ip, dst_ip, window_end_us, round(packet_rate_ewma, 4) AS packet_rate_ewma,
       round(avg_pkt_size, 2) AS avg_pkt_size, round(pkt_size_std, 4) AS pkt_size_std,
       round(inter_arrival_std, 6) AS inter_arrival_std FROM w9""")
def p19w9(spark, sf):
    f = _w9(spark, sf)
    r = C.feature_rounding({c: F.col(c) for c in ("packet_rate_ewma", "avg_pkt_size", "pkt_size_std",
                                                   "inter_arrival_std")})
    return f.select("src_ip", "dst_ip", "window_end_us", *[v.alias(k) for k, v in r.items()])


# ------------------------------------------------------------------ W10 / W11
@register("w10_phase_segments", EV + """,
ph AS (SELECT ts_us, pkt_id, CASE WHEN upper(coalesce(phase, '')) = '' THEN 'NORMAL' ELSE upper(phase) END AS p
       FROM ev WHERE ts_us IS NOT NULL),
chg AS (SELECT *, lag(p) OVER (ORDER BY ts_us, pkt_id) AS prev FROM ph),
st AS (SELECT ts_us, pkt_id, p FROM chg WHERE prev IS NULL OR prev <> p)
SELECT p AS phase, ts_us AS start_us,
       coalesce(lead(ts_us) OVER (ORDER BY ts_us, pkt_id), (SELECT max(ts_us) FROM ev)) AS end_us FROM st""")
def w10(spark, sf):
    ev = eventlog.build(packets(spark, sf), TH, DIMS, CHUNK_S)[0]
    return TL.phase_segments(ev, "phase", bucket_s=10.0)


@register("w11_lifecycle_segments", EV + f""",
st AS (SELECT e.src_ip, min(ts_us) AS fs, max(ts_us) AS ls,
              min(CASE WHEN detection_status = 'WARNING' THEN ts_us END) AS fw,
              min(CASE WHEN detection_status = 'ATTACK_CONFIRMED' THEN ts_us END) AS fc, min(d.drop_us) AS dr
       FROM ev e LEFT JOIN drops d ON e.src_ip = d.src_ip
       WHERE protocol_name = 'ICMP' AND dst_ip = '{V}' AND e.src_ip IN ({WL}) GROUP BY e.src_ip)
SELECT src_ip, state, start_us, end_us FROM st, LATERAL (VALUES
  ('NORMAL', fs, fw), ('WARNING', fw, fc), ('ATTACK', fc, dr),
  ('MITIGATED', dr, CASE WHEN ls > dr THEN ls ELSE dr + 5000000 END)) v(state, start_us, end_us)
WHERE start_us IS NOT NULL AND end_us IS NOT NULL""")
def w11(spark, sf):
    ev, _, drops = eventlog.build(packets(spark, sf), TH, DIMS, CHUNK_S)
    atk = ev.filter((F.col("protocol_name") == "ICMP") & (F.col("dst_ip") == V) & F.col("src_ip").isin(DIMS.watch_ips))
    st = attacker_stats(atk.withColumnRenamed("packet_rate", "_r").withColumn("packet_rate", F.col("_r")))
    return TL.lifecycle_segments(st.join(drops, "src_ip", "left"))


# -------------------------------------------------------------------- W16
HC = CP.HOST_CAPTURES_SQL.format(src_host=HOST.format(x="src_ip"), dst_host=HOST.format(x="dst_ip"))
HC_LINES = CP.capture_lines_sql().replace("SELECT pkt_id, dpid,", "SELECT pkt_id, dpid, capture_host,") \
    .replace("FROM pk", "FROM hc")


@register("w16_near_duplicates", f"WITH {PK}, {HC}, cl AS ({HC_LINES}), {FIELDS}" + """,
cpd AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY src, dst, protocol, sport, dport, size
                                           ORDER BY ts_us, pkt_id) AS gap FROM cp)
SELECT protocol, count(*) AS packets, count_if(coalesce(gap <= 10, false)) AS duplicates FROM cpd GROUP BY protocol""")
def w16(spark, sf):
    merged = CP.typed_packets(CP.split_fields(CP.host_captures(packets(spark, sf))))
    d = near_duplicates(merged, 10, ["src", "dst", "protocol", "sport", "dport"])
    return d.groupBy("protocol").agg(F.count(F.lit(1)).alias("packets"), F.count_if("is_dup").alias("duplicates"))


# -------------------------------------------------------------------- W18
THROTTLE_S = 0.5
# Event-time slice of the greedy folds: a tuning parameter (about a fifth of the test span)
SLICE_S = 15.0


@register("w18_throttle", f"""WITH RECURSIVE {PK}, {sql_flows()},
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
def w18(spark, sf):
    return TL.throttle(flows(packets(spark, sf)), "session_id", THROTTLE_S, slice_s=SLICE_S)


# ---------------------------------------------------------------------- J7
def _obs_macs(pk):
    return pk.select("pkt_id", "ts_us", "dpid", host_mac_text("src_ip").alias("src_mac"), host_mac_text("dst_ip").alias("dst_mac"),
                     (F.element_at(F.split("src_ip", r"\."), -1).cast("int") % 5 + 1).alias("in_port"))


@register("j07_asof_port", f"""WITH {PK},
ob AS (SELECT pkt_id, ts_us, dpid, {HOST_MAC_SQL.format(ip='src_ip')} AS src_mac, {HOST_MAC_SQL.format(ip='dst_ip')} AS dst_mac,
              CAST(string_split(src_ip, '.')[-1] AS INTEGER) % 5 + 1 AS in_port FROM pk),
u AS (SELECT dpid, src_mac AS mac, ts_us, pkt_id, 0 AS kind, CAST(in_port AS BIGINT) AS port FROM ob
      UNION ALL SELECT dpid, dst_mac, ts_us, pkt_id, 1, CAST(NULL AS BIGINT) FROM ob),
v AS (SELECT *, last_value(port IGNORE NULLS) OVER (PARTITION BY dpid, mac ORDER BY ts_us, pkt_id, kind
                                                   ROWS UNBOUNDED PRECEDING) AS lp FROM u)
SELECT pkt_id, dpid, mac AS dst_mac, coalesce(lp, 4294967291) AS out_port FROM v WHERE kind = 1""")
def j07(spark, sf):
    return TL.last_seen_port(_obs_macs(packets(spark, sf)), chunk_s=CHUNK_S)
