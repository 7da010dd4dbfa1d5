"""Registered queries: the options of the semantics ledger (Q5 ``ddof``, Q6
``dedupe_hops``, Q8 ``drop_empties``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.functions.numeric import q, q_sql
from floodlens.operators.clean import prep
from floodlens.operators.hops import dedupe_hops, dedupe_hops_stream
from floodlens.operators.rates import trailing_features, tumbling_flow_features
from floodlens.operators.report import top_n
from floodlens.plans.detector import flows, sql_flows, sql_prelude, sql_rates
from floodlens.plans.fixture import CHUNK_S, FIXTURE_TH as TH
from floodlens.plans.q_stream import _flows_stream
from floodlens.plans.q_timeline import W9_SQL
from floodlens.plans.registry import register
from floodlens.sources.adapter import EVENT_TEXT_SQL, event_text, packets
from floodlens.streaming.source import run_available_now

#: a packet reaches the next switch after this time; silence of an identity that parts bursts
HOP_US, TOLERANCE_S = 700, 0.005
_OCTET = "CAST(split_part(src_ip, '.', 4) AS INTEGER)"


def hops(pk: DataFrame) -> DataFrame:
    """Every packet as one to four switches on its way report it (the path is the source's)."""
    last = F.element_at(F.split("src_ip", r"\."), -1).cast("int") % 4
    x = pk.withColumn("_hop", F.explode(F.sequence(F.lit(0), last)))
    return (x.withColumn("ts_us", F.col("ts_us") + F.col("_hop") * HOP_US).withColumn("dpid", F.col("dpid") + 10 * F.col("_hop")).drop("_hop"))


HOPS_SQL = f"""ob AS (SELECT * EXCLUDE (j) REPLACE (ts_us + j * {HOP_US} AS ts_us, dpid + 10 * j AS dpid)
  FROM (SELECT *, unnest(range(0, {_OCTET} % 4 + 1)) AS j FROM fl))"""
_BURSTS = f"""
g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY src_ip, dst_ip, protocol, size ORDER BY ts_us, pkt_id, dpid) <= {int(TOLERANCE_S * 1e6)}
       THEN 0 ELSE 1 END AS fresh FROM ob),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY src_ip, dst_ip, protocol, size ORDER BY ts_us, pkt_id, dpid ROWS UNBOUNDED PRECEDING) AS burst FROM g),
c AS (SELECT *, count(*) OVER (PARTITION BY src_ip, dst_ip, protocol, size, burst, dpid ORDER BY ts_us, pkt_id ROWS UNBOUNDED PRECEDING) AS k FROM b),
m AS (SELECT *, max(k) OVER (PARTITION BY src_ip, dst_ip, protocol, size, burst ORDER BY ts_us, pkt_id, dpid
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM c)
"""
_FIRST = f"WITH {sql_prelude()}, {sql_flows()}, {HOPS_SQL}, {_BURSTS} SELECT pkt_id, ts_us, dpid FROM m WHERE k > coalesce(most, 0)"


@register("q06_dedupe_hops", _FIRST)
def q06(spark, sf):
    """Q6: one observation a packet, of all that the switches on its way report."""
    return dedupe_hops(hops(flows(packets(spark, sf))), TOLERANCE_S, chunk_s=CHUNK_S).select("pkt_id", "ts_us", "dpid")


@register("q06_per_packet_rates", f"WITH {sql_prelude()}, {sql_flows()}, {sql_rates(TH, 'fl', 'rt')}" + """
SELECT pkt_id, session_id, pkt_count_1s, byte_count_1s FROM rt""")
def q06_rates(spark, sf):
    """W6 over observations without their repeats: the rates of the packets themselves, which the twin takes from the packets."""
    first = dedupe_hops(hops(flows(packets(spark, sf))), TOLERANCE_S, chunk_s=CHUNK_S)
    return trailing_features(first, "session_id", TH, CHUNK_S).select("pkt_id", "session_id", "pkt_count_1s", "byte_count_1s")


@register("q06_dedupe_hops_stream", _FIRST)
def q06_stream(spark, sf):
    """The same from a stream of observations."""
    seen = hops(_flows_stream(spark, sf).drop("session_id"))
    return run_available_now(dedupe_hops_stream(seen, TOLERANCE_S), "q06").select("pkt_id", "ts_us", "dpid")


@register("q05_sample_std", f"WITH {sql_prelude()}, {sql_flows()}, {sql_rates(TH, 'fl', 'rt')}" + f"""
SELECT pkt_id, {q_sql('CASE WHEN pkt_count_1s > 1 THEN pkt_size_std * sqrt(pkt_count_1s / (pkt_count_1s - 1.0)) ELSE 0.0 END')} AS pkt_size_std,
       {q_sql('CASE WHEN pkt_count_1s > 2 THEN inter_arrival_std * sqrt((pkt_count_1s - 1.0) / (pkt_count_1s - 2.0)) ELSE 0.0 END')} AS inter_arrival_std
FROM rt""")
def q05(spark, sf):
    """Q5: the serving features with sample standard deviations."""
    return trailing_features(flows(packets(spark, sf)), "session_id", TH, CHUNK_S, ddof=1).select(
        "pkt_id", q("pkt_size_std").alias("pkt_size_std"), q("inter_arrival_std").alias("inter_arrival_std"))


@register("q05_population_std", W9_SQL + f"""
SELECT src_ip, dst_ip, window_end_us, {q_sql('CASE WHEN packet_count_1s > 1 THEN pkt_size_std * sqrt((packet_count_1s - 1.0) / packet_count_1s) ELSE 0.0 END')} AS pkt_size_std
FROM w9""")
def q05_population(spark, sf):
    """Q5: the training features with population standard deviations."""
    icmp = packets(spark, sf).filter(F.col("protocol") == "ICMP")
    return tumbling_flow_features(icmp, TH, chunk_s=CHUNK_S, ddof=0).select("src_ip", "dst_ip", "window_end_us", q("pkt_size_std").alias("pkt_size_std"))


@register("q08_named_sources", f"WITH {sql_prelude()}, {EVENT_TEXT_SQL}" + f""",
n AS (SELECT trim(coalesce(src_ip, '')) AS src_ip FROM et),
k AS (SELECT src_ip, count(*) AS count FROM n WHERE src_ip <> '' GROUP BY src_ip)
SELECT src_ip, count, {q_sql('count * 100.0 / (SELECT sum(count) FROM k)')} AS pct FROM k ORDER BY count DESC, src_ip LIMIT 5""")
def q08(spark, sf):
    """Q8: top talkers of the text log without the rows whose source is missing."""
    return top_n(prep(event_text(packets(spark, sf))), "src_ip", 5, drop_empties=True)
