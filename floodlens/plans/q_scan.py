"""Registered queries: scans and sinks (S1-S9), feature row order (P18) and
time order (T4).

The driver ships no logs or captures, so each query first writes text that
Spark derives from the driver's tables (event log, mitigation log, feature
files, per-host captures) to the shared checkpoint folder through the sink
under test, then reads it back through the scan under test."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from floodlens.functions.numeric import q, q_sql
from floodlens.operators import clean as CL
from floodlens.operators.mitigate import mitigation_log
from floodlens.plans import eventlog
from floodlens.plans.fixture import CHUNK_S, FIXTURE_TH, WATCHED
from floodlens.plans.q_clean import CAP, FIELDS, PK
from floodlens.plans.q_learn import DS_SQL, dataset
from floodlens.plans.q_timeline import HC, HC_LINES, W9_SQL, _w9
from floodlens.plans.registry import register
from floodlens.schemas import FEATURE_COLUMNS
from floodlens.session import checkpoint_dir
from floodlens.sources import adapter as A
from floodlens.sources import capture as CP
from floodlens.sources import io as IO
from floodlens.streaming.source import packet_stream, run_available_now

TH, DIMS = FIXTURE_TH, WATCHED
TEXT_LOG = "pkt_id string, timestamp string, packet_rate string, src_ip string, protocol_name string"


def W(*ctes) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/floodlens-files/{name}-{uuid.uuid4().hex[:12]}"


# ---------------------------------------------------------------- S1 / S6
@register("s01_event_log_scan", W(PK, A.EVENT_TEXT_SQL) + """
SELECT pkt_id, epoch_us(try_strptime(trim(timestamp), '%Y-%m-%d %H:%M:%S.%f')) AS ts_us,
       TRY_CAST(trim(packet_rate) AS DOUBLE) AS packet_rate, trim(coalesce(src_ip, '')) AS src_ip,
       trim(coalesce(protocol_name, '')) AS protocol_name
FROM et""")
def s01(spark, sf):
    """S6 appends the text event log in two parts; S1 reads it back (explicit
    schema, header per part) and P1 cleans it."""
    path = _scratch(spark, "event-log")
    et = A.event_text(A.packets(spark, sf)).select(*[F.col(c) for c in TEXT_LOG.replace(" string", "").split(", ")])
    IO.append_log(et.filter(F.col("pkt_id") % 2 == 0), path)
    IO.append_log(et.filter(F.col("pkt_id") % 2 == 1), path)
    log = IO.read_event_log(spark, path, TEXT_LOG)
    return (CL.prep(log.withColumn("pkt_id", F.col("pkt_id").cast("long")), numeric=("packet_rate",))
            .select("pkt_id", "ts_us", "packet_rate", "src_ip", "protocol_name"))


@register("s06_append_sink", W(PK, A.EVENT_TEXT_SQL) + """
SELECT trim(coalesce(protocol_name, '')) AS protocol_name, count(*) AS n FROM et GROUP BY 1""")
def s06(spark, sf):
    """A new log gets its header with the first append; three appends
    (one per third of the packets) read back as exactly the rows written."""
    path = _scratch(spark, "appended-log")
    et = A.event_text(A.packets(spark, sf)).select(*[F.col(c) for c in TEXT_LOG.replace(" string", "").split(", ")])
    for k in range(3):
        IO.append_log(et.filter(F.col("pkt_id") % 3 == k), path)
    log = IO.read_event_log(spark, path, TEXT_LOG)
    return log.groupBy(F.trim(F.coalesce("protocol_name", F.lit(""))).alias("protocol_name")) \
        .agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------- S2
@register("s02_mitigation_log_scan", "WITH RECURSIVE " + eventlog.sql_ctes(TH, DIMS) + """
SELECT src_ip, drop_us AS ts_us FROM acts""")
def s02scan(spark, sf):
    """The mitigation log (DROP and RELEASE rows) is written as CSV; the S2
    scan keeps the DROP_ICMP rows only."""
    acts = eventlog.activations(A.packets(spark, sf), TH, DIMS, CHUNK_S)
    log = mitigation_log(acts, TH, DIMS, with_release=True)
    path = _scratch(spark, "mitigation-log")
    IO.append_log(log.select("ts_us", "src_ip", "action"), path)
    got = IO.read_mitigation_log(spark, path, "ts_us string, src_ip string, action string")
    return got.select("src_ip", F.col("ts_us").cast("long").alias("ts_us"))


# ---------------------------------------------------------------- S3 / S7
@register("s03_feature_scan", DS_SQL + """
SELECT label, count(*) AS n, CAST(sum(packet_count_1s) AS DOUBLE) AS packets FROM ds GROUP BY label""")
def s03(spark, sf):
    """S7 overwrites the labeled dataset as two session files (written twice:
    the second write replaces the first); S3 reads both (required) with the
    text schema and P2 coerces them."""
    from floodlens.functions.columns import feature_value, label_value
    ds = dataset(spark, sf)
    d = _scratch(spark, "features")
    cols = ["packet_count_1s", "label"]
    for _ in range(2):
        for lab in (0, 1):
            IO.write_dataset(ds.filter(F.col("label") == lab).select(*[F.col(c).cast("string") for c in cols]),
                             f"{d}/session-{lab}")
    normal, attack = IO.read_feature_sessions(spark, f"{d}/session-0", f"{d}/session-1",
                                              "packet_count_1s string, label string")
    both = normal.unionByName(attack)
    return (both.select(feature_value("packet_count_1s").alias("c"), label_value("label").alias("label"))
            .groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("packets")))


# ---------------------------------------------------------------- S4 / S8
@register("s04_capture_text_scan", W(PK, CAP, FIELDS) + """
SELECT protocol, count(*) AS n, sum(size) AS bytes, min(ts_us) AS first_us, max(ts_us) AS last_us FROM cp
GROUP BY protocol""")
def s04(spark, sf):
    """Exported field text (one line per packet, some ragged) written as text
    files and read back by the S4 scan."""
    path = _scratch(spark, "capture")
    CP.capture_lines(A.packets(spark, sf)).select("value").write.mode("overwrite").text(path)
    p = CP.read_capture_text(spark, path)
    return p.groupBy("protocol").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"),
                                     F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


@register("s08_capture_merge", f"WITH {PK}, {HC}, cl AS ({HC_LINES}), "
          + FIELDS.replace("SELECT pkt_id, dpid,", "SELECT pkt_id, dpid, capture_host,") + """
SELECT capture_host, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us FROM cp GROUP BY capture_host""")
def s08(spark, sf):
    """Per-host capture files (one folder per host) merged by one S8 read."""
    d = _scratch(spark, "host-captures")
    (CP.host_captures(A.packets(spark, sf)).select("capture_host", "value")
     .write.mode("overwrite").partitionBy("capture_host").text(d))
    m = CP.read_captures(spark, d)
    return m.groupBy("capture_host").agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first_us"),
                                         F.max("ts_us").alias("last_us"))


# --------------------------------------------------------------------- S5
@register("s05_packet_stream", W(PK) + """
SELECT protocol, count(*) AS n, sum(size) AS bytes, min(ts_us) AS first_us, max(ts_us) AS last_us FROM pk
GROUP BY protocol""")
def s05(spark, sf):
    """The live packet source: the packet view over a stream of event files."""
    pk = packet_stream(spark, sf, "events.parquet").drop("event_time")
    t = run_available_now(pk, "s05")
    return t.groupBy("protocol").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"),
                                     F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


# --------------------------------------------------------------------- S9
@register("s09_report_tables", W(PK) + f"""
SELECT protocol, count(*) AS count, {q_sql('count(*) * 100.0 / sum(count(*)) OVER ()')} AS pct FROM pk
GROUP BY protocol""")
def s09(spark, sf):
    """Report tables written as result sets and read back (the protocol share)."""
    from floodlens.operators.report import share
    pk = A.packets(spark, sf)
    paths = IO.write_report_tables({"protocol_share": share(pk, "protocol"), "destination_share": share(pk, "dst_ip")},
                                   _scratch(spark, "report"))
    return spark.read.parquet(paths["protocol_share"])


# -------------------------------------------------------------------- P18
@register("p18_feature_row", W9_SQL + f"""
SELECT src_ip, dst_ip, window_end_us, is_to_victim, {q_sql('packet_rate_ewma')} AS packet_rate_ewma,
       packet_count_1s, byte_count_1s, {q_sql('avg_pkt_size')} AS avg_pkt_size, CAST(0.0 AS DOUBLE) AS pkt_size_std,
       {q_sql('inter_arrival_std', 9)} AS inter_arrival_std FROM w9""")
def p18(spark, sf):
    """Features in the trained column order; a name the frame lacks is 0.0."""
    f = _w9(spark, sf).drop("pkt_size_std")
    cols = [F.col(c) if c in f.columns else F.lit(0.0).alias(c) for c in FEATURE_COLUMNS]
    r = f.select("src_ip", "dst_ip", "window_end_us", *cols)
    return r.select("src_ip", "dst_ip", "window_end_us", "is_to_victim",
                    q("packet_rate_ewma").alias("packet_rate_ewma"), "packet_count_1s", "byte_count_1s",
                    q("avg_pkt_size").alias("avg_pkt_size"), "pkt_size_std",
                    q("inter_arrival_std", 9).alias("inter_arrival_std"))


# --------------------------------------------------------------------- T4
@register("t04_time_order", W(PK) + """
SELECT pkt_id, ts_us, row_number() OVER (ORDER BY ts_us, pkt_id) AS position FROM pk""")
def t04(spark, sf, bucket_s: float = 1.0):
    """Global time order as a position column without one task holding the
    whole table: rows are ranked inside time buckets, and a bucket's offset is
    the count of all earlier buckets (a window over the per-bucket counts,
    one row per bucket)."""
    bu = int(bucket_s * 1_000_000)
    pk = A.packets(spark, sf).withColumn("_b", F.floor(F.col("ts_us") / F.lit(bu)).cast("long"))
    cnt = pk.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    off = cnt.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    r = pk.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("ts_us", "pkt_id")))
    return (r.join(off, "_b").select("pkt_id", "ts_us", (F.col("_off") + F.col("_r")).alias("position"))
            .orderBy("position"))
