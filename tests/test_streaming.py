"""Stream = batch: the driver's events are split by time into
files written one after another and streamed one slice per micro-batch."""

import time
import uuid

import pytest
from pyspark.sql import functions as F

from floodlens.operators.mitigate import mitigation_cycle
from floodlens.operators.rates import running_session_stats, session_id, session_spans
from floodlens.plans.detector import detector
from floodlens.plans.fixture import ALL_SOURCES, CHUNK_S, FIXTURE_TH as TH
from floodlens.session import checkpoint_dir
from floodlens.sources.adapter import packets, read_events
from floodlens.streaming.detector import activations, detector_stream
from floodlens.streaming.source import CLOSING_ID, late_rows, packet_stream, replay, run_available_now
from floodlens.streaming.throttle import throttle_stream
from floodlens.operators.timeline import throttle
from tests.conftest import SF_SMALL

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sliced(spark):
    """Time-ordered event files, one slice a micro-batch, and a closing row."""
    return replay(spark, SF)


def _stream(spark, sliced):
    path, files = sliced
    return packet_stream(spark, path, watermark="2 seconds", files_per_trigger=files)


def _slice(pk):
    return (pk.filter((F.col("protocol") == "ICMP") & (F.col("dst_ip") == F.lit(ALL_SOURCES.victim)))
            .withColumn("session_id", session_id()))


def test_detector_stream_equals_batch(spark, sliced):
    pk = _stream(spark, sliced)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a session's rows in many batches
    try:
        det = run_available_now(detector_stream(_slice(pk), TH), "t-st02")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    batch = detector(packets(spark, SF), TH, ALL_SOURCES, CHUNK_S)
    cols = ["pkt_id", "detection_status", "final_prediction", "warning_since_us", "alert_first_seen_us", "trigger"]
    s = {tuple(r) for r in det.select(*cols).collect()}
    b = {tuple(r) for r in batch.select(*cols).collect()}
    assert s == b and len(s) > 1000
    rs = dict(det.select("pkt_id", "packet_rate").collect())
    rb = dict(batch.select("pkt_id", "packet_rate").collect())
    assert all(abs(rs[k] - rb[k]) < 1e-9 for k in rb)


class Rule:
    """Stands for a fitted classifier: rates and sizes decide, and one feature is unknown to the detector."""

    features = ["is_to_victim", "byte_count_1s", "packet_rate_ewma", "never_heard_of"]

    def predict(self, x):
        return ((x[:, 0] == 1) & (x[:, 1] > 300) & (x[:, 2] > 1.7) & (x[:, 3] == 0)).astype(int)

    def transform(self, df):
        hit = (F.col("is_to_victim") == 1) & (F.col("byte_count_1s") > 300) & (F.col("packet_rate_ewma") > 1.7)
        return df.withColumn("prediction", hit.cast("double"))


def test_model_in_the_stream_equals_batch(spark, sliced):
    """P17 / ST2: the guard takes the model's predictions, in the stream as in batch;
    no loadable model leaves the threshold rule."""
    from floodlens.operators.learn import load_model
    cols = ["pkt_id", "detection_status", "final_prediction", "warning_since_us", "alert_first_seen_us", "trigger"]
    rows = {}
    for name, model in (("rule", Rule()), ("none", load_model([f"{checkpoint_dir(spark)}/no-such-model"]))):
        det = run_available_now(detector_stream(_slice(_stream(spark, sliced)), TH, model=model, victim=ALL_SOURCES.victim), "t-model")
        rows[name] = {tuple(r) for r in det.select(*cols).collect()}
        assert rows[name] == {tuple(r) for r in detector(packets(spark, SF), TH, ALL_SOURCES, CHUNK_S, model=model).select(*cols).collect()}
    assert len(rows["rule"]) == len(rows["none"]) > 1000 and rows["rule"] != rows["none"]
    other = run_available_now(detector_stream(_slice(_stream(spark, sliced)), TH, model=Rule(), victim="10.9.9.9"), "t-model")
    assert other.filter("final_prediction = 1").count() == 0  # not the model's victim


def test_mitigation_cycle_stream_equals_batch(spark, sliced):
    pk = _stream(spark, sliced)
    det = run_available_now(detector_stream(_slice(pk), TH, mitigate=True), "t-st03")
    s = sorted(tuple(r) for r in activations(det, TH).collect())
    b = sorted(tuple(r) for r in mitigation_cycle(detector(packets(spark, SF), TH, ALL_SOURCES, CHUNK_S), TH, slice_s=CHUNK_S)
               .select("src_ip", "drop_us", "release_us", "activation").collect())
    assert s == b
    assert any(r[3] > 1 for r in s)  # some source is re-activated after expiry
    # while active, a source's rows are DROP_ACTIVE
    sup = det.filter("mitigated").select("detection_status").distinct().collect()
    assert [r[0] for r in sup] == ["DROP_ACTIVE"]


def test_throttle_stream_equals_batch(spark, sliced):
    pk = _stream(spark, sliced)
    fl = pk.filter(F.col("protocol").isin("ICMP", "TCP", "UDP")).withColumn("session_id", session_id())
    s = {tuple(r) for r in run_available_now(throttle_stream(fl, "session_id", 0.5), "t-st06").collect()}
    bpk = packets(spark, SF).filter(F.col("protocol").isin("ICMP", "TCP", "UDP")).withColumn("session_id", session_id())
    b = {tuple(r) for r in throttle(bpk, "session_id", 0.5, slice_s=CHUNK_S).collect()}
    assert s == b


def _events_in_parts(spark, conditions):
    """Event files in the given order, then a row that closes the stream."""
    d = f"{checkpoint_dir(spark).rstrip('/')}/parts-{uuid.uuid4().hex[:8]}"
    ev = read_events(spark, SF_SMALL)
    for c in conditions:
        ev.filter(c).coalesce(1).write.mode("append").parquet(d)
    ev.limit(1).withColumns({"event_id": F.lit(CLOSING_ID), "ts": F.col("ts") + F.expr("INTERVAL 100 YEARS")}).write.mode("append").parquet(d)
    return d


def test_rows_out_of_order_within_the_delay(spark):
    """Two interleaved halves, one after the other: the stream waits, sorts and equals the batch."""
    d = _events_in_parts(spark, [F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1])
    pk = packet_stream(spark, d, watermark="90 seconds", files_per_trigger=1)
    cols = ["pkt_id", "detection_status", "packet_count", "pkt_count_1s", "trigger"]
    det = run_available_now(detector_stream(_slice(pk), TH), "t-order")
    batch = detector(packets(spark, SF_SMALL), TH, ALL_SOURCES, CHUNK_S)
    batch = running_session_stats(batch, chunk_s=CHUNK_S)
    assert {tuple(r) for r in det.select(*cols).collect()} == {tuple(r) for r in batch.select(*cols).collect()}


def test_late_rows_are_kept_apart(spark):
    """Rows that the watermark has passed aren't folded; together with the folded ones they are the input."""
    u = F.unix_micros(F.col("ts").cast("timestamp"))
    mid = read_events(spark, SF_SMALL).agg(F.percentile_approx(u, 0.5)).first()[0]
    odd = F.col("event_id") % 2 == 1
    # the earlier half arrives last; a watermark drops rows from the second batch after it on
    d = _events_in_parts(spark, [(u >= mid) & odd, (u >= mid) & ~odd, u < mid])
    pk = packet_stream(spark, d, watermark="2 seconds", files_per_trigger=1)
    det = run_available_now(detector_stream(_slice(pk), TH), "t-late")
    every = _slice(packets(spark, SF_SMALL))
    late = late_rows(every, det)
    assert det.count() + late.count() == every.count() and late.count() > 0
    assert late.agg(F.max("ts_us")).first()[0] < mid // 43200


def test_idle_session_is_evicted(spark):
    """ST4 in the stateful detector: after an idle gap longer than the max age
    the session starts over (counters from 1, window and EWMA from zero)."""
    d = f"{checkpoint_dir(spark).rstrip('/')}/idle-{uuid.uuid4().hex[:8]}"
    first = [(i, 1_000_000 + i * 100_000, "s", "10.0.0.1", 100) for i in range(1, 6)]
    later = [(10 + i, 20_000_000 + i * 100_000, "s", "10.0.0.1", 100) for i in range(1, 4)]
    close = [(99, 90_000_000, "end", "10.0.0.2", 100)]
    schema = "pkt_id long, ts_us long, session_id string, src_ip string, size int"
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(d)
    time.sleep(1.1)
    spark.createDataFrame(later, schema).coalesce(1).write.mode("append").parquet(d)
    time.sleep(1.1)
    spark.createDataFrame(close, schema).coalesce(1).write.mode("append").parquet(d)
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d)
         .withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", "0 seconds"))
    out = run_available_now(detector_stream(s, TH, max_age_s=5.0), "t-idle")
    got = {r["pkt_id"]: (r["packet_count"], r["pkt_count_1s"]) for r in out.collect()}
    assert got[5] == (5, 5)
    assert [got[k][0] for k in (11, 12, 13)] == [1, 2, 3]
    assert got[11][1] == 1


SESSION_SCHEMA = "pkt_id long, ts_us long, session_id string, src_ip string, size int"


def _batches(spark, parts):
    """A stream that gets one list of rows a micro-batch."""
    d = f"{checkpoint_dir(spark).rstrip('/')}/batches-{uuid.uuid4().hex[:8]}"
    for k, rows in enumerate(parts):
        if k:
            time.sleep(1.1)
        spark.createDataFrame(rows, SESSION_SCHEMA).coalesce(1).write.mode("append").parquet(d)
    return (spark.readStream.schema(SESSION_SCHEMA).option("maxFilesPerTrigger", 1).parquet(d)
            .withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", "0 seconds"))


def test_sweeps_take_stale_sessions_at_their_times(spark):
    """Age 5 s, sweeps every 4 s: a session last seen at 2 s is stale from 7 s on but goes at 8 s;
    one that comes back at 7.5 s goes on, one that comes back at 8 s starts anew.  Batch alike,
    for chunks shorter and longer than the age; a tie with the age (4 + 5 > 8) is no sweep's."""
    times = {"early": [2_000_000, 7_500_000], "at": [2_000_000, 8_000_000], "tie": [3_000_000, 8_000_000, 11_999_999],
             "long": [1_000_000, 6_000_000, 30_000_000]}
    rows = [(k, t, s, "10.0.0.1", 100) for k, (t, s) in enumerate(sorted((t, s) for s, ts in times.items() for t in ts))]
    ends = [(99, 90_000_000, "end", "10.0.0.2", 100)]
    stream = _batches(spark, [[r for r in rows if r[1] < 5_000_000], [r for r in rows if r[1] >= 5_000_000], ends])
    det = run_available_now(detector_stream(stream, TH, max_age_s=5.0, sweep_s=4.0), "t-sweep").where("session_id != 'end'")
    got = {tuple(r) for r in det.groupBy("session_id", "start_us").agg(F.max("ts_us"), F.max("packet_count")).collect()}
    want = {("early", 2_000_000, 7_500_000, 2), ("at", 2_000_000, 2_000_000, 1), ("at", 8_000_000, 8_000_000, 1),
            ("tie", 3_000_000, 11_999_999, 3), ("long", 1_000_000, 6_000_000, 2), ("long", 30_000_000, 30_000_000, 1)}
    assert got == want
    for chunk_s in (1.0, 60.0):
        spans = session_spans(spark.createDataFrame(rows, SESSION_SCHEMA), th=TH.with_(session_max_age_s=5.0), chunk_s=chunk_s, sweep_s=4.0)
        assert {tuple(r) for r in spans.select("session_id", "start_us", "last_us", "packets").collect()} == want


def test_sweeps_bound_the_state(spark):
    """Waves of sessions that fall idle: the state store holds the two that the watermark hasn't passed, never all."""
    wave = 2_000
    parts = [[(w * wave + k, 1_000_000 + w * 20_000_000, f"s{w}-{k}", "10.0.0.1", 100) for k in range(wave)] for w in range(6)]
    stream = detector_stream(_batches(spark, [*parts, [(-1, 200_000_000, "end", "10.0.0.2", 100)]]), TH, max_age_s=5.0, sweep_s=4.0)
    base = f"{checkpoint_dir(spark).rstrip('/')}/state-{uuid.uuid4().hex[:8]}"
    q = (stream.writeStream.option("checkpointLocation", f"{base}/c").outputMode("append")
         .format("parquet").option("path", f"{base}/t").trigger(availableNow=True).start())
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) <= 2 * wave + 1 and held[-1] <= 1
    assert spark.read.parquet(f"{base}/t").where("session_id != 'end'").count() == 6 * wave
