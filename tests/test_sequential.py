"""Window-function operators against small sequential reference folds
(SURVEY 5.2): W6-W8 rates, W13 state machine, W14 trigger, W18 throttle."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from floodlens.config import Thresholds
from floodlens.operators.detect import detection_state, mitigation_trigger
from floodlens.operators.rates import ewma_rate, packet_rates, session_episodes, trailing_features
from floodlens.operators.timeline import throttle

TH = Thresholds(warn=3.0, attack=6.0, confirm_s=0.5, delay_s=0.8)


def _packets(seed, sessions=4, n=120, span_us=12_000_000):
    rnd = random.Random(seed)
    rows, pid = [], 0
    for s in range(sessions):
        ts = sorted(rnd.sample(range(span_us), n))
        # bursts: squeeze a stretch of packets together to cross the thresholds
        for i in range(40, 70):
            ts[i] = ts[40] + (i - 40) * rnd.randint(50_000, 120_000)
        ts[80:84] = [ts[80]] * 4  # packets of one timestamp
        ts[55:58] = [ts[55]] * 3
        for t in sorted(ts):
            pid += 1
            rows.append((pid, t, f"s{s}", rnd.randint(60, 1500)))
    return rows


def _ref_rates(rows, th):
    out = {}
    by = {}
    for pid, t, s, size in rows:
        by.setdefault(s, []).append((t, pid, size))
    for s, seq in by.items():
        seq.sort()
        ewma = 0.0
        for i, (t, pid, size) in enumerate(seq):
            win = [x for x in seq[: i + 1] if x[0] >= t - th.window_us]
            n = len(win)
            sizes = [x[2] for x in win]
            mean = sum(sizes) / n
            sstd = math.sqrt(sum((v - mean) ** 2 for v in sizes) / n) if n > 1 else 0.0
            gaps = [(win[j][0] - win[j - 1][0]) / 1e6 for j in range(1, n)]
            if n > 2:
                gm = sum(gaps) / len(gaps)
                gstd = math.sqrt(sum((g - gm) ** 2 for g in gaps) / len(gaps))
            else:
                gstd = 0.0
            raw = n / th.window_s
            ewma = th.alpha * raw + (1 - th.alpha) * ewma
            out[pid] = (n, sum(sizes), sstd, gstd, ewma)
    return out


def _ref_states(seq, th):
    """seq: [(ts, pid, rate)] of one session in order -> {pid: (status, ws, afs, trigger)}."""
    ws = afs = None
    out = {}
    for t, pid, r in seq:
        if r < th.warn:
            ws = afs = None
            out[pid] = ("NORMAL", None, None, False)
            continue
        pred = 1 if r >= th.attack else 0
        if ws is None:
            ws = t
        alert = r > th.attack or (pred == 1 and t - ws >= th.confirm_us)
        if alert:
            if afs is None:
                afs = t
            out[pid] = ("ATTACK_CONFIRMED", ws, afs, t - afs >= th.delay_us)
        else:
            out[pid] = ("WARNING", ws, afs, False)
    return out


@pytest.mark.parametrize("seed,alpha", [(1, 0.3), (2, 0.02), (2, 0.9), (1, 0.999), (1, 1.0)])
def test_rates_match_fold(spark, seed, alpha):
    rows, th = _packets(seed), TH.with_(alpha=alpha)
    df = spark.createDataFrame(rows, "pkt_id long, ts_us long, session_id string, size int")
    got = {r["pkt_id"]: r for r in packet_rates(df, "session_id", th, chunk_s=2.0).collect()}
    ref = _ref_rates(rows, th)
    assert set(got) == set(ref)
    for pid, (n, b, sstd, gstd, ewma) in ref.items():
        g = got[pid]
        assert g["pkt_count_1s"] == n
        assert g["byte_count_1s"] == b
        assert g["pkt_size_std"] == pytest.approx(sstd, abs=1e-9)
        assert g["inter_arrival_std"] == pytest.approx(gstd, abs=1e-9)
        assert g["packet_rate"] == pytest.approx(ewma, abs=1e-9)


@pytest.mark.parametrize("seed,chunk_s", [(3, 2.0), (4, 1.0), (5, 1.0)])
def test_state_machine_matches_fold(spark, seed, chunk_s):
    """Bursts last ~2.5 s, so with 1 s chunks an island spans several chunks."""
    rows = _packets(seed)
    df = spark.createDataFrame(rows, "pkt_id long, ts_us long, session_id string, size int")
    rates = packet_rates(df, "session_id", TH, chunk_s=chunk_s)
    det = mitigation_trigger(detection_state(rates, TH), TH).collect()
    by = {}
    for r in det:
        by.setdefault(r["session_id"], []).append((r["ts_us"], r["pkt_id"], r["packet_rate"]))
    ref = {}
    for s, seq in by.items():
        ref.update(_ref_states(sorted(seq), TH))
    states = {r["pkt_id"]: (r["detection_status"], r["warning_since_us"], r["alert_first_seen_us"], r["trigger"])
              for r in det}
    assert states == ref
    assert any(v[0] == "ATTACK_CONFIRMED" for v in ref.values())
    assert any(v[3] for v in ref.values())


def test_equal_timestamps_count_in_packet_order(spark):
    df = spark.createDataFrame([(1, 5, "a", 10), (2, 5, "a", 10), (3, 5, "a", 10)], "pkt_id long, ts_us long, session_id string, size int")
    assert [r.pkt_count_1s for r in trailing_features(df).orderBy("pkt_id").collect()] == [1, 2, 3]


def test_long_smoothing_keeps_every_row(spark):
    """Small weights reach back over thousands of rows and many chunks."""
    n = 3000
    df = spark.range(n).selectExpr("id AS pkt_id", "id * 100000 AS ts_us", "'a' AS session_id", "CAST(100 AS DOUBLE) AS raw_rate")
    for alpha in (0.02, 0.0005, 0.97):
        got = ewma_rate(df, th=TH.with_(alpha=alpha), chunk_s=7.0).orderBy("pkt_id").collect()
        want = 0.0
        for r in got:
            want = alpha * 100 + (1 - alpha) * want
            assert r.packet_rate == pytest.approx(want, rel=1e-9)


def test_dense_windows_cost_linear_time(spark):
    """Four times the packets in one second take about four times as long, not sixteen."""
    def took(n):
        df = spark.range(n).selectExpr("id AS pkt_id", f"id * 1000000 DIV {n} AS ts_us", "'a' AS session_id", "CAST(64 AS INT) AS size")
        best = 1e9
        for _ in range(2):
            t = time.time()
            trailing_features(df).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - t)
        return best
    took(1000)
    small, large = took(8_000), took(32_000)
    assert large < 6 * small + 2


def test_islands_of_equal_timestamps_at_a_chunk_end(spark):
    """Two cold rows of one timestamp end a chunk: the next hot row opens the island."""
    rows = [(1, 9_500_000, "a", 0.0), (2, 9_500_000, "a", 0.0), (3, 11_000_000, "a", 4.0), (4, 11_600_000, "a", 7.0)]
    df = (spark.createDataFrame(rows, "pkt_id long, ts_us long, session_id string, packet_rate double")
          .withColumn("_chunk", F.floor(F.col("ts_us") / 10_000_000).cast("long")))
    got = {r.pkt_id: r.warning_since_us for r in detection_state(df, TH).collect()}
    assert got == {1: None, 2: None, 3: 11_000_000, 4: 11_000_000}


@pytest.mark.parametrize("chunk_s", [1.0, 2.0, 7.0])
def test_stale_sessions_start_anew(spark, chunk_s):
    """Sessions with idle gaps against a fold that forgets them (gaps about the age, ties included)."""
    th = TH.with_(session_max_age_s=2.0)
    rnd, rows, pid = random.Random(21), [], 0
    for s in range(5):
        t = rnd.randint(0, 3_000_000)
        for _ in range(120):
            t += rnd.choice([0, 40_000, 90_000, 400_000, 1_999_999, 2_000_000, 2_000_001, 9_000_000] if rnd.random() < 0.2 else [30_000, 80_000])
            pid += 1
            rows.append((pid, t, f"s{s}", rnd.randint(60, 1500)))
    df = spark.createDataFrame(rows, "pkt_id long, ts_us long, session_id string, size int")
    r = packet_rates(session_episodes(df, th=th, chunk_s=chunk_s).drop("_chunk"), "_episode", th, chunk_s=chunk_s)
    det = detection_state(r, th, key="_episode").collect()
    got = {x.pkt_id: (x.pkt_count_1s, round(x.packet_rate, 9), x.detection_status, x.warning_since_us) for x in det}
    ref = {}
    for s in {x[2] for x in rows}:
        part, last = [], None
        pieces = []
        for row in sorted((x for x in rows if x[2] == s), key=lambda x: (x[1], x[0])):
            if last is not None and row[1] - last > 2_000_000:
                pieces.append(part)
                part = []
            part.append(row)
            last = row[1]
        for piece in [*pieces, part]:
            rates = _ref_rates(piece, th)
            states = _ref_states([(x[1], x[0], rates[x[0]][4]) for x in piece], th)
            ref.update({x[0]: (rates[x[0]][0], round(rates[x[0]][4], 9), states[x[0]][0], states[x[0]][1]) for x in piece})
    assert got == ref


def test_exact_threshold_edges(spark):
    """Q11: warning at rate >= warn, alert at rate > attack; the guard predicts at >= attack."""
    th = Thresholds(warn=20.0, attack=50.0, confirm_s=1.0)
    rows = [(1, 0, "a", 0.0), (2, 1_000, "a", 20.0), (3, 2_000, "a", 50.0), (4, 1_002_000, "a", 50.0),
            (5, 1_003_000, "a", 19.999), (6, 1_004_000, "a", 50.0001)]
    df = (spark.createDataFrame(rows, "pkt_id long, ts_us long, session_id string, packet_rate double")
          .withColumn("_chunk", F.lit(0).cast("long")))
    got = {r["pkt_id"]: r["detection_status"] for r in detection_state(df, th).collect()}
    assert got == {1: "NORMAL", 2: "WARNING", 3: "WARNING", 4: "ATTACK_CONFIRMED", 5: "NORMAL",
                   6: "ATTACK_CONFIRMED"}


@pytest.mark.parametrize("interval_s", [0.025, 2.0])
def test_throttle_matches_fold(spark, interval_s):
    rnd = random.Random(7)
    rows = [(i, rnd.randint(0, 20_000_000), f"k{rnd.randint(0, 3)}") for i in range(2000)]
    df = spark.createDataFrame(rows, "pkt_id long, ts_us long, src string")
    got = {(r["key"], r["pkt_id"]) for r in throttle(df, "src", interval_s, slice_s=3.0).collect()}
    iu = int(round(interval_s * 1e6))
    ref = set()
    for k in {r[2] for r in rows}:
        last = None
        for pid, t, _ in sorted((r for r in rows if r[2] == k), key=lambda r: (r[1], r[0])):
            if last is None or t - last >= iu:
                ref.add((k, pid))
                last = t
    assert got == ref


def test_throttle_across_arrow_batches(spark):
    """A key's rows split over many Arrow batches and slices keep one chain."""
    rnd = random.Random(11)
    rows = [(i, rnd.randint(0, 30_000_000), f"k{rnd.randint(0, 2)}") for i in range(1500)]
    df = spark.createDataFrame(rows, "pkt_id long, ts_us long, src string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["key"], r["pkt_id"]) for r in throttle(df, "src", 0.05, slice_s=4.0).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    iu = 50_000
    ref = set()
    for k in {r[2] for r in rows}:
        last = None
        for pid, t, _ in sorted((r for r in rows if r[2] == k), key=lambda r: (r[1], r[0])):
            if last is None or t - last >= iu:
                ref.add((k, pid))
                last = t
    assert got == ref


@pytest.mark.parametrize("slice_s", [0.004, 0.5, 100.0])
def test_throttle_of_a_hot_key(spark, slice_s):
    """Nine tenths of the rows are of one key, with ties and without a gap to cut at."""
    rnd = random.Random(13)
    rows = [(i, rnd.randint(0, 3_000_000) // 3 * 3, "hot" if rnd.random() < 0.9 else f"k{rnd.randint(0, 5)}") for i in range(4000)]
    df = spark.createDataFrame(rows, "pkt_id long, ts_us long, src string")
    got = {(r["key"], r["ts_us"], r["pkt_id"]) for r in throttle(df, "src", 0.01, slice_s=slice_s).collect()}
    ref = set()
    for k in {r[2] for r in rows}:
        last = None
        for t, pid in sorted((r[1], r[0]) for r in rows if r[2] == k):
            if last is None or t - last >= 10_000:
                ref.add((k, t, pid))
                last = t
    assert got == ref
    assert throttle(df.limit(0), "src", 0.01).count() == 0
    assert throttle(df, "src", 0.0).count() == len(rows)
