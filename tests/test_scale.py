"""Operators whose work must not pile up in one task, one group or one driver
loop, against plain sequential folds: throttle tree, radix quantiles, pointer-
doubled mitigation cycle."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from floodlens.config import Thresholds
from floodlens.operators import timeline
from floodlens.operators.mitigate import mitigation_cycle
from floodlens.operators.sequence import chain_in_rounds, exact_percentiles, first_at_or_after, map_runs, order_key
from floodlens.operators.timeline import _merged, _then, throttle


# ------------------------------------------------------------------ throttle
def kept(rows, interval):
    out, last = set(), {}
    for key, t, i in sorted(rows):
        if key not in last or t - last[key] >= interval:
            out.add((key, t, i))
            last[key] = t
    return out


def test_composed_step_functions():
    """A span's function is its parts' functions one after the other, and pruned pieces are never asked for."""
    rng = np.random.default_rng(1)

    def function(ts, interval):
        leave = []
        for t in ts.tolist():
            while True:
                later = ts[ts >= t + interval]
                if not len(later):
                    break
                t = int(later[0])
            leave.append(t)
        return ts, np.array(leave, np.int64)

    for _ in range(60):
        interval, width = int(rng.integers(1, 40)), 50
        slices = [np.sort(rng.integers(k * width, (k + 1) * width, rng.integers(0, 12))) for k in range(5)]
        whole = function(np.concatenate(slices), interval)
        upto, leave = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k, ts in enumerate(slices):
            u, l = _merged(*function(ts, interval), k * width + interval)
            upto, leave = _merged(*_then(upto, leave, u, l, interval), interval)
        for entry in [-10 ** 9, *range(0, interval)]:  # from an event before the span
            a, b = np.searchsorted(whole[0], entry), np.searchsorted(upto, entry)
            assert (b < len(upto)) == (a < len(whole[0]))
            if b < len(upto):
                assert leave[b] == whole[1][a]


def test_throttle_over_a_hundred_thousand_slices(spark):
    rng = random.Random(5)
    rows = [("hot", t * 1_000 + rng.randint(0, 999), t) for t in range(100_000)] + [(f"k{t % 7}", rng.randint(0, 10 ** 8), -t) for t in range(1, 2_000)]
    df = spark.createDataFrame(rows, "src string, ts_us long, pkt_id long")
    got = {tuple(r) for r in throttle(df, "src", 0.0155, slice_s=0.001).collect()}
    assert got == kept(rows, 15_500)


@pytest.mark.parametrize("fan", [2, 5])
def test_throttle_tree_of_many_levels(spark, monkeypatch, fan):
    monkeypatch.setattr(timeline, "FAN", fan)
    rng = random.Random(fan)
    rows = [("hot" if rng.random() < 0.9 else f"k{i % 3}", 10 ** 12 + rng.choice([0, 3_000_000]) + rng.randint(0, 400_000) // 7 * 7, i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "src string, ts_us long, pkt_id long")
    assert {tuple(r) for r in throttle(df, "src", 0.011, slice_s=0.004).collect()} == kept(rows, 11_000)


def test_runs_of_batches_are_put_together_once(spark):
    rows = [(k, i) for k in ("a", "b", "c") for i in range({"a": 40, "b": 3, "c": 100}[k])]
    df = spark.createDataFrame(rows, "k string, i long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = map_runs(df, ["k"], ["i"], lambda key, c: {"k": [key[0]], "n": [len(c["i"])], "s": [int((np.diff(c["i"]) == 1).all())]}, "k string, n long, s int").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(map(tuple, out)) == [("a", 40, 1), ("b", 3, 1), ("c", 100, 1)]


# ----------------------------------------------------------------- quantiles
def test_order_key_orders_like_the_numbers():
    v = np.sort(np.concatenate([np.random.default_rng(2).normal(size=200) * 10.0 ** np.arange(-100, 100), [0.0, math.inf, -math.inf, 5e-324, -5e-324]]))
    assert (np.diff(order_key(pd.Series(v)).to_numpy()) > 0).all()
    assert order_key(pd.Series([0.0])).iloc[0] == order_key(pd.Series([-0.0])).iloc[0]


@pytest.mark.parametrize("few", [0, 200, 65_536])
def test_quantiles_survive_outliers(spark, few):
    """One huge value must not put all the others into one bucket."""
    rng = random.Random(7)
    rows = [("a", rng.random()) for _ in range(2_000)] + [("a", 1e12), ("a", -1e300), ("b", 1.0), ("b", None), ("c", None)]
    rows += [("d", rng.choice([5e-324, 1e-9, 3.0, -0.0, 0.0, 1e308])) for _ in range(501)] + [("e", 2.5)] * 300
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r._p for r in exact_percentiles(df, "v", ["g"], probs, few=few).collect()}
    want = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("p")).collect() if r.p is not None}
    assert set(got) == set(want) == {"a", "b", "d", "e"}
    for g in want:
        assert np.allclose(got[g], want[g], rtol=1e-12, atol=0)


# ----------------------------------------------------------- mitigation cycle
def cycle(rows, th):
    """Rows of one source in order: (ts, id, rate, prediction)."""
    out, until, ws, afs = [], None, None, None
    for t, _, rate, pred in sorted(rows):
        if until is not None:
            if t < until:
                continue
            until = ws = afs = None
        if rate < th.warn:
            ws = afs = None
            continue
        ws = t if ws is None else ws
        if rate > th.attack or (pred == 1 and t - ws >= th.confirm_us):
            afs = t if afs is None else afs
            if t - afs >= th.delay_us:
                out.append((t, t + th.hard_timeout_us, len(out) + 1))
                until = t + th.hard_timeout_us
    return out


def detector_rows(rng, sources, n):
    rows = []
    for i in range(n):
        src = sources[0] if rng.random() < 0.9 else rng.choice(sources)
        rows.append((src, rng.randint(0, 60_000_000) // 1000 * 1000, i, rng.choice([0.0] + 3 * [1.6, 2.0, 2.4, 2.6, 5.0, 5.0]), rng.randint(0, 1)))
    out, cold = [], {}
    for src, t, i, rate, pred in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if rate < 1.5:
            cold[src] = (t, i)
        out.append((src, t, i, rate, pred if rate >= 1.5 else 0, cold.get(src, (-1, -1))))
    return out


@pytest.mark.parametrize("times", [(0.2, 0.3, 1.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.4), (0.0, 1.5, 7.0), (0.05, 0.05, 0.011)])
def test_cycle_by_pointer_doubling(spark, times):
    """A source with 90 % of the rows, cold rows between, ties, re-activations in later islands."""
    confirm, delay, hard = times
    th = Thresholds(warn=1.5, attack=2.5, confirm_s=confirm, delay_s=delay, hard_timeout_s=hard)
    rng = random.Random(int(10 * sum(times)))
    rows = detector_rows(rng, ["10.0.0.1", "10.0.0.2", "10.0.0.3", "10.0.0.4"], 2_500)
    df = spark.createDataFrame(rows, "src_ip string, ts_us long, pkt_id long, packet_rate double, final_prediction int, _island struct<c:long,i:long>")
    got = sorted(map(tuple, mitigation_cycle(df, th, slice_s=2.0).collect()))
    want = sorted((src, *a) for src in {r[0] for r in rows} for a in cycle([r[1:5] for r in rows if r[0] == src], th))
    assert got == want and want


def test_cycle_without_rows(spark):
    df = spark.createDataFrame([], "src_ip string, ts_us long, pkt_id long, packet_rate double, final_prediction int, _island string")
    assert mitigation_cycle(df).collect() == []


def test_long_chains_take_few_rounds(spark):
    n = 300
    edges = spark.createDataFrame([("a", k, k + 1 if k < n - 1 else None) for k in range(n)] + [("b", 5, None), ("c", 9, 4), ("c", 4, None), ("c", 3, 9)], "k string, at long, to long")
    starts = spark.createDataFrame([("a", 0), ("b", 5), ("c", 9)], "k string, at long")
    got = {tuple(r) for r in chain_in_rounds(edges, starts, "k", "at", "to", "t").select("k", "at", "place").collect()}
    assert got == {("a", k, k + 1) for k in range(n)} | {("b", 5, 1), ("c", 9, 1), ("c", 4, 2)}


def test_forward_search_crosses_chunks(spark):
    rng = random.Random(3)
    place = lambda t, i: {"c": t, "i": i}
    marks = [(rng.choice("ab"), place(rng.randint(0, 500), rng.randint(0, 3)), k) for k in range(40)]
    asks = [(rng.choice("abz"), place(rng.randint(-50, 550), rng.randint(0, 3)), k) for k in range(300)]
    kind = "k string, _at struct<c:long,i:long>, "
    got = first_at_or_after(spark.createDataFrame(asks, kind + "n long"), spark.createDataFrame(marks, kind + "_mark long"), "k", 20, "hit")
    for r in got.collect():
        later = [(m[1]["c"], m[1]["i"]) for m in marks if m[0] == r.k and (m[1]["c"], m[1]["i"]) >= tuple(r._at)]
        hits = {m[2] for m in marks if m[0] == r.k and later and (m[1]["c"], m[1]["i"]) == min(later)}
        assert (r.hit in hits) if later else r.hit is None
    assert got.count() == len(asks)
