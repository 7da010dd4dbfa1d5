"""Identities that must hold on any input and edge cases (5.6)."""

from pyspark.sql import functions as F

from floodlens.config import VICTIM_IP, Thresholds
from floodlens.operators.mitigate import exclude_post_drop, pre_post_counts
from floodlens.operators.report import packet_summary, scenario_summary
from floodlens.operators.timeline import dense_bins, phase_segments
from floodlens.sources.adapter import packets
from tests.conftest import SF_SMALL


def _pk(spark):
    return packets(spark, SF_SMALL)


def _drops(spark, pk):
    # every source's median time as its drop: a drop inside the data for each source
    return pk.groupBy("src_ip").agg(F.percentile_approx("ts_us", 0.5).alias("drop_us"))


def test_pre_plus_post_is_total(spark):
    pk = _pk(spark)
    pp = pre_post_counts(pk, _drops(spark, pk)).collect()
    total = dict(pk.groupBy("src_ip").count().collect())
    assert {r["src_ip"]: r["pre_drop"] + r["post_drop"] for r in pp} == total
    assert all(r["post_drop"] > 0 for r in pp)


def test_clean_is_subset_of_raw(spark):
    pk = _pk(spark)
    drops = _drops(spark, pk)
    clean = exclude_post_drop(pk, drops, VICTIM_IP)
    assert clean.subtract(pk).count() == 0
    removed = pk.subtract(clean)
    # everything removed is ICMP to the victim at or after its source's drop
    bad = (removed.join(drops, "src_ip")
           .filter((F.col("protocol") != "ICMP") | (F.col("dst_ip") != VICTIM_IP)
                   | (F.col("ts_us") < F.col("drop_us"))))
    assert bad.count() == 0
    assert removed.count() > 0


def test_dense_series_sum_is_count(spark):
    pk = _pk(spark)
    s = dense_bins(pk, ["protocol"], 1.0, "count")
    got = {r["protocol"]: r["s"] for r in s.groupBy("protocol").agg(F.sum("value").alias("s")).collect()}
    want = {r["protocol"]: float(r["count"]) for r in pk.groupBy("protocol").count().collect()}
    assert got == want
    # the spine is gap-free: one bin per width from the first to the last
    span = (s.groupBy("protocol").agg(F.count(F.lit(1)).alias("n"), F.min("bin_start_us").alias("lo"),
                                      F.max("bin_start_us").alias("hi"))
            .filter(F.col("n") != (F.col("hi") - F.col("lo")) / 1_000_000 + 1))
    assert span.count() == 0


def test_phase_segments_tile_the_span(spark):
    pk = _pk(spark)
    ph = pk.withColumn("phase", F.when(F.col("ts_us") % 7 == 0, "attack")
                       .when(F.col("ts_us") % 11 == 0, "").otherwise("normal"))
    seg = sorted(phase_segments(ph, bucket_s=5.0).collect(), key=lambda r: r["start_us"])
    lo, hi = pk.agg(F.min("ts_us"), F.max("ts_us")).first()
    assert seg[0]["start_us"] == lo and seg[-1]["end_us"] == hi
    for a, b in zip(seg, seg[1:]):
        assert a["end_us"] == b["start_us"]
        assert a["phase"] != b["phase"]
    # brute force: changes over the time-ordered rows
    rows = sorted(ph.select("ts_us", "pkt_id", "phase").collect(), key=lambda r: (r[0], r[1]))
    changes, prev = [], None
    for t, _, p in rows:
        p = (p or "").upper() or "NORMAL"
        if p != prev:
            changes.append((t, p))
            prev = p
    assert [(r["start_us"], r["phase"]) for r in seg] == changes


def test_empty_input(spark):
    pk = _pk(spark).limit(0)
    cap = pk.withColumnRenamed("src_ip", "src").withColumnRenamed("dst_ip", "dst")
    assert packet_summary(cap).first()["packets"] == 0
    assert scenario_summary(pk.withColumn("scenario", F.lit("x")).withColumn("packet_rate", F.lit(1.0))).count() == 0
    assert dense_bins(pk, ["protocol"], 1.0).count() == 0


def test_single_row_rates(spark):
    from floodlens.operators.rates import packet_rates
    df = spark.createDataFrame([(1, 5_000_000, "s", 100)], "pkt_id long, ts_us long, session_id string, size int")
    r = packet_rates(df, "session_id", Thresholds()).first()
    assert r["pkt_count_1s"] == 1 and r["pkt_size_std"] == 0.0 and r["inter_arrival_std"] == 0.0
    assert abs(r["packet_rate"] - 0.3) < 1e-12


def test_merge_intervals_matches_sweep(spark):
    import random
    from floodlens.operators.mitigate import merge_intervals
    rnd = random.Random(5)
    iv = []
    for _ in range(300):
        s = rnd.randint(0, 50_000_000)
        iv.append((s, s + rnd.randint(1, 3_000_000)))
    df = spark.createDataFrame(iv, "start_us long, end_us long")
    got = sorted(tuple(r) for r in merge_intervals(df, bucket_s=4.0).collect())
    want = []
    for s, e in sorted(iv):
        if want and s <= want[-1][1]:
            want[-1] = (want[-1][0], max(want[-1][1], e))
        else:
            want.append((s, e))
    assert got == want


def test_global_rank_matches_sort(spark):
    from floodlens.operators.sequence import global_rank
    rows = [(f"k{i % 97}", i % 13) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int").groupBy("k", "v").count().repartition(7)
    got = {(r["k"], r["v"]): r["rank"] for r in global_rank(df, [F.desc("count"), F.asc("k"), F.asc("v")]).collect()}
    order = sorted(((r["k"], r["v"], r["count"]) for r in df.collect()), key=lambda t: (-t[2], t[0], t[1]))
    assert got == {(k, v): i + 1 for i, (k, v, _) in enumerate(order)}


def test_exact_percentiles_match_spark(spark):
    import random
    from floodlens.operators.sequence import exact_percentiles
    rnd = random.Random(9)
    rows = [("a", rnd.random() * 100) for _ in range(3000)] + [("a", 42.0)] * 2000 \
        + [("b", float(rnd.randint(0, 5))) for _ in range(501)] + [("c", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["g"]: r["_p"] for r in exact_percentiles(df, "v", ["g"], probs, few=50).collect()}
    ref = {r["g"]: r["p"] for r in df.groupBy("g").agg(
        F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("p")).collect()}
    assert set(got) == set(ref)
    for g in ref:
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[g], ref[g])), (g, got[g], ref[g])
