"""One observation a packet (Q6): floods of one identity over two to four switches,
chunk borders, lost observations, nulls; batch = stream is the registered twin's."""

import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from floodlens.operators.hops import dedupe_hops, dedupe_hops_stream
from floodlens.session import checkpoint_dir
from floodlens.streaming.source import run_available_now

KIND = "pkt_id long, ts_us long, src_ip string, dst_ip string, protocol string, size int, dpid int, extra string"


def observe(packets, path, latency=700):
    return [(pid, t + j * latency, src, "10.0.0.25", "ICMP", 98, d, "x") for pid, t, src in packets for j, d in enumerate(path)]


@pytest.mark.parametrize("path", [[1], [1, 2], [3, 1, 2], [4, 3, 2, 1]])
@pytest.mark.parametrize("chunk_s", [0.5, 30.0])
def test_a_flood_of_one_identity(spark, path, chunk_s):
    """Packets follow each other faster than they cross the switches."""
    rng = random.Random(len(path))
    times = sorted(rng.sample(range(0, 2_000_000), 4_000))  # one each 500 us, hops 700 us apart
    packets = [(k, t, "10.0.0.1") for k, t in enumerate(times)] + [(10_000 + k, rng.randint(0, 2_000_000), "10.0.0.2") for k in range(20)]
    df = spark.createDataFrame(observe(packets, path), KIND)
    got = sorted((r.pkt_id, r.ts_us, r.dpid) for r in dedupe_hops(df, 0.005, chunk_s=chunk_s).collect())
    assert got == sorted((pid, t, path[0]) for pid, t, _ in packets)


def test_a_lost_observation_is_forgotten_after_silence(spark):
    """The entry switch misses packet 1: it shows at the next one; later bursts aren't shifted."""
    rows = [r for r in observe([(0, 0, "a"), (1, 2_000, "a"), (2, 1_000_000, "a"), (3, 1_002_000, "a")], [1, 2]) if r[:2] != (1, 2_000)]
    got = sorted((r.pkt_id, r.dpid) for r in dedupe_hops(spark.createDataFrame(rows, KIND), 0.005).collect())
    assert got == [(0, 1), (1, 2), (2, 1), (3, 1)]


def test_nulls_and_empty_tables(spark):
    rows = [(1, 0, None, None, "ICMP", None, None, "x"), (2, 100, None, None, "ICMP", None, 2, "y"), (3, 200, None, "b", "ICMP", None, 2, "z")]
    df = spark.createDataFrame(rows, KIND)
    out = dedupe_hops(df, 0.005)
    assert out.columns == df.columns
    assert sorted(r.pkt_id for r in out.collect()) == [1, 3]
    assert dedupe_hops(df.limit(0), 0.005).count() == 0
    assert dedupe_hops(df.withColumn("ts_us", F.col("ts_us") * 1_000_000), 0.005).count() == 3  # silence between them


def test_stream_calls_are_as_many_as_the_buckets(spark):
    """Hundreds of identities over three files: three states, and the rows of the batch."""
    rng = random.Random(7)
    packets = [(k, rng.randint(1, 3_000_000), rng.choice([None, *map(str, range(300))])) for k in range(1_500)]
    packets += [(5_000 + k, 900_000 + 2_000 * k, "flood") for k in range(500)]  # one burst over two files
    rows = observe(packets, [2, 1, 3]) + [(9_000 + k, 1_000 + 400 * k, "lost", None, "ICMP", None, rng.choice([None, 1, 2]), "x") for k in range(200)]
    d = f"{checkpoint_dir(spark).rstrip('/')}/hops-{uuid.uuid4().hex[:8]}"
    for k in range(4):  # the last file closes the stream
        part = [r for r in rows if r[1] // 1_000_000 == k] if k < 3 else [(-1, 90_000_000, "end", "b", "ICMP", 1, 1, "x")]
        spark.createDataFrame(part + ([r for r in rows if r[1] >= 3_000_000] if k == 2 else []), KIND).coalesce(1).write.mode("append").parquet(d)
        time.sleep(1.1)
    s = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(d).withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", "300 milliseconds")
    first = dedupe_hops_stream(s, 0.005, buckets=3)
    assert first.columns == ["src_ip", "dst_ip", "protocol", "size", "pkt_id", "ts_us", "dpid"] and dict(first.dtypes)["size"] == "int"
    got = run_available_now(first, "t-hops")
    want = dedupe_hops(spark.createDataFrame(rows, KIND), 0.005).select(*first.columns)
    assert sorted(map(tuple, got.where("pkt_id >= 0").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    kept = spark.read.format("statestore").option("batchId", 2).load(f"{got.inputFiles()[0].rsplit('/table/', 1)[0]}/_checkpoint")
    assert 1 <= kept.count() <= 3
