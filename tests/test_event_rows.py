"""Whole event rows (P16): admission, ported sessions, learned ports and running
counts against a packet-by-packet loop; suppressed packets still count."""

import random

from pyspark.sql import functions as F

from floodlens.config import OFPP_FLOOD, Thresholds
from floodlens.plans import eventlog
from floodlens.plans.fixture import FIXTURE_TH, WATCHED
from floodlens.schemas import TRAFFIC_EVENT
from floodlens.sources.io import append_log, read_event_log

KIND = ("pkt_id long, ts_us long, dpid int, in_port int, src_mac string, dst_mac string, eth_type int, ip_proto int, src_ip string, "
        "dst_ip string, src_port int, dst_port int, icmp_type int, size int")
NAMES = [c.split()[0] for c in KIND.split(", ")]


def one_by_one(rows):
    """(pkt_id, session, out_port, packet_count, src_port, dst_port) of each row that is logged."""
    learned, counts, out = {}, {}, []
    for r in sorted((dict(zip(NAMES, r)) for r in rows), key=lambda r: (r["ts_us"], r["pkt_id"])):
        if r["eth_type"] == 0x88CC:
            continue
        learned[r["dpid"], r["src_mac"]] = r["in_port"]
        port = learned.get((r["dpid"], r["dst_mac"]), OFPP_FLOOD)
        name = {1: "ICMP", 6: "TCP", 17: "UDP"}.get(r["ip_proto"])
        if r["eth_type"] != 0x0800 or not name or name == "ICMP" and r["icmp_type"] != 8:
            continue
        ported = name != "ICMP" and r["src_port"] and r["dst_port"]
        a, b = (f"{r['src_ip']}:{r['src_port']}", f"{r['dst_ip']}:{r['dst_port']}") if ported else (r["src_ip"], r["dst_ip"])
        session = f"{a}->{b}:{name}"
        counts[session] = counts.get(session, 0) + 1
        out.append((r["pkt_id"], session, port, counts[session], r["src_port"], r["dst_port"]))
    return out


def some_rows(n, seed=3):
    rng, rows = random.Random(seed), []
    for k in range(n):
        eth = rng.choice([0x0800] * 8 + [0x0806, 0x86DD, 0x88CC])
        proto = rng.choice([1, 6, 17, 47]) if eth == 0x0800 else None
        s, d = rng.randrange(2, 6), rng.randrange(2, 7)
        ports = (rng.choice([None, 1024, 1025]), rng.choice([None, 80])) if proto in (6, 17) else (None, None)
        rows.append((k, rng.randrange(0, 30_000_000) // 1000 * 1000, rng.randrange(1, 3), rng.randrange(1, 4), f"m{s}", f"m{d}", eth, proto,
                     f"10.0.0.{s}", f"10.0.0.{d}", *ports, rng.choice([0, 8]) if proto == 1 else None, 98))
    return rows


def test_rows_one_by_one(spark):
    rows = some_rows(600)
    ev, _, drops = eventlog.build_whole(spark.createDataFrame(rows, KIND), Thresholds(), WATCHED, 7.0)
    got = ev.select("pkt_id", "session_id", "out_port", "packet_count", "src_port", "dst_port").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(one_by_one(rows), key=repr)
    assert drops.count() == 0 and {r.event_note for r in ev.select("event_note").collect()} <= {"tcp_normal", "udp_normal", "icmp_non_victim"}


def test_suppressed_packets_count(spark):
    """A flood that is dropped and released: its rows' counts are the packets' numbers."""
    rows = [(k, k * 100_000, 3, 1, "m6", "m25", 0x0800, 1, "10.0.0.6", WATCHED.victim, None, None, 8, 98) for k in range(300)]
    ev, log, drops = eventlog.build_whole(spark.createDataFrame(rows, KIND), FIXTURE_TH, WATCHED, 10.0)
    got = ev.select("pkt_id", "packet_count", "out_port").collect()
    assert 0 < len(got) < 300 and drops.count() == 1
    assert all(r.packet_count == r.pkt_id + 1 and r.out_port == OFPP_FLOOD for r in got)
    notes = {r.action: r.note for r in log.select("action", "note").collect()}
    assert "10.0.0.6" in notes["DROP_ICMP"] and "NORMAL phase" in notes["RELEASE_DROP"]


def test_round_trip_through_the_text_log(spark, tmp_path):
    ev = eventlog.build_whole(spark.createDataFrame(some_rows(80), KIND), Thresholds(), WATCHED, 10.0)[0]
    text, path = eventlog.log_text(ev), str(tmp_path / "log")
    assert text.columns == TRAFFIC_EVENT.names
    append_log(text, path)
    back = read_event_log(spark, path).fillna("")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, text.collect()))


def test_empty_and_null_rows(spark):
    df = spark.createDataFrame([(1, 0, *[None] * 12), (2, 5, 1, 1, None, None, 0x0800, 6, "10.0.0.2", None, None, None, None, None)], KIND)
    assert eventlog.build_whole(df, Thresholds(), WATCHED, 10.0)[0].select("pkt_id").collect() == [(2,)]
    assert eventlog.build_whole(df.where(F.lit(False)), Thresholds(), WATCHED, 10.0)[0].count() == 0
