"""Time series: dense bins (W1-W5), phase run-length segments (W10), attacker
lifecycle segments (W11), as-of port lookup (J7) and throttling (W18)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodlens.config import OFPP_FLOOD
from floodlens.functions.numeric import q
from floodlens.operators.sequence import CHUNK, add_chunk, chunk_window, map_runs
from floodlens.session import materialize


def dense_bins(df: DataFrame, keys: list[str], width_s: float, how: str = "count",
               value: str | None = None) -> DataFrame:
    """Aligned bins of ``width_s`` per key; every bin from the key's own
    first to last bin is present, empty bins are 0.  ``how``: ``mean`` / ``sum``
    of ``value``, ``count`` of rows, ``pps`` = count / width.
    Output: keys, ``bin_start_us``, ``value``."""
    wu = int(round(width_s * 1_000_000))
    b = df.withColumn("_bin", F.floor(F.col("ts_us") / F.lit(wu)).cast("long"))
    agg = {"mean": lambda: F.avg(value), "sum": lambda: F.sum(value), "count": lambda: F.count(F.lit(1)),
           "pps": lambda: F.count(F.lit(1)) / F.lit(float(width_s))}[how]()
    vals = b.groupBy(*keys, "_bin").agg(agg.cast("double").alias("_v"))
    spine = (vals.groupBy(*keys).agg(F.min("_bin").alias("_lo"), F.max("_bin").alias("_hi"))
             .select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("_bin")))
    return (spine.join(vals, [*keys, "_bin"], "left")
            .select(*keys, (F.col("_bin") * F.lit(wu)).alias("bin_start_us"),
                    q(F.coalesce("_v", F.lit(0.0))).alias("value")))


def phase_segments(df: DataFrame, phase: str = "phase", bucket_s: float = 60.0) -> DataFrame:
    """Run-length segments of ``upper(phase)`` ('' -> NORMAL) over time.

    The series has one global order, so it is cut into time buckets: changes
    are found inside each bucket, the first row of a bucket compares with the
    previous bucket's last phase, and a segment's end is the next change (or
    the last timestamp), carried across buckets from per-bucket summaries."""
    bu = int(round(bucket_s * 1_000_000))
    p = F.when(F.upper(F.coalesce(F.col(phase), F.lit(""))) == "", "NORMAL").otherwise(F.upper(F.col(phase)))
    x = (df.filter(F.col("ts_us").isNotNull()).select("ts_us", "pkt_id", p.alias("_p"))
         .withColumn("_b", F.floor(F.col("ts_us") / F.lit(bu)).cast("long")))
    w = Window.partitionBy("_b").orderBy("ts_us", "pkt_id")
    x = x.withColumn("_prev", F.lag("_p").over(w))
    summ = x.groupBy("_b").agg(F.max_by("_p", F.struct("ts_us", "pkt_id")).alias("_last"),
                               F.max("ts_us").alias("_bmax"))
    # one row per time bucket: a global window over bucket summaries is bounded by the span
    ws = Window.orderBy("_b")
    carry = summ.select("_b", F.lag("_last").over(ws).alias("_carry"))
    ch = (x.join(carry, "_b", "left")
          .withColumn("_before", F.coalesce("_prev", "_carry"))
          .filter(F.col("_before").isNull() | (F.col("_before") != F.col("_p")))
          .select("_b", "ts_us", "pkt_id", F.col("_p").alias("phase")))
    # end of a segment = start of the next change
    wc = Window.partitionBy("_b").orderBy("ts_us", "pkt_id")
    ch = ch.withColumn("_next", F.lead("ts_us").over(wc))
    first_change = ch.groupBy("_b").agg(F.min("ts_us").alias("_first"))
    nxt = (summ.select("_b").join(first_change, "_b", "left")
           .withColumn("_nextb", F.first("_first", ignorenulls=True).over(
               ws.rowsBetween(1, Window.unboundedFollowing)))
           .select("_b", "_nextb"))
    last_ts = df.agg(F.max("ts_us").alias("_end"))
    return (ch.join(nxt, "_b", "left").crossJoin(F.broadcast(last_ts))
            .select("phase", F.col("ts_us").alias("start_us"),
                    F.coalesce("_next", "_nextb", "_end").alias("end_us")))


def lifecycle_segments(stats: DataFrame, extend_s: float = 5.0) -> DataFrame:
    """Per attacker NORMAL first_seen->first_warn, WARNING first_warn->first_conf,
    ATTACK first_conf->drop, MITIGATED drop->last_seen (drop + 5 s when last_seen <= drop);
    each segment only when both ends exist (the NORMAL one needs a first warning)."""
    ext = int(round(extend_s * 1_000_000))
    mit_end = F.when(F.col("last_seen_us") > F.col("drop_us"), F.col("last_seen_us")).otherwise(
        F.col("drop_us") + F.lit(ext))
    segs = F.array(
        F.struct(F.lit("NORMAL").alias("state"), F.col("first_seen_us").alias("s"),
                 F.col("first_warn_us").alias("e")),
        F.struct(F.lit("WARNING").alias("state"), F.col("first_warn_us").alias("s"),
                 F.col("first_conf_us").alias("e")),
        F.struct(F.lit("ATTACK").alias("state"), F.col("first_conf_us").alias("s"), F.col("drop_us").alias("e")),
        F.struct(F.lit("MITIGATED").alias("state"), F.col("drop_us").alias("s"), mit_end.alias("e")))
    return (stats.select("src_ip", F.explode(segs).alias("g"))
            .filter(F.col("g.s").isNotNull() & F.col("g.e").isNotNull())
            .select("src_ip", F.col("g.state").alias("state"), F.col("g.s").alias("start_us"),
                    F.col("g.e").alias("end_us")))


def last_seen_port(obs: DataFrame, chunk_s: float = 10.0, flood: int = OFPP_FLOOD) -> DataFrame:
    """``out_port`` = the latest ``in_port`` learned for (switch, dst MAC) at or
    before this packet (its own learning included), else FLOOD.

    Learn rows (switch, src MAC, in_port) and lookup rows (switch, dst MAC) are
    unioned; the as-of value is a running last-non-null per (switch, MAC) in
    time chunks plus a carry from the earlier chunks."""
    learn = obs.select("dpid", F.col("src_mac").alias("_mac"), "ts_us", "pkt_id", F.lit(0).alias("_kind"),
                       F.col("in_port").cast("long").alias("_port"))
    look = obs.select("dpid", F.col("dst_mac").alias("_mac"), "ts_us", "pkt_id", F.lit(1).alias("_kind"),
                      F.lit(None).cast("long").alias("_port"))
    u = add_chunk(learn.unionByName(look), int(round(chunk_s * 1_000_000)))
    keys = ["dpid", "_mac"]
    w = chunk_window(keys, ["ts_us", "pkt_id", "_kind"]).rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_in", F.last("_port", ignorenulls=True).over(w))
    summ = (u.filter(F.col("_port").isNotNull()).groupBy(*keys, CHUNK)
            .agg(F.max_by("_port", F.struct("ts_us", "pkt_id")).alias("_lastp")))
    wc = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    all_chunks = u.select(*keys, CHUNK).distinct()
    carry = (all_chunks.join(summ.select(*keys, CHUNK, "_lastp"), [*keys, CHUNK], "left")
             .withColumn("_carry", F.last("_lastp", ignorenulls=True).over(wc)).drop("_lastp"))
    return (u.filter(F.col("_kind") == 1).join(carry, [*keys, CHUNK], "left")
            .select("pkt_id", "dpid", F.col("_mac").alias("dst_mac"),
                    F.coalesce("_in", "_carry", F.lit(flood).cast("long")).alias("out_port")))


THROTTLE_SCHEMA = "key string, ts_us long, pkt_id long"


def _jumps(ts: np.ndarray, interval: int) -> np.ndarray:
    """For each of the sorted times, the place of the first one ``interval`` later (the length, if none)."""
    return np.append(np.searchsorted(ts, ts + interval), len(ts))


#: neighbouring step functions that are composed at a time
FAN = 64


def _merged(upto: np.ndarray, leave: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """A step function with equal neighbours made one, up to the piece that covers entries below ``bound``."""
    if not len(upto):
        return upto, leave
    piece = np.append(leave[1:] != leave[:-1], True)
    upto, leave = upto[piece], leave[piece]
    keep = int(np.searchsorted(upto, bound - 1)) + 1
    return upto[:keep], leave[:keep]


def _then(upto: np.ndarray, leave: np.ndarray, upto2: np.ndarray, leave2: np.ndarray, interval: int) -> tuple[np.ndarray, np.ndarray]:
    """The step function of one span of time followed by the next one's."""
    at = np.searchsorted(upto2, leave + interval)
    hit = at < len(upto2)
    out = np.where(hit, leave2[np.minimum(at, max(0, len(leave2) - 1))] if len(leave2) else leave, leave)
    past = np.searchsorted(upto2, upto[-1], side="right") if len(upto) else 0  # entries that pass the first span
    return np.concatenate([upto, upto2[past:]]), np.concatenate([out, leave2[past:]])


def throttle(df: DataFrame, key: str, interval_s: float, slice_s: float = 60.0) -> DataFrame:
    """Keep an event iff at least ``interval_s`` passed since the last
    *kept* event of its key.

    A greedy chain, solved by a tree.  A (key, slice) is a step function: from
    the earliest time at which an event may be kept to the last event kept in the
    slice.  Slices compute their functions side by side (jumping pointers, no row
    loop), and ``FAN`` neighbours at a time are composed into the function of a
    longer span, level by level, until one is left.  On the way down again each
    span's entry gives those of its parts, and every slice marks its chain from
    its known entry.  An entry comes from an event before the span, so it is less
    than one interval after the span's start: later pieces of a function are
    never asked for and are left out.  No group holds more than ``FAN`` functions,
    however many slices a key has."""
    iu = int(round(interval_s * 1_000_000))
    su = max(1, int(round(slice_s * 1_000_000)))
    x = df.select(F.col(key).cast("string").alias("key"), "ts_us", "pkt_id")
    if iu <= 0:
        return x
    x = add_chunk(x.filter(F.col("key").isNotNull()), su)
    order, node = ["ts_us", "pkt_id"], "_node"
    schema = f"key string, {node} long, upto array<long>, leave array<long>"

    def step(run, c):
        ts = c["ts_us"]
        last = np.minimum(_jumps(ts, iu)[:-1], len(ts))
        last = np.where(last < len(ts), last, np.arange(len(ts)))  # the end of a chain stays where it is
        while (last[last] != last).any():
            last = last[last]
        upto, leave = _merged(ts, ts[last], int(run[1]) * su + iu)
        return {"key": [run[0]], node: [run[1]], "upto": [upto], "leave": [leave]}

    level = materialize(map_runs(x, ["key", CHUNK], order, step, schema), "throttle-steps")
    first, end = level.agg(F.min(node), F.max(node)).first()
    first = first or 0
    level = level.withColumn(node, F.col(node) - F.lit(first))
    levels, spans = [], (end or 0) - first + 1
    while spans > FAN:
        levels.append(level)
        width = su * FAN ** len(levels)

        def compose(run, c, width=width):
            upto, leave = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for u, l in zip(c["upto"], c["leave"]):
                upto, leave = _merged(*_then(upto, leave, u, l, iu), first * su + int(run[1]) * width + iu)
            return {"key": [run[0]], node: [run[1]], "upto": [upto], "leave": [leave]}

        parent = level.withColumn("_up", F.floor(F.col(node) / FAN).cast("long"))
        level = materialize(map_runs(parent, ["key", "_up"], [node], compose, schema), "throttle-steps")
        spans = -(-spans // FAN)

    def enter(run, c):
        entry, free = [], int(c["entry"][0])
        for upto, leave in zip(c["upto"], c["leave"]):
            entry.append(free)
            k = int(np.searchsorted(upto, free))
            if k < len(upto):
                free = int(leave[k]) + iu
        return {"key": [run[0]] * len(entry), node: c[node], "entry": entry}

    entries = level.select("key", F.lit(0).cast("long").alias(node), F.lit(np.iinfo(np.int64).min).alias("entry")).distinct()
    for parts in [level, *reversed(levels)]:
        parts = parts.withColumn("_up", F.floor(F.col(node) / FAN).cast("long")).join(entries.withColumnRenamed(node, "_up"), ["key", "_up"])
        entries = map_runs(parts, ["key", "_up"], [node], enter, f"key string, {node} long, entry long")

    def mark(run, c):
        ts = c["ts_us"]
        jump = _jumps(ts, iu)
        kept = np.array([np.searchsorted(ts, c["entry"][0])])
        while True:  # all places that the chain reaches, twice as many jumps each time
            kept = np.concatenate([kept, jump[kept]])
            if (jump == len(ts)).all():
                break
            jump = jump[jump]
        kept = np.unique(kept[kept < len(ts)])
        return {"key": [run[0]] * len(kept), "ts_us": ts[kept], "pkt_id": c["pkt_id"][kept]}

    entries = entries.select("key", (F.col(node) + F.lit(first)).alias(CHUNK), "entry")
    return map_runs(x.join(entries, ["key", CHUNK]), ["key", CHUNK], order, mark, THROTTLE_SCHEMA)
