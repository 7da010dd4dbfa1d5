"""Per-session rate features: W6 trailing window, W7 gap std, W8 EWMA,
W9 tumbling flow features, W12 running session stats, P8 session id.

Event time is ``ts_us`` (bigint microseconds); ties are broken by ``pkt_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodlens.config import DEFAULT, Thresholds
from floodlens.operators.sequence import (CHUNK, CTX, add_chunk, chunk_window, ewma_in_chunks,
                                          prefix_carry, with_time_context)

DEFAULT_CHUNK_S = 10.0


def session_id(src: str = "src_ip", dst: str = "dst_ip", proto: str = "protocol",
               sport: str | None = None, dport: str | None = None) -> Column:
    """``src:sport->dst:dport:PROTO`` for TCP/UDP with both ports, else ``src->dst:PROTO``."""
    plain = F.concat(F.col(src), F.lit("->"), F.col(dst), F.lit(":"), F.col(proto))
    if sport is None or dport is None:
        return plain
    sp = F.coalesce(F.col(sport).cast("string"), F.lit(""))
    dp = F.coalesce(F.col(dport).cast("string"), F.lit(""))
    ported = F.concat(F.col(src), F.lit(":"), sp, F.lit("->"), F.col(dst), F.lit(":"), dp,
                      F.lit(":"), F.col(proto))
    return F.when(F.col(proto).isin("TCP", "UDP") & (sp != "") & (dp != ""), ported).otherwise(plain)


def session_episodes(df: DataFrame, key: str = "session_id", th: Thresholds = DEFAULT,
                     chunk_s: float = DEFAULT_CHUNK_S, out: str = "_episode", sweep_s: float | None = None) -> DataFrame:
    """Stale sessions start anew: ``out`` is the session and the start of its
    episode, which ends where the session was idle longer than
    ``session_max_age_s``.  Counters, windows, smoothing and detection state
    keyed by it restart, as they do in the stream.

    With ``sweep_s`` stale sessions go only at the multiples of that interval: a
    session that comes back before the sweep that would have taken it goes on.

    Chunks no longer than that age can only begin an episode with their first
    row, so one row a chunk decides.  Adds ``_chunk`` where it is missing."""
    age = int(round(th.session_max_age_s * 1_000_000))
    if CHUNK not in df.columns:
        df = add_chunk(df, _chunk_us(chunk_s, th))
    inner = F.floor(F.col("ts_us") / F.lit(max(1, age))).cast("long")  # chunks of the age, unless shorter ones are there
    part = F.struct(F.col(CHUNK).alias("c"), inner.alias("i")) if _chunk_us(chunk_s, th) > age else F.struct(F.col(CHUNK).alias("c"))
    rows = df.withColumn("_part", part)
    spans = rows.groupBy(key, "_part").agg(F.min("ts_us").alias("_first"), F.max("ts_us").alias("_last"))
    w = Window.partitionBy(key).orderBy("_part")
    seen = F.col("_first") if sweep_s is None else last_sweep(F.col("_first"), sweep_s)
    starts = F.when(F.coalesce(seen - F.lag("_last").over(w) > F.lit(age), F.lit(True)), F.col("_first"))
    spans = spans.withColumn("_start", starts).select(
        F.col(key).alias("_key"), F.col("_part").alias("_p"), F.last("_start", ignorenulls=True).over(w).alias("_start"))
    on = (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_p"))
    return (rows.join(spans, on, "left").withColumn(out, F.concat_ws("@", F.col(key), F.col("_start").cast("string")))
            .drop("_part", "_p", "_key", "_start"))


def last_sweep(ts_us: Column, sweep_s: float) -> Column:
    """The last sweep at or before a time, in microseconds."""
    every = F.lit(int(round(sweep_s * 1_000_000)))
    return ts_us - F.pmod(ts_us, every)


def session_spans(df: DataFrame, key: str = "session_id", th: Thresholds = DEFAULT, chunk_s: float = DEFAULT_CHUNK_S,
                  sweep_s: float | None = None) -> DataFrame:
    """ST4: one row per episode of a session (``start_us``, ``last_us``,
    ``packets``), counted chunk by chunk, so a hot session is no hot task."""
    ep = session_episodes(df, key, th, chunk_s, sweep_s=sweep_s)
    return (ep.groupBy(key, "_episode").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("last_us"),
                                            F.count(F.lit(1)).alias("packets")).drop("_episode"))


def _chunk_us(chunk_s: float, th: Thresholds) -> int:
    return max(int(round(chunk_s * 1_000_000)), th.window_us)


def trailing_features(df: DataFrame, key: str = "session_id", th: Thresholds = DEFAULT,
                      chunk_s: float = DEFAULT_CHUNK_S, size: str = "size", ddof: int = 0) -> DataFrame:
    """W6 + W7 per packet over the closed trailing window ``[ts - window, ts]``,
    as the sequential detector sees it: packets up to and including this one in
    (ts, pkt_id) order, so of equal timestamps only the earlier ones count.

    A packet enters the running sums at its time and leaves them after
    everything at time + window, so the cost is linear in the packets however
    dense a flood is, and the sums are exact integers.

    Adds ``pkt_count_1s`` (long), ``byte_count_1s`` (long), ``avg_pkt_size``,
    ``pkt_size_std`` (population, 0 when n <= 1), ``inter_arrival_std``
    (population std of gaps inside the window in seconds, 0 when n <= 2) and
    ``raw_rate`` = count / window.  Keeps the ``_chunk`` column.  With ``ddof`` = 1
    both are sample standard deviations (0 as well where there is one value).
    """
    cu = _chunk_us(chunk_s, th)
    ctx = with_time_context(df, cu, th.window_us)
    w = chunk_window([key], ["ts_us", "pkt_id"])
    sz, gap = F.col(size).cast("long"), F.col("ts_us") - F.lag("ts_us").over(w)
    # a gap counts while both of its packets are in the window
    rows = (ctx.withColumn("_sz", F.coalesce(sz, F.lit(0)))
            .withColumn("_known", sz.isNotNull().cast("long"))
            .withColumn("_gap", F.when(gap <= th.window_us, gap).otherwise(F.lit(0)))
            .withColumn("_next", F.coalesce(F.lead("_gap").over(w), F.lit(0))))

    def event(at: Column, leaves: int, sign: int, g: Column) -> Column:
        x = F.lit(sign)
        return F.struct(at.alias("t"), F.lit(leaves).alias("leaves"), x.cast("long").alias("n"), (x * F.col("_known")).alias("k"),
                        (x * F.col("_sz")).alias("b"), (x * F.col("_sz") * F.col("_sz")).alias("b2"),
                        (x * g).alias("g"), (x * g * g).alias("g2"))

    both = F.array(event(F.col("ts_us"), 0, 1, F.col("_gap")),
                   event(F.col("ts_us") + F.lit(th.window_us), 1, -1, F.col("_next")))
    ev = rows.withColumn("_ev", F.explode(both)).filter(
        (F.col("_ev.leaves") == 0) | (F.col("_ev.t") < (F.col(CHUNK) + 1) * F.lit(cu)))
    run = (Window.partitionBy(key, CHUNK).orderBy("_ev.t", "_ev.leaves", "pkt_id")
           .rowsBetween(Window.unboundedPreceding, 0))
    sums = {f"_{c}": F.sum(f"_ev.{c}").over(run) for c in ("n", "k", "b", "b2", "g", "g2")}
    t = ev.withColumns(sums).filter((F.col("_ev.leaves") == 0) & ~F.col(CTX))
    n, known, gaps = F.col("_n"), F.col("_k").cast("double"), (F.col("_n") - 1).cast("double")
    mean, mean_g = F.col("_b") / known, F.col("_g") / gaps
    var = F.greatest(F.col("_b2") / known - mean * mean, F.lit(0.0))
    var_g = F.greatest(F.col("_g2") / gaps - mean_g * mean_g, F.lit(0.0))
    if ddof:
        var, var_g = (F.coalesce(F.try_divide(v * m, F.greatest(m - ddof, F.lit(0.0))), F.lit(0.0)) for v, m in ((var, known), (var_g, gaps)))
    return (t
            .withColumn("pkt_count_1s", n)
            .withColumn("byte_count_1s", F.when(F.col("_k") > 0, F.col("_b")))
            .withColumn("avg_pkt_size", F.col("byte_count_1s").cast("double") / n)
            .withColumn("pkt_size_std", F.when(n > 1, F.when(F.col("_k") > 0, F.sqrt(var))).otherwise(F.lit(0.0)))
            .withColumn("inter_arrival_std",
                        F.when(n > 2, F.sqrt(var_g) / F.lit(1_000_000.0)).otherwise(F.lit(0.0)))
            .withColumn("raw_rate", n.cast("double") / F.lit(float(th.window_s)))
            .drop(CTX, "_sz", "_known", "_gap", "_next", "_ev", *sums))


def ewma_rate(df: DataFrame, key: str = "session_id", th: Thresholds = DEFAULT,
              raw: str = "raw_rate", out: str = "packet_rate", chunk_s: float = DEFAULT_CHUNK_S,
              order: tuple = ("ts_us", "pkt_id")) -> DataFrame:
    """W8 per-packet EWMA ``s = alpha*raw + (1-alpha)*prev`` (prev starts at 0)."""
    if CHUNK not in df.columns:
        df = add_chunk(df, _chunk_us(chunk_s, th))
    return ewma_in_chunks(df, [key], list(order), raw, out, th.alpha)


def packet_rates(df: DataFrame, key: str = "session_id", th: Thresholds = DEFAULT,
                 chunk_s: float = DEFAULT_CHUNK_S, stage: bool = True) -> DataFrame:
    """W6 + W7 + W8: per-packet window features and the smoothed ``packet_rate``.

    The EWMA's cross-chunk carry joins a per-chunk summary back to the rows;
    with ``stage`` the window features are written once first, so the summary
    branch re-scans that table instead of repeating the shuffle and windows."""
    t = trailing_features(df, key, th, chunk_s)
    if stage:
        from floodlens.session import materialize
        t = materialize(t, "trailing")
    return ewma_rate(t, key, th, chunk_s=chunk_s)


def running_session_stats(df: DataFrame, key: str = "session_id", th: Thresholds = DEFAULT,
                          chunk_s: float = DEFAULT_CHUNK_S) -> DataFrame:
    """``start_us`` (first packet), ``last_seen_us`` (this packet) and the
    running ``packet_count`` per session, via a per-chunk count carry."""
    if CHUNK not in df.columns:
        df = add_chunk(df, _chunk_us(chunk_s, th))
    w = chunk_window([key], ["ts_us", "pkt_id"])
    rows = df.withColumn("_k", F.row_number().over(w))
    summ = rows.groupBy(key, CHUNK).agg(F.count(F.lit(1)).alias("_n"), F.min("ts_us").alias("_t0"))
    carry = prefix_carry(summ, [key], {"_before": ("sum", "_n"), "_start": ("min", "_t0")})
    first = summ.groupBy(key).agg(F.min("_t0").alias("start_us"))
    return (rows.join(carry, [key, CHUNK], "left").join(first, [key], "left")
            .withColumn("packet_count", (F.coalesce(F.col("_before"), F.lit(0)) + F.col("_k")).cast("long"))
            .withColumn("last_seen_us", F.col("ts_us"))
            .drop("_k", "_before", "_start"))


def tumbling_flow_features(df: DataFrame, th: Thresholds = DEFAULT, width_s: float = 1.0,
                           keys: tuple = ("src_ip", "dst_ip"), chunk_s: float = DEFAULT_CHUNK_S,
                           victim: str | None = None, ddof: int = 1) -> DataFrame:
    """One row per (flow, aligned tumbling window) holding packets.

    count, bytes, mean size, *sample* std of size (0 when n < 2), *sample*
    std of gaps between the window's packets in seconds (0 when n < 3; with
    ``ddof`` = 0 both are the population's), and
    the EWMA of count/width advanced once per non-empty window.  Output
    ``window_end_us`` is the window end.  Windows are aligned to multiples
    of the width (nothing is lost between sweeps)."""
    wu = int(round(width_s * 1_000_000))
    keys = list(keys)
    win = F.floor(F.col("ts_us") / F.lit(wu)).cast("long")
    x = df.withColumn("_win", win)
    w = Window.partitionBy(*keys, "_win").orderBy("ts_us", "pkt_id")
    x = x.withColumn("_gap", (F.col("ts_us") - F.lag("ts_us").over(w)).cast("double") / F.lit(1_000_000.0))
    std = F.stddev_samp if ddof else F.stddev_pop
    agg = (x.groupBy(*keys, "_win")
           .agg(F.count(F.lit(1)).alias("packet_count_1s"),
                F.sum(F.col("size").cast("long")).alias("byte_count_1s"),
                F.avg(F.col("size").cast("double")).alias("avg_pkt_size"),
                std(F.col("size").cast("double")).alias("_ss"),
                std("_gap").alias("_gs")))
    n = F.col("packet_count_1s")
    out = (agg
           .withColumn("pkt_size_std", F.when(n >= 2, F.coalesce("_ss", F.lit(0.0))).otherwise(0.0))
           .withColumn("inter_arrival_std", F.when(n >= 3, F.coalesce("_gs", F.lit(0.0))).otherwise(0.0))
           .withColumn("window_end_us", (F.col("_win") + 1) * F.lit(wu))
           .withColumn("raw_rate", n.cast("double") / F.lit(float(width_s)))
           .withColumn("pkt_id", F.col("_win"))
           .withColumn("ts_us", F.col("window_end_us"))
           .drop("_ss", "_gs"))
    flow = "_flow"
    out = out.withColumn(flow, F.concat_ws("|", *[F.col(k) for k in keys]))
    out = ewma_rate(out, key=flow, th=th, raw="raw_rate", out="packet_rate_ewma", chunk_s=chunk_s)
    if victim is not None:
        out = out.withColumn("is_to_victim", (F.col("dst_ip") == F.lit(victim)).cast("int"))
    return out.drop(flow, "_win", "pkt_id", "ts_us", CHUNK)
