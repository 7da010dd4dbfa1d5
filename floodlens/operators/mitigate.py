"""Mitigation: drop events, intervals, active-mitigation flag, post-drop
exclusion, pre/post counts (A6, A9, J4-J6, W15, ST3 batch form)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodlens.config import DEFAULT, SEGMENT_PATTERN, Dims, Thresholds
from floodlens.operators.sequence import chain_in_rounds, first_at_or_after
from floodlens.session import materialize


# Notes of the mitigation log
DROP_NOTE = "DROP rule installed \u2014 ICMP + ARP from %s blocked at switch level"
RELEASE_NOTE = "DROP rule expired \u2014 network returned to NORMAL phase"


def first_drops(mit: DataFrame, key: str = "src_ip") -> DataFrame:
    """First DROP_ICMP per source from a mitigation log (``ts_us``, ``action``)."""
    return (mit.filter(F.col("action").contains("DROP_ICMP")).groupBy(key)
            .agg(F.min("ts_us").alias("drop_us")))


def mitigation_log(drops: DataFrame, th: Thresholds = DEFAULT, dims: Dims = Dims(),
                   with_release: bool = True) -> DataFrame:
    """MITIGATION_EVENT rows for activations (``src_ip``, ``drop_us``): a
    DROP_ICMP row at activation and a RELEASE_DROP row at expiry."""
    from floodlens.operators.dims import with_switch_name, with_watchlist
    d = with_watchlist(drops, "src_ip", dims)
    d = d.withColumn("dpid", F.col("segment_dpid"))
    d = with_switch_name(d, "dpid", "dpid_name", dims)
    common = [F.col("src_ip"), F.col("attacker_host").alias("attacker_hostname"), F.col("dpid"),
              F.col("dpid_name"), F.col("segment_description"),
              F.lit(0).alias("idle_timeout"), F.lit(int(th.hard_timeout_s)).alias("hard_timeout")]
    drop = d.select(F.col("drop_us").alias("ts_us"), *common, F.lit("DROP_ICMP").alias("action"),
                    F.lit("ATTACK_CONFIRMED_DELAY_PASSED").alias("reason"), F.format_string(DROP_NOTE, "src_ip").alias("note"))
    if not with_release:
        return drop
    rel = d.select((F.col("drop_us") + F.lit(th.hard_timeout_us)).alias("ts_us"), *common,
                   F.lit("RELEASE_DROP").alias("action"), F.lit("HARD_TIMEOUT_EXPIRED").alias("reason"),
                   F.lit(RELEASE_NOTE).alias("note"))
    return drop.unionByName(rel)


def intervals(drops: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """Activation -> active interval [start, start + hard timeout)."""
    return drops.select("src_ip", F.col("drop_us").alias("start_us"),
                        (F.col("drop_us") + F.lit(th.hard_timeout_us)).alias("end_us"))


def merge_intervals(iv: DataFrame, bucket_s: float = 3600.0) -> DataFrame:
    """Merge overlapping (or touching) intervals into disjoint ones
    (gaps-and-islands over start order) without a one-partition window.

    Intervals are bucketed by start time.  Inside a bucket, the running max of
    the earlier ends is combined with the max end of all earlier buckets (a
    window over one row per bucket); an interval starting after it opens an
    island, and each interval's island is the latest opening at or before it,
    carried across buckets the same way."""
    bu = int(round(bucket_s * 1_000_000))
    pre = Window.unboundedPreceding
    x = iv.select("start_us", "end_us").withColumn("_b", F.floor(F.col("start_us") / F.lit(bu)).cast("long"))
    w = Window.partitionBy("_b").orderBy("start_us", "end_us")
    wb = Window.orderBy("_b")  # one row per start bucket: bounded by the span
    x = x.withColumn("_pm", F.max("end_us").over(w.rowsBetween(pre, -1)))
    ends = x.groupBy("_b").agg(F.max("end_us").alias("_bm"))
    ends = ends.select("_b", F.max("_bm").over(wb.rowsBetween(pre, -1)).alias("_cm"))
    x = (x.join(ends, "_b", "left")
         .withColumn("_prev", F.greatest("_pm", "_cm"))
         .withColumn("_open", F.when(F.col("_prev").isNull() | (F.col("start_us") > F.col("_prev")),
                                     F.col("start_us")))
         .withColumn("_isl_in", F.max("_open").over(w.rowsBetween(pre, 0))))
    opens = x.groupBy("_b").agg(F.max("_open").alias("_bo"))
    opens = opens.select("_b", F.max("_bo").over(wb.rowsBetween(pre, -1)).alias("_co"))
    x = x.join(opens, "_b", "left").withColumn("_isl", F.coalesce("_isl_in", "_co"))
    return x.groupBy("_isl").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("_isl")


def with_mitigation_active(df: DataFrame, merged: DataFrame, bucket_s: float = 300.0,
                           out: str = "any_mitigation") -> DataFrame:
    """Is any mitigation active at the row's time (start <= ts < end)?

    Disjoint intervals are exploded into the time buckets they cover and
    equi-joined on the bucket (at most two intervals per bucket), so the
    join needs no broadcast of an unbounded table; AQE broadcasts the
    interval side when it is small."""
    bu = int(round(bucket_s * 1_000_000))
    iv = (merged.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_us") / bu).cast("long"),
                                                        F.floor((F.col("end_us") - 1) / bu).cast("long"))))
          .select("_b", F.col("start_us").alias("_s"), F.col("end_us").alias("_e")))
    x = df.withColumn("_b", F.floor(F.col("ts_us") / bu).cast("long"))
    iv = iv.withColumnRenamed("_b", "_ib")
    cond = (x["_b"] == iv["_ib"]) & (x["ts_us"] >= iv["_s"]) & (x["ts_us"] < iv["_e"])
    # disjoint intervals: at most one match per row
    return (x.join(iv, cond, "left").withColumn(out, F.col("_s").isNotNull())
            .drop("_b", "_ib", "_s", "_e"))


def with_own_mitigation(df: DataFrame, iv: DataFrame, out: str = "mitigated") -> DataFrame:
    """Is the row's own source under an active drop (start <= ts < end)?"""
    i = iv.select(F.col("src_ip").alias("_src"), F.col("start_us").alias("_s"), F.col("end_us").alias("_e"))
    cond = (F.col("src_ip") == F.col("_src")) & (F.col("ts_us") >= F.col("_s")) & (F.col("ts_us") < F.col("_e"))
    # a source's activation intervals never overlap: at most one match per row
    return (df.join(i, cond, "left").withColumn(out, F.col("_s").isNotNull())
            .drop("_src", "_s", "_e"))


def exclude_post_drop(pk: DataFrame, drops: DataFrame, victim: str) -> DataFrame:
    """Remove ICMP src->victim packets at or after any drop time of that
    source (equi + range anti join; multiple drops OR-ed)."""
    d = drops.select(F.col("src_ip").alias("_src"), F.col("drop_us").alias("_d"))
    cond = ((pk["src_ip"] == d["_src"]) & (pk["ts_us"] >= d["_d"])
            & (pk["protocol"] == "ICMP") & (pk["dst_ip"] == F.lit(victim)))
    return pk.join(d, cond, "left_anti")


def pre_post_counts(pk: DataFrame, drops: DataFrame, key: str = "src_ip") -> DataFrame:
    """A9 after J4: per source packets before / at-or-after the first drop; no drop -> all pre."""
    before = F.col("drop_us").isNull() | (F.col("ts_us") < F.col("drop_us"))
    return (pk.join(drops, key, "left").groupBy(key)  # at most one drop a source
            .agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count_if(before).alias("pre_drop"),
                 F.count_if(~before).alias("post_drop"), F.min("drop_us").alias("drop_us")))


# ---------------------------------------------------------------- ST3 batch
def mitigation_cycle(rows: DataFrame, th: Thresholds = DEFAULT, slice_s: float = 3600.0) -> DataFrame:
    """ST3 in batch: the full activation / suppression / expiry cycle per source.

    Input: detector rows (``src_ip``, ``ts_us``, ``pkt_id``, ``packet_rate``,
    ``final_prediction``, ``_island``) of one session per source.  After an
    activation the source's packets are suppressed for the hard timeout, then
    the detection state restarts from NORMAL (rates keep their history).

    A drop decides nothing but when the next detection begins: it begins afresh
    with the first hot row after the timeout.  So every hot row has *one* next
    activation, the one of a detection that begins with it, and every activation
    has one successor.  Both are forward searches (``first_at_or_after``) over
    all hot rows side by side, and the chain of each source's first activation is
    followed by pointer doubling (``chain_in_rounds``).  ``slice_s`` is the width of
    the chunks in which a source's rows are searched.  Sources that never trigger
    and cold rows take no part: a cold row only ends an island (W13)."""
    cu = max(1, int(round(slice_s * 1_000_000)))
    least = F.lit(-(2 ** 63))  # an id before all others
    place = lambda t, i=least: F.struct(t.cast("long").alias("c"), i.cast("long").alias("i"))
    x = rows.filter(F.col("packet_rate") >= th.warn)
    if "trigger" in rows.columns:
        x = x.join(rows.filter(F.col("trigger")).select("src_ip").distinct(), "src_ip", "left_semi")
    hot = materialize(x.select(
        "src_ip", place(F.col("ts_us"), F.col("pkt_id")).alias("_at"), F.col("_island").cast("string").alias("_island"),
        (F.col("packet_rate") > th.attack).alias("_attack"), (F.coalesce("final_prediction", F.lit(0)) == 1).alias("_pred")), "cycle-hot")
    mark = F.struct("_at", "_island").alias("_mark")
    attacks = hot.filter("_attack").select("src_ip", "_at", mark)
    confirmed = hot.filter("_pred").select("src_ip", "_at", mark)

    def search(df: DataFrame, start, marks: DataFrame, out: str) -> DataFrame:
        """The first mark from ``start`` on that lies in the row's own island."""
        asked = df.withColumn("_own", F.col("_at")).withColumn("_at", start)
        got = first_at_or_after(asked, marks, "src_ip", cu, "_hit")
        return (got.withColumn(out, F.when(F.col("_hit._island") == F.col("_island"), F.col("_hit._at")))
                .withColumn("_at", F.col("_own")).drop("_own", "_hit"))

    # a detection that begins with this row: an alert is an attack rate, or a confirmed prediction
    confirm = F.greatest("_at", place(F.col("_at.c") + th.confirm_us))
    d = hot.select("src_ip", "_at", "_island")
    d = search(d, F.col("_at"), attacks, "_a")
    d = search(d, confirm, confirmed, "_p").withColumn("_alert", F.least("_a", "_p")).drop("_a", "_p")
    # it activates with the first alert from the delay after its first alert on
    ripe = F.greatest("_alert", place(F.col("_alert.c") + th.delay_us))
    d = d.filter(F.col("_alert").isNotNull())
    d = search(d, ripe, attacks, "_a")
    d = search(d, F.greatest(ripe, confirm), confirmed, "_p").withColumn("_act", F.least("_a", "_p"))
    own = materialize(d.filter(F.col("_act").isNotNull()).select("src_ip", "_at", "_island", "_act"), "cycle-own")
    # where the island ends before that, the next islands decide, as they are
    heads = hot.groupBy("src_ip", "_island").agg(F.min("_at").alias("_at"))
    open_heads = own.join(heads, ["src_ip", "_island", "_at"], "left_semi").select("src_ip", "_at", F.col("_act").alias("_mark"))
    begin = hot.select("src_ip", "_at", "_island").join(own, ["src_ip", "_at", "_island"], "left")
    begin = first_at_or_after(begin, open_heads, "src_ip", cu, "_next").select("src_ip", "_at", F.coalesce("_act", "_next").alias("_act"))
    begin = materialize(begin.filter(F.col("_act").isNotNull()), "cycle-begin")
    starts = begin.groupBy("src_ip").agg(F.min_by("_act", "_at").alias("_act"))
    # an activation's successor is that of the first hot row after its timeout that has any
    acts = begin.select("src_ip", "_act").distinct()
    after = F.greatest(place(F.col("_act.c") + th.hard_timeout_us), place(F.col("_act.c"), F.col("_act.i") + 1))
    asked = acts.withColumn("_at", after)
    edges = first_at_or_after(asked, begin.select("src_ip", "_at", F.col("_act").alias("_mark")), "src_ip", cu, "_to")
    chain = chain_in_rounds(edges, starts, "src_ip", "_act", "_to", "cycle")
    return chain.select("src_ip", F.col("_act.c").alias("drop_us"), (F.col("_act.c") + th.hard_timeout_us).alias("release_us"),
                        F.col("place").cast("int").alias("activation"))
