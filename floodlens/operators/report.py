"""Report aggregates (A1-A24), top-k (T1-T3), set operations (U1, U2) and
scenario alignment (J8-J10).  Every report table is a DataFrame; nothing is
collected to the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodlens.operators.sequence import exact_percentiles
from floodlens.functions.numeric import q


def attacker_stats(det: DataFrame, key: str = "src_ip", rate: str = "packet_rate",
                   status: str = "detection_status", watch: list[str] | None = None) -> DataFrame:
    """A5 in one conditional aggregation.  With a watchlist, a row for each of
    its sources, null where a source has no rows."""
    if watch is not None:
        spine = det.sparkSession.createDataFrame([(w,) for w in watch], f"{key} string")
        return spine.join(attacker_stats(det, key, rate, status), key, "left")
    return det.groupBy(key).agg(
        F.min("ts_us").alias("first_seen_us"), F.max("ts_us").alias("last_seen_us"),
        F.min(F.when(F.col(status) == "WARNING", F.col("ts_us"))).alias("first_warn_us"),
        F.min(F.when(F.col(status) == "ATTACK_CONFIRMED", F.col("ts_us"))).alias("first_conf_us"),
        q(F.max(rate)).alias("max_rate"), q(F.avg(rate)).alias("avg_rate"),
        F.count(F.lit(1)).alias("total_pkts"))


def latencies(det: DataFrame, key: str = "src_ip", drops: DataFrame | None = None) -> DataFrame:
    """First WARNING -> first CONFIRMED, first CONFIRMED -> drop (null when missing).
    Drops come from ``drops`` (key, drop_us) or from the W14 trigger rows."""
    st = det.groupBy(key).agg(
        F.min(F.when(F.col("detection_status") == "WARNING", F.col("ts_us"))).alias("_fw"),
        F.min(F.when(F.col("detection_status") == "ATTACK_CONFIRMED", F.col("ts_us"))).alias("_fc"),
        F.min(F.when(F.col("trigger"), F.col("ts_us"))).alias("_dr"))
    if drops is not None:
        st = st.drop("_dr").join(drops.withColumnRenamed("drop_us", "_dr"), key, "left")
    return st.select(key, (F.col("_fc") - F.col("_fw")).alias("detect_latency_us"),
                     (F.col("_dr") - F.col("_fc")).alias("mitigation_latency_us"))


def excluded_summary(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Raw, clean, excluded packets and percent (0 when raw is empty)."""
    r = raw.agg(F.count(F.lit(1)).alias("raw_packets"))
    c = clean.agg(F.count(F.lit(1)).alias("clean_packets"))
    return (r.crossJoin(c)  # two one-row aggregates
            .withColumn("excluded", F.col("raw_packets") - F.col("clean_packets"))
            .withColumn("excluded_pct", F.when(F.col("raw_packets") == 0, F.lit(0.0))
                        .otherwise(F.col("excluded") * 100.0 / F.col("raw_packets"))))


def raw_clean_diff(pk: DataFrame, drops: DataFrame, victim: str, key: str = "protocol") -> DataFrame:
    """J9 in one pass: flag the rows J5 would exclude and count both sides per key."""
    # a row after any drop is after the first one: at most one match a row
    d = drops.groupBy(F.col("src_ip").alias("_src")).agg(F.min("drop_us").alias("_d"))
    cond = ((pk["src_ip"] == d["_src"]) & (pk["ts_us"] >= d["_d"])
            & (pk["protocol"] == "ICMP") & (pk["dst_ip"] == F.lit(victim)))
    flagged = pk.join(d, cond, "left").withColumn("_x", F.col("_d").isNotNull())
    return flagged.groupBy(key).agg(F.count(F.lit(1)).alias("raw_n"),
                                    F.count_if(~F.col("_x")).alias("clean_n"),
                                    F.count_if(F.col("_x")).alias("diff"))


# ---------------------------------------------------------------- scenarios
def scenario_split(df: DataFrame, ts: str = "ts_us", names=("baseline", "attack")) -> DataFrame:
    """Two scenarios from one log: rows below / at-or-above the time midpoint.
    The midpoint is a one-row aggregate (broadcast)."""
    mid = df.agg(F.expr(f"(min({ts}) + max({ts})) DIV 2").alias("_mid"))
    return (df.join(F.broadcast(mid), how="cross")
            .withColumn("scenario", F.when(F.col(ts) < F.col("_mid"), names[0]).otherwise(names[1]))
            .drop("_mid"))


def scenario_summary(ev: DataFrame, by: str = "scenario", rate: str = "packet_rate") -> DataFrame:
    """A1: rows, duration s, distinct src / dst ('' counts as a value), mean and max rate."""
    return ev.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"),
        q((F.max("ts_us") - F.min("ts_us")) / F.lit(1_000_000.0)).alias("duration_s"),
        F.countDistinct("src_ip").alias("unique_src"), F.countDistinct("dst_ip").alias("unique_dst"),
        q(F.avg(rate)).alias("mean_rate"), q(F.max(rate)).alias("max_rate"))


def share(df: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """A2: counts per key and percent of the total (of each ``by`` group)."""
    by = by or []
    c = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("count"))
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_t"))
    # without groups the total is one row; with them, a row a group, which Spark may broadcast when small
    j = c.join(total.select(*[F.col(b).alias(f"_{b}") for b in by], "_t"),
               reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by])) if by else c.crossJoin(F.broadcast(total))
    return j.select(*by, key, "count", q(F.col("count") * 100.0 / F.col("_t")).alias("pct"))


def state_distribution(ev: DataFrame, states=("NORMAL", "WARNING", "ATTACK_CONFIRMED", "DROP_ACTIVE"),
                       status: str = "detection_status", present_only: bool = False) -> DataFrame:
    """A3 (fixed order, zero fill, percent of all rows) / A4 (present states,
    percent of the present total)."""
    spark = ev.sparkSession
    enum = spark.createDataFrame([(s, i) for i, s in enumerate(states)], "state string, ord int")
    c = ev.groupBy(F.col(status).alias("state")).agg(F.count(F.lit(1)).alias("count"))
    if present_only:
        j = F.broadcast(enum).join(c, "state", "inner")
    else:
        j = F.broadcast(enum).join(c, "state", "left").fillna(0, ["count"])
    tot = j.agg(F.sum("count").alias("_t")) if present_only else ev.agg(F.count(F.lit(1)).alias("_t"))
    return (j.crossJoin(F.broadcast(tot))
            .withColumn("pct", F.when(F.col("_t") == 0, 0.0).otherwise(q(F.col("count") * 100.0 / F.col("_t"))))
            .drop("_t"))


def packet_summary(pk: DataFrame, size: str = "size") -> DataFrame:
    """A10: packets, bytes, duration, pps (0 when duration is 0), mean and
    median size, distinct src / dst."""
    dur = (F.max("ts_us") - F.min("ts_us")) / F.lit(1_000_000.0)
    median = exact_percentiles(pk.withColumn("_all", F.lit(0)), size, ["_all"], [0.5]).select(F.col("_p")[0].alias("_med"))
    a = pk.agg(F.count(F.lit(1)).alias("packets"), F.sum(F.col(size).cast("long")).alias("bytes"),
               dur.alias("_dur"), F.avg(size).alias("_mean"),
               F.countDistinct("src").alias("unique_src"), F.countDistinct("dst").alias("unique_dst"))
    a = a.join(median, F.lit(True), "left")  # two one-row tables
    return a.select("packets", "bytes", q("_dur").alias("duration_s"),
                    F.when(F.col("_dur") > 0, q(F.col("packets") / F.col("_dur"))).otherwise(0.0).alias("pps"),
                    q("_mean").alias("mean_size"), q("_med").alias("median_size"), "unique_src", "unique_dst")


def five_numbers(df: DataFrame, value: str, by: str) -> DataFrame:
    """Min, p25, median, p75, max (linear interpolation, exact)."""
    a = exact_percentiles(df, value, [by], [0.0, 0.25, 0.5, 0.75, 1.0])
    names = ["min", "p25", "p50", "p75", "max"]
    return a.select(by, *[q(F.col("_p")[i]).alias(n) for i, n in enumerate(names)])


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over [min, max], the max falls in the last bin;
    empty bins are kept (bin spine) with count 0."""
    mm = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    spine = mm.select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "_lo", "_hi")
    b = (df.crossJoin(F.broadcast(mm))
         # width_bucket(x, lo, hi, n) written out: the max falls in bin n + 1, so cap at n
         .withColumn("bin", F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(
             F.least(F.floor(F.lit(bins) * (F.col(value).cast("double") - F.col("_lo"))
                             / (F.col("_hi") - F.col("_lo"))) + 1, F.lit(bins)).cast("int")))
         .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return (spine.join(b, "bin", "left").fillna(0, ["count"])
            .select("bin", q(F.col("_lo") + (F.col("bin") - 1) * width).alias("lo"),
                    q(F.col("_lo") + F.col("bin") * width).alias("hi"), "count"))


def value_markers(df: DataFrame, value: str) -> DataFrame:
    """The mean and median that mark the histogram."""
    median = exact_percentiles(df.withColumn("_all", F.lit(0)), value, ["_all"], [0.5]).select(F.col("_p")[0].alias("_med"))
    mean = df.agg(F.avg(value).alias("_mean"))
    return mean.join(median, F.lit(True), "left").select(q("_mean").alias("mean"), q("_med").alias("median"))


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (clipped to the data) and outlier count per group."""
    qs = exact_percentiles(df, value, [by], [0.25, 0.5, 0.75], out="_q")
    qs = qs.select(by, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    qs = qs.withColumn("_lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
           .withColumn("_hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    v = F.col(value).cast("double")
    inside = (v >= F.col("_lo")) & (v <= F.col("_hi"))
    j = df.join(qs, by)  # one row per group: AQE broadcasts it when small
    a = j.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_lo"), F.max(F.when(inside, v)).alias("whisker_hi"),
        F.count_if(~inside).alias("outliers"))
    return a.select(by, q("q1").alias("q1"), q("median").alias("median"), q("q3").alias("q3"),
                    q("whisker_lo").alias("whisker_lo"), q("whisker_hi").alias("whisker_hi"), "outliers")


def pct_change(new, base):
    """Percent change, 0 when the base is 0."""
    return F.when(base == 0, F.lit(0.0)).otherwise(q((new - base) * 100.0 / base))


def ratio(new, base):
    return F.when(base == 0, F.lit(0.0)).otherwise(q(new / base))


def protocols_string(df: DataFrame, proto: str = "protocol", by: list[str] | None = None) -> DataFrame:
    """Distinct protocols by descending count (ties by name) as one string."""
    by = by or []
    c = df.groupBy(*by, proto).agg(F.count(F.lit(1)).alias("_n"))
    s = c.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("k"), F.col(proto).alias("p"))))
                           .alias("_l"))
    return s.select(*by, F.array_join(F.transform("_l", lambda x: x["p"]), ", ").alias("protocols"))


def top_n(df: DataFrame, key: str, n: int, role_dims=None, drop_empties: bool = False) -> DataFrame:
    """Top-N keys by rows (ties by key ascending) with percent of all rows.
    With ``drop_empties`` rows whose key is missing or empty don't count (Q8)."""
    if drop_empties:
        df = df.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    c = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    tot = df.agg(F.count(F.lit(1)).alias("_t"))
    top = c.orderBy(F.desc("count"), F.asc(key)).limit(n)
    return (top.crossJoin(F.broadcast(tot)).withColumn("pct", q(F.col("count") * 100.0 / F.col("_t")))
            .drop("_t"))


def align_counts(a: DataFrame, b: DataFrame, key: str, a_name: str, b_name: str) -> DataFrame:
    """Full outer join of two per-key count tables, missing -> 0."""
    ca = a.groupBy(key).agg(F.count(F.lit(1)).alias(a_name))
    cb = b.groupBy(key).agg(F.count(F.lit(1)).alias(b_name))
    return ca.join(cb, key, "full_outer").fillna(0, [a_name, b_name])


def protocol_note(proto, base, new):
    """ICMP more than doubled -> spike; present in both -> normal mix."""
    return (F.when((proto == "ICMP") & (new > 2 * base), "spike")
            .when((base > 0) & (new > 0), "normal mix").otherwise("one-sided"))


def claim_checks(ev: DataFrame, drops: DataFrame, clean: DataFrame, dims) -> DataFrame:
    """Each claim of the study as a row (claim, evidence, pass), computed
    from the data rather than asserted."""
    watched = F.col("src_ip").isin(dims.watch_ips)
    to_v = (F.col("protocol_name") == "ICMP") & (F.col("dst_ip") == F.lit(dims.victim))
    m1 = ev.agg(F.count_if(~watched & (F.col("detection_status") != "NORMAL")).alias("false_alarms"),
                F.count_if(F.col("detection_status") == "ATTACK_CONFIRMED").alias("confirmed_rows"),
                F.count_if(to_v & ~watched & (F.col("phase") == "MITIGATED")).alias("baseline_during_mitigation"))
    m2 = drops.agg(F.count(F.lit(1)).alias("drops"))
    after = (clean.join(drops, "src_ip")
             .filter((F.col("protocol") == "ICMP") & (F.col("dst_ip") == F.lit(dims.victim))
                     & (F.col("ts_us") >= F.col("drop_us")))
             .agg(F.count(F.lit(1)).alias("attacker_rows_after_drop")))
    fc = ev.groupBy("src_ip").agg(F.min(F.when(F.col("detection_status") == "ATTACK_CONFIRMED",
                                                  F.col("ts_us"))).alias("_fc"))
    bad = (fc.join(drops, "src_ip").filter(F.col("_fc").isNull() | (F.col("drop_us") < F.col("_fc")))
           .agg(F.count(F.lit(1)).alias("inconsistent_timings")))
    m = m1.crossJoin(m2).crossJoin(after).crossJoin(bad)  # one-row aggregates
    return m.select(F.expr(
        "stack(6, 'no_false_positive', false_alarms, false_alarms = 0, "
        "'detected', confirmed_rows, confirmed_rows > 0, 'mitigated', drops, drops > 0, "
        "'effective', attacker_rows_after_drop, attacker_rows_after_drop = 0, "
        "'selective', baseline_during_mitigation, baseline_during_mitigation > 0, "
        "'timing_consistent', inconsistent_timings, inconsistent_timings = 0) AS (claim, evidence, pass)"))
