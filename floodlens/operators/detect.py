"""Detection: prediction guard (P17), state machine (W13), mitigation trigger
(W14), transition log (W17) and the scalar ladders P12-P16.

W13 as gaps-and-islands.  The guard forces ``pred = 0`` below the warning
rate and the attack rate is above the warning rate, so an alert row is
always hot and NORMAL <=> ``rate < warn``.  A cold row resets every
since-time; an *island* is a cold row and the hot rows that follow it.
Per island: ``warning_since`` = first hot row, ``alert_first_seen`` = first
alert row at or before the current row.  The island key is the place
(timestamp, packet id) of the last cold row.  Every step stays on the rows' ``(session, chunk)``
partitioning: inside a chunk the island values are window minima over
``(session, chunk, island)``; an island that began in an earlier chunk gets
its values from a carry over the per-chunk summaries (one row per chunk),
joined back on ``(session, chunk)``.  A long flood island is therefore
spread over its chunks and never has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodlens.config import DEFAULT, Thresholds
from floodlens.operators.sequence import CHUNK, chunk_window, prefix_carry


def _place(ts: Column, pkt: Column) -> Column:
    """A place in a session; rows of one timestamp keep their order by ``pkt_id``."""
    return F.struct(ts.cast("long").alias("c"), pkt.cast("long").alias("i"))


def _no_island() -> Column:
    return _place(F.lit(-(2 ** 63)), F.lit(-(2 ** 63)))


def prediction_guard(rate: Column, th: Thresholds = DEFAULT, model_pred: Column | None = None) -> Column:
    """Rate < warn -> 0; no model -> (rate >= attack); else the model output."""
    if model_pred is None:
        inner = F.when(rate >= F.lit(th.attack), F.lit(1)).otherwise(F.lit(0))
    else:
        inner = F.coalesce(model_pred.cast("int"), F.lit(0))
    return F.when(rate < F.lit(th.warn), F.lit(0)).otherwise(inner)


def threat_score(rate: Column, pred: Column) -> Column:
    """P12."""
    benign = F.when(rate >= 40, 25).when(rate >= 20, 12).otherwise(5)
    flood = (F.when(rate >= 350, 95).when(rate >= 250, 85).when(rate >= 150, 70)
             .when(rate >= 100, 55).otherwise(40))
    return F.when(pred == 0, benign).otherwise(flood).cast("int")


def risk_band(score: Column) -> Column:
    """1 (<=5), 2 (<=25), 3 (<=55), 4 (above)."""
    return F.when(score <= 5, 1).when(score <= 25, 2).when(score <= 55, 3).otherwise(4).cast("int")


def attack_type(proto: Column, pred: Column, mitigated: Column) -> Column:
    """P14."""
    return (F.when(proto != "ICMP", "BENIGN_TRAFFIC").when(mitigated, "ICMP_FLOOD_DROPPED")
            .when(pred == 1, "ICMP_FLOOD").otherwise("BENIGN_ICMP"))


def phase(status: Column, mitigated: Column) -> Column:
    """P15."""
    return (F.when(mitigated, "MITIGATED")
            .when(status.isin("WARNING", "ATTACK_CONFIRMED"), "ATTACK").otherwise("NORMAL"))


def _island_carry(summ: DataFrame, key: str, cand: str, out: str) -> DataFrame:
    """For every chunk, the minimum of ``cand`` over the earlier chunks of the
    island open at the chunk's start: chunks are grouped into segments that
    start at a chunk holding a cold row, ``cand`` is the chunk's value after
    its last cold row (or over the whole chunk when it has none), and the
    carry is the running minimum of the previous chunk's segment."""
    wk = Window.partitionBy(key).orderBy(CHUNK)
    x = summ.withColumn("_seg", F.sum(F.col("_mc").isNotNull().cast("int")).over(
        wk.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("_run", F.min(cand).over(Window.partitionBy(key, "_seg").orderBy(CHUNK)
                                              .rowsBetween(Window.unboundedPreceding, 0)))
    return x.select(key, CHUNK, F.lag("_run").over(wk).alias(out))


def _after_last_cold(flag: Column) -> Column:
    """Per chunk: the first ``ts_us`` of a flagged row after the chunk's last
    cold row (a struct max over (last cold so far, -ts))."""
    return F.max(F.when(flag, F.struct(F.coalesce(F.col("_lc_in"), _no_island()).alias("l"),
                                       (-F.col("ts_us")).alias("t"))))


def detection_state(df: DataFrame, th: Thresholds = DEFAULT, key: str = "session_id",
                    rate: str = "packet_rate", model_pred: str | None = None) -> DataFrame:
    """W13 per session.  Adds ``final_prediction``, ``detection_status``,
    ``warning_since_us``, ``alert_first_seen_us`` and ``_island``.

    ``df`` needs ``ts_us``, ``pkt_id``, ``_chunk`` and the rate column."""
    r = F.col(rate)
    hot = r >= F.lit(th.warn)
    pred = prediction_guard(r, th, F.col(model_pred) if model_pred else None)
    w = chunk_window([key], ["ts_us", "pkt_id"])
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = (df.withColumn("final_prediction", pred)
            .withColumn("_hot", hot)
            .withColumn("_cold", F.when(~hot, _place(F.col("ts_us"), F.col("pkt_id"))))
            .withColumn("_nx", F.lead("ts_us").over(w))
            # last cold row so far in the chunk, and the row after it (= the island's first hot row)
            .withColumn("_lc", F.max(F.when(~hot, F.struct(F.col("_cold").alias("p"), F.col("_nx").alias("n")))).over(run))
            .withColumn("_lc_in", F.col("_lc.p")))
    mc = F.coalesce(F.col("_mc"), _no_island())

    # round 1 (input only): last cold row and first hot row of the open island
    s1 = (rows.groupBy(key, CHUNK)
          .agg(F.max("_cold").alias("_mc"), F.min(F.when(F.col("_hot"), F.col("ts_us"))).alias("_fh"),
               F.max("_lc").alias("_last")))
    s1 = s1.withColumn("_cand", F.when(F.col("_mc").isNull(), F.col("_fh")).otherwise(F.col("_last.n")))
    c1 = (prefix_carry(s1, [key], {"_lc_prev": ("max", "_mc")})
          .join(_island_carry(s1, key, "_cand", "_ws_carry"), [key, CHUNK]))
    rows = (rows.join(c1, [key, CHUNK], "left")
            .withColumn("_island", F.coalesce(F.greatest("_lc_in", "_lc_prev"), _no_island())))
    # rows before the chunk's first cold row are all hot: the chunk's first row opens their part
    ws = F.when(F.col("_lc_in").isNotNull(), F.col("_lc.n")).otherwise(
        F.coalesce(F.col("_ws_carry"), F.first("ts_us").over(run)))
    rows = rows.withColumn("_ws", ws)
    alert = F.col("_hot") & ((r > F.lit(th.attack)) |
                             ((F.col("final_prediction") == 1)
                              & (F.col("ts_us") - F.col("_ws") >= F.lit(th.confirm_us))))
    rows = rows.withColumn("_alert", alert)

    # round 2: first alert row of the open island
    s2 = (rows.groupBy(key, CHUNK)
          .agg(F.max("_cold").alias("_mc"), F.min(F.when(F.col("_alert"), F.col("ts_us"))).alias("_fa"),
               _after_last_cold(F.col("_alert")).alias("_aa")))
    s2 = s2.withColumn("_cand", F.when(F.col("_mc").isNull(), F.col("_fa"))
                       .when(F.col("_aa.l") == mc, -F.col("_aa.t")))
    rows = (rows.join(_island_carry(s2, key, "_cand", "_afs_carry"), [key, CHUNK], "left")
            .withColumn("_fa_run", _after_last_cold(F.col("_alert")).over(run)))
    lc = F.coalesce(F.col("_lc_in"), _no_island())
    in_chunk = F.when(F.col("_fa_run.l") == lc, -F.col("_fa_run.t"))
    afs = F.when(F.col("_lc_in").isNotNull(), in_chunk).otherwise(F.coalesce(F.col("_afs_carry"), in_chunk))
    return (rows
            .withColumn("detection_status",
                        F.when(~F.col("_hot"), "NORMAL").when(F.col("_alert"), "ATTACK_CONFIRMED")
                        .otherwise("WARNING"))
            .withColumn("warning_since_us", F.when(F.col("_hot"), F.col("_ws")))
            .withColumn("alert_first_seen_us", F.when(F.col("_hot"), afs))
            .drop("_hot", "_ws", "_alert", "_cold", "_nx", "_lc", "_lc_in", "_lc_prev", "_ws_carry",
                  "_afs_carry", "_fa_run"))


def mitigation_trigger(df: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """W14 per row: ``trigger`` (alert row whose alert age >= delay) and
    ``countdown_s`` = int(max(0, delay - age)) on alert rows."""
    age = F.col("ts_us") - F.col("alert_first_seen_us")
    alert = F.col("detection_status") == "ATTACK_CONFIRMED"
    return (df
            .withColumn("trigger", alert & (age >= F.lit(th.delay_us)))
            .withColumn("countdown_s",
                        F.when(alert, F.floor(F.greatest(F.lit(0), F.lit(th.delay_us) - age)
                                              / F.lit(1_000_000)).cast("int"))))


def first_activation(df: DataFrame, key: str = "src_ip") -> DataFrame:
    """W14 first activation per key: earliest trigger row (``drop_us``)."""
    return (df.filter(F.col("trigger")).groupBy(key)
            .agg(F.min("ts_us").alias("drop_us")))


def transitions(df: DataFrame, key: str = "session_id", status: str = "detection_status",
                rate: str = "packet_rate") -> DataFrame:
    """Rows where the status differs from the previous row's (first row vs NORMAL)."""
    w = chunk_window([key], ["ts_us", "pkt_id"])
    rows = df.withColumn("_prev", F.lag(status).over(w))
    summ = rows.groupBy(key, CHUNK).agg(F.max_by(status, F.struct("ts_us", "pkt_id")).alias("_last"))
    carry = (summ.withColumn("_carry", F.lag("_last").over(Window.partitionBy(key).orderBy(CHUNK)))
             .select(key, CHUNK, "_carry"))
    rows = (rows.join(carry, [key, CHUNK], "left")
            .withColumn("from_status", F.coalesce("_prev", "_carry", F.lit("NORMAL")))
            .drop("_prev", "_carry"))
    return rows.filter(F.col("from_status") != F.col(status)).withColumnRenamed(status, "to_status")
