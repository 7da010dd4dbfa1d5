"""The detector pipeline as one plan, in Spark and as the DuckDB twin.

Spark: packet view -> F1 slice -> P8 session -> W6/W7 trailing window ->
W8 EWMA -> P17 guard -> W13 islands -> W14 trigger.  The SQL twin states
the same semantics with plain per-session windows (no chunking), which is
what the chunked Spark plan must reproduce.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.config import Dims, Thresholds
from floodlens.functions.numeric import q, q_sql
from floodlens.operators.detect import detection_state, mitigation_trigger
from floodlens.operators.rates import packet_rates, session_episodes, session_id
from floodlens.operators.sequence import CHUNK
from floodlens.session import materialize
from floodlens.sources.adapter import adapter_sql


def _lit_list(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


# ---------------------------------------------------------------- Spark side
def flows(pk: DataFrame) -> DataFrame:
    """Packets that open a session in the controller (ICMP/TCP/UDP) with P8 ids."""
    return pk.filter(F.col("protocol").isin("ICMP", "TCP", "UDP")).withColumn("session_id", session_id())


def attack_slice(pk: DataFrame, dims: Dims) -> DataFrame:
    """ICMP to the victim from a watchlisted source (every source when no watchlist)."""
    s = pk.filter((F.col("protocol") == "ICMP") & (F.col("dst_ip") == F.lit(dims.victim)))
    if dims.watchlist:
        s = s.filter(F.col("src_ip").isin(dims.watch_ips))
    return s


def baseline_slice(pk: DataFrame, dims: Dims) -> DataFrame:
    """ICMP to the victim from sources not on the watchlist."""
    s = pk.filter((F.col("protocol") == "ICMP") & (F.col("dst_ip") == F.lit(dims.victim)))
    return s.filter(~F.col("src_ip").isin(dims.watch_ips)) if dims.watchlist else s.filter(F.lit(False))


def with_model_features(rates: DataFrame, dims: Dims) -> DataFrame:
    """The classifier's features of rated packets, by their trained names."""
    return rates.withColumns({"is_to_victim": (F.col("dst_ip") == F.lit(dims.victim)).cast("int"), "packet_rate_ewma": F.col("packet_rate"),
                              "packet_count_1s": F.col("pkt_count_1s")})


def detector(pk: DataFrame, th: Thresholds, dims: Dims, chunk_s: float, stage: bool = True, model=None) -> DataFrame:
    """Rates, states and triggers of the attack slice.  ``stage`` writes the
    per-packet rates and the detector rows as tables (lineage cut).  ``model`` is a
    fitted classifier whose predictions the guard takes (P17), or None: the
    attack rate decides."""
    s = attack_slice(pk, dims).withColumn("session_id", session_id())
    s = session_episodes(s, "session_id", th, chunk_s).drop(CHUNK)
    r = packet_rates(s, "_episode", th, chunk_s)
    if stage:
        r = materialize(r, "rates")
    predicted = None
    if model is not None:
        from floodlens.operators.learn import score
        added = ["is_to_victim", "packet_rate_ewma", "packet_count_1s", "margin", "prediction"]
        scored = score(model, with_model_features(r, dims)).withColumn("_predicted", F.col("prediction")).drop(*added)
        # scored once: the state machine reads its rows several times
        r, predicted = materialize(scored, "scored") if stage else scored, "_predicted"
    d = detection_state(r, th, key="_episode", model_pred=predicted).drop("_predicted")
    d = mitigation_trigger(d, th).drop("_episode")
    return materialize(d, "detector") if stage else d


# ------------------------------------------------------------------ SQL side
def sql_prelude() -> str:
    return f"pk AS ({adapter_sql('duckdb')})"


def sql_flows() -> str:
    return ("fl AS (SELECT *, src_ip || '->' || dst_ip || ':' || protocol AS session_id FROM pk "
            "WHERE protocol IN ('ICMP', 'TCP', 'UDP'))")


def sql_rates(th: Thresholds, src: str = "fl", name: str = "rt") -> str:
    """W6 + W7 + W8 over ``src`` (needs session_id, ts_us, pkt_id, size), as the
    sequential rule: packets up to this one in (ts_us, pkt_id) order."""
    a, b = repr(th.alpha), repr(1.0 - th.alpha)
    return f"""
{name}_w AS (
  SELECT p.session_id AS _s, p.pkt_id AS _p, count(*) AS pkt_count_1s, sum(CAST(x.size AS BIGINT)) AS byte_count_1s,
         stddev_pop(CAST(x.size AS DOUBLE)) AS _sz, list(x.ts_us ORDER BY x.ts_us, x.pkt_id) AS _tl
  FROM {src} p JOIN {src} x ON x.session_id = p.session_id AND x.ts_us BETWEEN p.ts_us - {th.window_us} AND p.ts_us
       AND (x.ts_us < p.ts_us OR x.pkt_id <= p.pkt_id)
  GROUP BY p.session_id, p.pkt_id),
{name}_g AS (
  SELECT {src}.*, pkt_count_1s, byte_count_1s, CAST(byte_count_1s AS DOUBLE) / pkt_count_1s AS avg_pkt_size,
         CASE WHEN pkt_count_1s > 1 THEN _sz ELSE 0.0 END AS pkt_size_std,
         CASE WHEN pkt_count_1s > 2 THEN
           list_stddev_pop(list_transform(range(1, len(_tl)), lambda i: CAST(_tl[i + 1] - _tl[i] AS DOUBLE))) / 1000000.0
           ELSE 0.0 END AS inter_arrival_std,
         CAST(pkt_count_1s AS DOUBLE) / CAST({float(th.window_s)!r} AS DOUBLE) AS raw_rate
  FROM {src} JOIN {name}_w ON session_id = _s AND pkt_id = _p),
{name} AS (
  SELECT *, list_reduce(list(raw_rate) OVER (PARTITION BY session_id ORDER BY ts_us, pkt_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                        lambda acc, x: CAST({a} AS DOUBLE) * x + CAST({b} AS DOUBLE) * acc,
                        CAST(0.0 AS DOUBLE)) AS packet_rate
  FROM {name}_g)"""


def sql_attack_slice(dims: Dims) -> str:
    cond = f"protocol = 'ICMP' AND dst_ip = '{dims.victim}'"
    if dims.watchlist:
        cond += f" AND src_ip IN ({_lit_list(dims.watch_ips)})"
    return (f"sl AS (SELECT *, src_ip || '->' || dst_ip || ':' || protocol AS session_id "
            f"FROM pk WHERE {cond})")


def sql_detect(th: Thresholds, src: str = "rt", model: str | None = None) -> str:
    """W13 + W14 over ``src`` (needs packet_rate).  Produces CTE ``det``.
    ``model`` is a model's prediction as an expression (P17), else the attack rate decides."""
    model = model or f"CASE WHEN packet_rate >= {th.attack!r} THEN 1 ELSE 0 END"
    return f"""
d1 AS (
  SELECT *, CASE WHEN packet_rate < {th.warn!r} THEN 0 ELSE coalesce({model}, 0) END AS final_prediction,
         packet_rate >= {th.warn!r} AS _hot,
         max(CASE WHEN packet_rate < {th.warn!r} THEN _rn END)
           OVER (PARTITION BY session_id ORDER BY _rn ROWS UNBOUNDED PRECEDING) AS _island
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_us, pkt_id) AS _rn FROM {src}) t),
d2 AS (SELECT *, min(CASE WHEN _hot THEN ts_us END) OVER (PARTITION BY session_id, _island) AS _ws FROM d1),
d3 AS (SELECT *, _hot AND (packet_rate > {th.attack!r}
                  OR (final_prediction = 1 AND ts_us - _ws >= {th.confirm_us})) AS _alert FROM d2),
d4 AS (SELECT *, min(CASE WHEN _alert THEN ts_us END) OVER (PARTITION BY session_id, _island) AS _afs FROM d3),
det AS (
  SELECT *, CASE WHEN NOT _hot THEN 'NORMAL' WHEN _alert THEN 'ATTACK_CONFIRMED' ELSE 'WARNING' END
              AS detection_status,
         CASE WHEN _hot THEN _ws END AS warning_since_us,
         CASE WHEN _hot AND _afs <= ts_us THEN _afs END AS alert_first_seen_us,
         _alert AND ts_us - _afs >= {th.delay_us} AS trigger,
         CASE WHEN _alert THEN CAST(floor(greatest(0, {th.delay_us} - (ts_us - _afs)) / 1000000) AS INTEGER)
              END AS countdown_s
  FROM d4)"""


def sql_cycle(th: Thresholds, src: str) -> str:
    """ST3 over rated rows of one session a source: the sequential detector
    with suppression, release and state reset, row by row.  Produces ``det``
    (rows under a drop are NORMAL), ``acts`` and ``drops`` (first ones)."""
    return f"""
sq AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY ts_us, pkt_id) AS _rn FROM {src}),
walk(src_ip, _rn, pkt_id, ts_us, until_us, ws, afs, k, dropped, hot, pred, alert, act) AS (
  SELECT src_ip, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT),
         0, false, false, 0, false, false FROM sq WHERE _rn = 1
  UNION ALL
  SELECT src_ip, _rn, pkt_id, ts_us, CASE WHEN act THEN ts_us + {th.hard_timeout_us} WHEN dropped THEN until_us END,
         ws, afs, k + CAST(act AS INTEGER), dropped, hot, pred, alert, act
  FROM (SELECT *, alert AND ts_us - afs >= {th.delay_us} AS act FROM (
    SELECT * EXCLUDE (old_afs), CASE WHEN dropped OR NOT hot THEN NULL WHEN alert THEN coalesce(old_afs, ts_us) ELSE old_afs END AS afs FROM (
      SELECT *, NOT dropped AND hot AND (rate > {th.attack!r} OR (pred = 1 AND ts_us - ws >= {th.confirm_us})) AS alert FROM (
        SELECT s.src_ip, s._rn, s.pkt_id, s.ts_us, w.until_us, w.k, s.packet_rate AS rate,
               coalesce(s.ts_us < w.until_us, false) AS dropped, s.packet_rate >= {th.warn!r} AS hot,
               CASE WHEN s.packet_rate >= {th.attack!r} AND s.packet_rate >= {th.warn!r} THEN 1 ELSE 0 END AS pred,
               CASE WHEN s.ts_us < w.until_us OR s.packet_rate < {th.warn!r} THEN NULL
                    WHEN w.until_us IS NOT NULL THEN s.ts_us ELSE coalesce(w.ws, s.ts_us) END AS ws,
               CASE WHEN w.until_us IS NULL THEN w.afs END AS old_afs
        FROM walk w JOIN sq s ON s.src_ip = w.src_ip AND s._rn = w._rn + 1) a) b) c) d),
det AS (SELECT sq.*, CASE WHEN w.dropped OR NOT w.hot THEN 'NORMAL' WHEN w.alert THEN 'ATTACK_CONFIRMED' ELSE 'WARNING' END AS detection_status,
               CASE WHEN w.dropped THEN 0 ELSE w.pred END AS final_prediction, w.act AS trigger
        FROM sq JOIN walk w ON sq.src_ip = w.src_ip AND sq._rn = w._rn),
acts AS (SELECT src_ip, ts_us AS drop_us, ts_us + {th.hard_timeout_us} AS release_us, k AS activation FROM walk WHERE act),
drops AS (SELECT src_ip, min(drop_us) AS drop_us FROM acts GROUP BY src_ip)"""


def sql_detector(th: Thresholds, dims: Dims) -> str:
    """WITH-list (without the WITH keyword) ending in CTE ``det``."""
    return ",\n".join([sql_prelude(), sql_attack_slice(dims), sql_rates(th, "sl", "rt"), sql_detect(th, "rt")])


__all__ = ["attack_slice", "baseline_slice", "detector", "flows", "q", "q_sql", "sql_cycle", "sql_detector",
           "sql_flows", "sql_prelude", "sql_rates"]
