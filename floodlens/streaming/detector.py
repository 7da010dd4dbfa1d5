"""ST2 (per-packet detector), ST3 (mitigation cycle), ST7 (session counters)
and ST4 (idle-session eviction) as one ``applyInPandasWithState`` keyed by
session.

State per session is a few scalars plus the packets of the trailing window
(bounded by rate x window), so it does not grow with the stream.  Rows wait in
the state until the watermark has passed them and are then folded in (ts, id)
order; Spark drops rows that come later still (``late_rows`` finds them).  A session
idle for longer than ``max_age_s`` is evicted: by the event-time timeout when
the watermark passes, or on its next packet, whichever comes first; its next
packet starts a fresh session (counters, window and EWMA from zero).  With
``sweep_s`` stale sessions go only at the multiples of that interval, all on one
timer, and a session that comes back before its sweep goes on.

With a fitted classifier the prediction (P17) is the model's: rates don't depend
on predictions, so a session's ready rows first get their features, are then
scored together as one matrix product, and only the state machine walks them one
by one.  Without one the attack rate decides.

With ``mitigate`` the session's mitigation clock runs inside the same fold
(ST3): an alert older than the delay activates a drop for the hard timeout;
while it is active the rates keep updating but the detection state does not
(the row is ``DROP_ACTIVE``), and on expiry the detection state restarts.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from floodlens.config import Thresholds

DEFAULT = Thresholds()

OUT_SCHEMA = (
    "session_id string, src_ip string, pkt_id long, ts_us long, pkt_count_1s long, byte_count_1s long, "
    "avg_pkt_size double, pkt_size_std double, inter_arrival_std double, raw_rate double, packet_rate double, "
    "final_prediction int, detection_status string, warning_since_us long, alert_first_seen_us long, "
    "trigger boolean, mitigated boolean, activation int, start_us long, packet_count long"
)
STATE_SCHEMA = (
    "win_ts array<long>, win_sz array<long>, ewma double, ws long, afs long, start_us long, n long, "
    "last_ts long, last_id long, until long, acts int, src string, to_victim int, "
    "wait_ts array<long>, wait_id array<long>, wait_sz array<long>"
)
#: places of a row's features in the fold, and their names in the classifier
R_COUNT, R_EWMA = 2, 8
FEATURES_OF_ROW = ("packet_count_1s", "byte_count_1s", "avg_pkt_size", "pkt_size_std", "inter_arrival_std", "raw_rate", "packet_rate_ewma")
OUT_COLS = [c.strip().split(" ")[0] for c in OUT_SCHEMA.split(",")]
# explicit nullable dtypes: a missing long stays a null long, never a float NaN
_DTYPES = {"long": "Int64", "int": "Int32", "double": "Float64", "boolean": "boolean", "string": "string"}
OUT_DTYPES = {c.strip().split(" ")[0]: _DTYPES[c.strip().split(" ")[1]] for c in OUT_SCHEMA.split(",")}


def _fold_fn(th: Thresholds, mitigate: bool, max_age_s: float | None, model=None, sweep_s: float | None = None):
    W = th.window_us
    warn, attack, alpha = th.warn, th.attack, th.alpha
    confirm, delay, hard = th.confirm_us, th.delay_us, th.hard_timeout_us
    max_age = int(round(max_age_s * 1_000_000)) if max_age_s else None
    sweep = int(round(sweep_s * 1_000_000)) if sweep_s else 1

    def predictions(rows: list, to_victim: int) -> list[int]:
        """P17 of the ready rows of a session: 0 below the warning rate, else the
        model's prediction (a feature that it doesn't know is 0.0, P18), or the
        attack rate's without a model."""
        if model is None:
            return [int(r[R_EWMA] >= attack) if r[R_EWMA] >= warn else 0 for r in rows]
        values = dict(zip(FEATURES_OF_ROW, zip(*(r[R_COUNT:R_EWMA + 1] for r in rows)))) | {"is_to_victim": [to_victim] * len(rows)}
        x = np.column_stack([np.array(values.get(c, [0.0] * len(rows)), float) for c in model.features])
        return [int(p) if r[R_EWMA] >= warn else 0 for r, p in zip(rows, model.predict(x))]

    def fold(key, pdfs, state):
        wm_ms = state.getCurrentWatermarkMs()
        if state.exists:
            (wts, wsz, ewma, ws, afs, start, n, last_ts, last_id, until, acts, src, to_victim, *waiting) = state.get
            win = deque(zip(list(wts), list(wsz)))
            parts = [[np.array(w, np.int64)] for w in waiting]
        else:
            win, ewma, ws, afs, start, n, last_ts, last_id, until, acts, src, to_victim = (
                deque(), 0.0, None, None, None, 0, None, None, None, 0, None, 0)
            parts = [[], [], []]
        if not state.hasTimedOut:
            for pdf in pdfs:
                if src is None and len(pdf):
                    src, to_victim = pdf["src_ip"].iloc[0], int(pdf["to_victim"].iloc[0])
                for part, c in zip(parts, ("ts_us", "pkt_id", "size")):
                    part.append(pdf[c].to_numpy(np.int64))
        times, ids, sizes = (np.concatenate(part) if part else np.zeros(0, np.int64) for part in parts)
        order = np.lexsort((ids, times))
        # a row's place is known once the watermark has passed it; the others wait
        ready = int(np.searchsorted(times[order], wm_ms * 1000, side="right"))
        now, later = order[:ready], order[ready:]
        if state.hasTimedOut and not ready and not len(later):
            state.remove()  # ST4: idle longer than the max age
            return
        # running sums over the window: bytes, bytes^2, gaps, gaps^2 (exact integers)
        sb = sum(s for _, s in win)
        sb2 = sum(s * s for _, s in win)
        ts_list = [t for t, _ in win]
        sg2 = sum((b - a) ** 2 for a, b in zip(ts_list, ts_list[1:]))
        rates = []  # (time, id, features ..., rate, session start, packets, whether the session is new)
        for t, pid, size in zip(times[now].tolist(), ids[now].tolist(), sizes[now].tolist()):
            stale = max_age is not None and last_ts is not None and t - t % sweep - last_ts > max_age
            if stale:
                win.clear()
                sb = sb2 = sg2 = 0
                ewma, start, n = 0.0, None, 0
            # Closed trailing window [t - W, t]
            if win:
                sg2 += (t - win[-1][0]) ** 2
            win.append((t, size))
            sb += size
            sb2 += size * size
            while win[0][0] < t - W:
                t0, s0 = win.popleft()
                sb -= s0
                sb2 -= s0 * s0
                sg2 -= (win[0][0] - t0) ** 2
            k = len(win)
            mean = sb / k
            size_std = ((k * sb2 - sb * sb) / (k * k)) ** 0.5 if k > 1 else 0.0
            if k > 2:
                gaps = k - 1
                mg = (win[-1][0] - win[0][0]) / gaps
                gap_std = max(sg2 / gaps - mg * mg, 0.0) ** 0.5 / 1_000_000.0
            else:
                gap_std = 0.0
            raw = k / th.window_s
            ewma = alpha * raw + (1.0 - alpha) * ewma  # W8
            # ST7
            start = t if start is None else start
            n += 1
            last_ts, last_id = t, pid
            rates.append((t, pid, k, sb, mean, size_std, gap_std, raw, ewma, start, n, stale))
        out = []
        sid = key[0]
        for (t, pid, k, sb_t, mean, size_std, gap_std, raw, r, start_t, n_t, stale), pred in zip(rates, predictions(rates, to_victim) if rates else []):
            if stale:
                ws, afs, until = None, None, None
            # ST3: suppressed while the source's drop is active
            mitigated, trigger, activation = False, False, None
            if until is not None:
                if t < until:
                    mitigated = True
                else:
                    until, ws, afs = None, None, None
            if mitigated:
                status = "DROP_ACTIVE"
                row_ws = row_afs = None
            elif r < warn:  # W13
                status, ws, afs = "NORMAL", None, None
                row_ws = row_afs = None
            else:
                if ws is None:
                    ws = t
                alert = r > attack or (pred == 1 and t - ws >= confirm)
                if alert:
                    if afs is None:
                        afs = t
                    status = "ATTACK_CONFIRMED"
                    trigger = t - afs >= delay  # W14
                    if trigger and mitigate:
                        acts += 1
                        activation = acts
                        until = t + hard
                else:
                    status = "WARNING"
                row_ws, row_afs = ws, afs
            out.append((sid, src, pid, t, k, sb_t, mean, size_std, gap_std, raw, r, pred, status, row_ws, row_afs,
                        trigger, mitigated, activation, start_t, n_t))
        wake = None
        if len(later):
            wake = int(times[later[0]])
        elif max_age is not None:  # the first sweep at which it is stale
            wake = ((last_ts + max_age) // sweep + 1) * sweep
        if not len(later) and wake is not None and wake <= wm_ms * 1000:  # already: all rows to come are later than that
            if state.exists:
                state.remove()
        else:
            state.update(([x for x, _ in win], [s for _, s in win], ewma, ws, afs, start, n, last_ts, last_id,
                          until, acts, src, to_victim, times[later].tolist(), ids[later].tolist(), sizes[later].tolist()))
            if wake is not None:
                state.setTimeoutTimestamp(max(wake // 1000, wm_ms) + 1)
        if out:
            yield pd.DataFrame(out, columns=OUT_COLS).astype(OUT_DTYPES)

    return fold


def detector_stream(rows: DataFrame, th: Thresholds = DEFAULT, mitigate: bool = False,
                    max_age_s: float | None = None, key: str = "session_id", evict_idle: bool = True,
                    model=None, victim: str | None = None, sweep_s: float | None = None) -> DataFrame:
    """Per-packet detector rows of a packet stream (needs ``session_id``,
    ``src_ip``, ``pkt_id``, ``ts_us``, ``size`` and a watermark).  Idle
    sessions are evicted after ``max_age_s`` (default: the thresholds'
    ``session_max_age_s``) so the state store holds live sessions only; with
    ``sweep_s`` (the thresholds' own is 120 s) only at the multiples of that interval.

    ``model`` is a fitted ``KernelClassifier`` (a few small matrices, which go to the
    tasks with the fold), or None for the threshold rule (P17); ``victim`` sets its
    feature ``is_to_victim`` from the rows' ``dst_ip``."""
    if max_age_s is None and evict_idle:
        max_age_s = th.session_max_age_s
    to_victim = F.coalesce((F.col("dst_ip") == victim).cast("int"), F.lit(0)) if victim is not None else F.lit(0)
    x = rows.select(F.col(key).alias("session_id"), "src_ip", "pkt_id", "ts_us", F.col("size").cast("long"),
                    to_victim.alias("to_victim"), "event_time")
    return x.groupBy("session_id").applyInPandasWithState(
        _fold_fn(th, mitigate, max_age_s, model, sweep_s), OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def activations(det: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """ST3 mitigation events from the detector rows: one DROP per activation,
    released after the hard timeout (``src_ip``, ``drop_us``, ``release_us``, ``activation``)."""
    return (det.filter(F.col("activation").isNotNull())
            .select("src_ip", F.col("ts_us").alias("drop_us"),
                    (F.col("ts_us") + F.lit(th.hard_timeout_us)).alias("release_us"), "activation"))
