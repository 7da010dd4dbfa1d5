"""ST6: streaming throttle (W18).  The decision for an event depends on the
last *kept* event of its key, so the state per key is that one timestamp and
the rows that still wait for the watermark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

OUT_SCHEMA = "key string, ts_us long, pkt_id long"
STATE_SCHEMA = "last_kept long, wait_ts array<long>, wait_id array<long>"


def throttle_stream(df: DataFrame, key: str, interval_s: float) -> DataFrame:
    """Rows wait in state until the watermark has passed them, so that they are
    taken in (ts, id) order whatever order they arrive in; a key's state goes
    once its interval has run out."""
    iu = int(round(interval_s * 1_000_000))

    def fold(k, pdfs, state):
        wm_ms = state.getCurrentWatermarkMs()
        last, *waiting = state.get if state.exists else (None, [], [])
        parts = [[np.array(w, np.int64)] for w in waiting]
        if not state.hasTimedOut:
            for pdf in pdfs:
                for part, c in zip(parts, ("ts_us", "pkt_id")):
                    part.append(pdf[c].to_numpy(np.int64))
        times, ids = (np.concatenate(part) for part in parts)
        order = np.lexsort((ids, times))
        ready = int(np.searchsorted(times[order], wm_ms * 1000, side="right"))
        now, later = order[:ready], order[ready:]
        kept, ts, at = [], times[now], 0
        while True:  # from one kept row to the next
            at = at if last is None else max(at, int(np.searchsorted(ts, last + iu)))
            if at >= len(ts):
                break
            kept.append((k[0], int(ts[at]), int(ids[now[at]])))
            last, at = int(ts[at]), at + 1
        wake = times[later[0]] if len(later) else (last if last is not None else 0) + iu
        if len(later) or wake > wm_ms * 1000:
            state.update((last, times[later].tolist(), ids[later].tolist()))
            state.setTimeoutTimestamp(int(max(wake // 1000, wm_ms)) + 1)
        elif state.exists:
            state.remove()
        if kept:
            yield pd.DataFrame(kept, columns=["key", "ts_us", "pkt_id"])

    x = df.select(F.col(key).cast("string").alias("key"), "ts_us", "pkt_id", "event_time")
    return x.groupBy("key").applyInPandasWithState(fold, OUT_SCHEMA, STATE_SCHEMA, "append",
                                                   GroupStateTimeout.EventTimeTimeout)
