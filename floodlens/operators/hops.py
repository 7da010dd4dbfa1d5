"""One packet, many switches (Q6).

Every switch on a packet's way reports it, so rates over observations count hops.
``dedupe_hops`` keeps one observation a packet, its first, without a packet id:

* observations of one *identity* (addresses, protocol, size) on one switch are in
  the order in which their packets passed it, so the k-th observation of a switch
  is the k-th packet there;
* the switch where a flow enters sees each of its packets first, so the number of
  distinct packets so far is the largest count of any switch, and an observation
  shows a new packet iff its switch's count exceeds every count before;
* counts begin anew when the identity has been silent for longer than the
  tolerance, so a lost observation can't shift the matching for good.

Counts and maxima are running sums and maxima over ``(identity, chunk)`` with one
carried row a chunk: an identity that floods is spread over its chunks.  In the
stream an identity keeps a count a switch, in the state of its hash bucket.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from floodlens.config import DEFAULT
from floodlens.operators.rates import session_episodes
from floodlens.operators.sequence import CHUNK, chunk_window, prefix_carry

#: columns that all observations of a packet share
IDENTITY = ("src_ip", "dst_ip", "protocol", "size")


def dedupe_hops(obs: DataFrame, tol_s: float, switch: str = "dpid", identity: tuple = IDENTITY, chunk_s: float = 10.0) -> DataFrame:
    """The first observation of each packet.  ``obs`` needs ``ts_us``, ``pkt_id`` (any
    id of an observation), the switch and the identity columns; nulls of these
    are a value like any other.  All columns are kept."""
    order = ["ts_us", "pkt_id", "_switch"]
    who = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in identity])
    x = obs.withColumn("_who", who).withColumn("_switch", F.coalesce(F.col(switch).cast("string"), F.lit("\x00")))
    x = session_episodes(x, "_who", replace(DEFAULT, session_max_age_s=tol_s), chunk_s, out="_burst")
    x = x.withColumn("_n", F.row_number().over(chunk_window(["_burst", "_switch"], order)).cast("long"))
    seen = x.groupBy("_burst", "_switch", CHUNK).agg(F.max("_n").alias("_in"))
    x = (x.join(prefix_carry(seen, ["_burst", "_switch"], {"_before": ("sum", "_in")}), ["_burst", "_switch", CHUNK])
         .withColumn("_n", F.col("_n") + F.coalesce("_before", F.lit(0))))
    earlier = chunk_window(["_burst"], order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_most", F.max("_n").over(earlier))
    most = x.groupBy("_burst", CHUNK).agg(F.max("_n").alias("_in"))
    x = x.join(prefix_carry(most, ["_burst"], {"_carried": ("max", "_in")}), ["_burst", CHUNK])
    new = F.col("_n") > F.coalesce(F.greatest("_most", "_carried"), F.lit(0))
    return x.filter(new).select(*obs.columns)


def _packed(frame: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as w:
        w.write_table(pa.Table.from_pandas(frame, schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _codes(frame: pd.DataFrame, columns: tuple) -> np.ndarray:
    """A number for each distinct row of ``columns``; nulls are a value."""
    out = np.zeros(len(frame), np.int64)
    for c in columns:
        code, names = pd.factorize(frame[c], use_na_sentinel=False)
        out = pd.factorize(out * max(1, len(names)) + code)[0]
    return out


def _advance(counts: pd.DataFrame, ready: pd.DataFrame, identity: tuple, tol: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The observations of ``ready`` that show a new packet, and the counts after
    all of them: for each identity and switch of its burst the count ``n``, the
    identity's last time and its largest count."""
    if not len(ready):
        return ready, counts
    k, names = len(counts), [*identity, "_switch"]
    both = pd.concat([counts[names], ready[names]], ignore_index=True)
    who, (switch, switches) = _codes(both, identity), pd.factorize(both["_switch"], sort=True)
    known, last, most = (np.zeros(who.max() + 1, t) for t in (bool, np.int64, np.int64))
    known[who[:k]], last[who[:k]], most[who[:k]] = True, counts["last"], counts["most"]
    order = np.lexsort((switch[k:], ready["pkt_id"], ready["ts_us"], who[k:]))
    x, w, s = ready.iloc[order], who[k:][order], switch[k:][order]
    t = x["ts_us"].to_numpy()
    begins, ends = np.append(True, w[1:] != w[:-1]), np.append(w[1:] != w[:-1], True)
    fresh = np.where(begins, ~known[w] | (t - last[w] > tol), t - np.append(0, t[:-1]) > tol)
    starts = begins | fresh
    burst, at = np.cumsum(starts) - 1, np.flatnonzero(starts)
    goes_on = ~fresh[at]  # from the carried counts
    n = pd.Series(burst * len(switches) + s).groupby(burst * len(switches) + s).cumcount().to_numpy() + 1
    held = pd.Series(counts["n"].to_numpy(), who[:k] * len(switches) + switch[:k])
    n += np.where(goes_on[burst], held.reindex(w * len(switches) + s, fill_value=0), 0)
    top = pd.Series(n).groupby(burst).cummax().to_numpy()
    earlier = np.append(0, top[:-1])
    earlier[at] = 0
    base = np.where(goes_on, most[w[at]], 0)[burst]
    first = x[n > np.maximum(earlier, base)]
    met, on = np.zeros(len(known), bool), np.zeros(len(known), bool)
    met[w], on[w[ends]] = True, goes_on[burst[ends]]
    last[w[ends]], most[w[ends]] = t[ends], np.maximum(top, base)[ends]
    of_last = np.isin(burst, burst[ends])
    after = pd.concat([counts.assign(_who=who[:k])[~met[who[:k]] | on[who[:k]]], x[names].assign(n=n, _who=w)[of_last]], ignore_index=True)
    after = after.drop_duplicates(["_who", "_switch"], keep="last")
    return first, after.assign(last=last[after["_who"]], most=most[after["_who"]]).drop(columns="_who")


#: groups of identities that share a state in the stream (fixed for the life of a checkpoint)
BUCKETS = 256


def dedupe_hops_stream(obs: DataFrame, tol_s: float, switch: str = "dpid", identity: tuple = IDENTITY, buckets: int = BUCKETS) -> DataFrame:
    """The same in a stream (with ``event_time`` and a watermark): the identity
    columns, ``pkt_id``, ``ts_us`` and the switch of each packet's first observation.

    Observations wait until the watermark has passed them; an identity's counts go
    once it has been silent for longer than the tolerance.  Identities are dealt
    into ``buckets`` by hash, so that calls and states are as many as these, not
    as the identities; a bucket's identities are counted together, by columns."""
    tol = int(round(tol_s * 1_000_000))
    kinds = {f.name: f.dataType.simpleString() for f in obs.schema.fields}
    names = [*identity, "_switch"]
    text, number = [(c, pa.string()) for c in names], lambda *cols: [(c, pa.int64()) for c in cols]
    counted, waiting = pa.schema(text + number("n", "last", "most")), pa.schema(text + number("ts_us", "pkt_id"))
    shown = [*identity, "pkt_id", "ts_us", "_switch"]

    def fold(key, pdfs, state):
        wm_ms = state.getCurrentWatermarkMs()
        wm = wm_ms * 1000
        counts, rows = (pa.ipc.open_stream(x).read_pandas() for x in state.get) if state.exists else (s.empty_table().to_pandas() for s in (counted, waiting))
        if not state.hasTimedOut:
            rows = pd.concat([rows, *(pdf[waiting.names] for pdf in pdfs)], ignore_index=True)
        ready = rows["ts_us"] <= wm
        first, counts = _advance(counts, rows[ready], identity, tol)
        later = rows[~ready]
        who = _codes(pd.concat([counts[names], later[names]], ignore_index=True), identity)
        busy = np.isin(who[:len(counts)], who[len(counts):])
        counts, busy = (x[busy | (counts["last"] + tol + 1 > wm)] for x in (counts, busy))
        if len(later) or len(counts):
            wake = min([*later["ts_us"], *(counts["last"][~busy] + tol + 1)])
            state.update((_packed(counts, counted), _packed(later, waiting)))
            state.setTimeoutTimestamp(max(int(wake) // 1000, wm_ms) + 1)
        elif state.exists:
            state.remove()
        if len(first):
            yield first[shown]

    x = obs.select(*[F.col(c).cast("string").alias(c) for c in identity], "pkt_id", "ts_us", F.coalesce(F.col(switch).cast("string"), F.lit("\x00")).alias("_switch"),
                   "event_time", F.pmod(F.xxhash64(*identity), F.lit(buckets)).alias("_bucket"))
    out = ", ".join([f"{c} string" for c in identity] + ["pkt_id long", "ts_us long", "_switch string"])
    first = x.groupBy("_bucket").applyInPandasWithState(fold, out, "counts binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)
    return first.select(*[F.col(c).cast(kinds[c]).alias(c) for c in identity], "pkt_id", "ts_us",
                        F.when(F.col("_switch") != "\x00", F.col("_switch")).cast(kinds[switch]).alias(switch))
