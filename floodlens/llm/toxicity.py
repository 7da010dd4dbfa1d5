"""Operator 9, toxicity: FTRL-proximal logistic regression.

Features are hashed word n-grams (words, word beginnings, pairs) and
skip-grams (pairs with one word between), by presence.  Each shard of labelled
rows runs FTRL-proximal with per-coordinate rates and L1; the shards' weights
are averaged by rows.  L1 leaves few weights, which are broadcast to score all
texts where they lie, without a shuffle.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import any_names, give_back, per_batch, text_bytes
from .decontaminate import NORMAL
from .hashing import batches, mix, prefix_hash, span_hash

FEATURE_BITS = 24
BEGINNINGS = (4, 5)  # bytes of a word's beginnings
#: labelled rows a shard learns from, on average
SHARD_ROWS = 4_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 4.0, 0.1, 4
#: averaged weights below this are dropped; with L1 on every shard this bounds the model
LEAST_WEIGHT = 1e-3
#: labels up to this many rows are broadcast to the texts; more are joined by a shuffle
BROADCAST_LABELS = 1_000_000
INTERCEPT = -1
#: texts of this score or more are taken for toxic
REJECT = 0.3


def _features(texts: list[bytes]):
    """Arrays (number of the text, feature) of some texts; a feature can repeat in a text."""
    plain = [t.translate(NORMAL) for t in texts]
    buf = np.frombuffer(b" ".join(plain) + b" ", np.uint8)
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = buf != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    prefix = prefix_hash(buf)
    word = span_hash(prefix, start, end)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in plain]), start, side="right")
    keys, docs = [word], [doc]
    for n in BEGINNINGS:
        long = end - start >= n
        keys.append(mix(span_hash(prefix, start[long], start[long] + n) + np.uint64(n)))
        docs.append(doc[long])
    for gap in (1, 2):
        if len(word) > gap:
            same = doc[:-gap] == doc[gap:]
            keys.append(mix(word[:-gap] * np.uint64(2 * gap + 3) + word[gap:] + np.uint64(100 + gap))[same])
            docs.append(doc[:-gap][same])
    return np.concatenate(docs), (np.concatenate(keys) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def _distinct(texts: list[bytes]) -> list[np.ndarray]:
    """The features of each text, each once, sorted, in 32 bits."""
    out: list[np.ndarray] = []
    for first, end in batches(texts):
        doc, feature = _features(texts[first:end])
        both = np.unique((doc << FEATURE_BITS) | feature)
        bounds = np.searchsorted(both, np.arange(1, end - first) << FEATURE_BITS)
        out += np.split((both & ((1 << FEATURE_BITS) - 1)).astype(np.uint32), bounds)
    return out


def ftrl(rows: list[np.ndarray], labels: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights of ``size`` features and the intercept, learnt from rows of feature numbers in turn."""
    z, n = np.zeros(size), np.zeros(size)
    zb = nb = 0.0
    for _ in range(EPOCHS):
        for x, y in zip(rows, labels):
            zx, nx = z[x], n[x]
            rate = (BETA + np.sqrt(nx)) / ALPHA
            w = np.where(np.abs(zx) <= L1, 0.0, (np.sign(zx) * L1 - zx) / (rate + L2))
            b = -zb / ((BETA + nb ** 0.5) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            step = np.sqrt(nx + g * g)
            z[x] = zx + g - (step - np.sqrt(nx)) / ALPHA * w
            n[x] = nx + g * g
            zb, nb = zb + g - ((nb + g * g) ** 0.5 - nb ** 0.5) / ALPHA * b, nb + g * g
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w, -zb / ((BETA + nb ** 0.5) / ALPHA)


def _learn(table: pa.Table) -> pa.Table:
    """One shard's weights (times its rows), and its rows at the intercept."""
    table = table.sort_by([("_turn", "ascending"), ("_id", "ascending"), ("_text", "ascending")])
    labels = table.column("_label").to_numpy().astype(float)
    rows = _distinct(text_bytes(table.column("_text").combine_chunks()))
    once, common = np.zeros(1 << FEATURE_BITS, bool), np.zeros(1 << FEATURE_BITS, bool)
    for x in rows:
        common[x] |= once[x]
        once[x] = True
    del once
    # a feature of one text can't outweigh L1 in its first epochs and says nothing of others
    names = np.flatnonzero(common)
    rows = [np.searchsorted(names, x[common[x]]) for x in rows]
    del common
    weights, intercept = ftrl(rows, labels, len(names))
    some = np.flatnonzero(weights)
    n = len(labels)
    del rows
    give_back()
    return pa.table({"feature": pa.array(np.append(names[some], INTERCEPT), pa.int64()),
                     "weight": pa.array(np.append(weights[some], intercept) * n, pa.float64()),
                     "rows": pa.array(np.append(np.zeros(len(some), np.int64), n), pa.int64())})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          shard_rows: int = SHARD_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, their weights, intercept) from all rows of ``docs`` that have
    a non-null label (any label of 1 makes a repeated id toxic).  Without
    labelled rows the model is empty and its intercept -35, so that every score
    is next to 0."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("_label"))
    n = marks.count()
    if not n:
        return np.zeros(0, np.int64), np.zeros(0), -35.0
    shards = -(-n // shard_rows)
    side = F.broadcast(marks) if n <= BROADCAST_LABELS else marks
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(side, "_id")
            .select("_id", "_text", "_label", F.xxhash64("_id", F.lit("turn")).alias("_turn"), F.pmod(F.xxhash64("_id"), F.lit(shards)).alias("_shard")))
    learnt = rows.groupBy("_shard").applyInArrow(_learn, "feature bigint, weight double, rows bigint")
    summed = learnt.groupBy("feature").agg(F.sum("weight").alias("weight"), F.sum("rows").alias("rows")).collect()
    total = max(1, sum(r.rows for r in summed))
    model = {r.feature: r.weight / total for r in summed}
    intercept = model.pop(INTERCEPT, -35.0)
    kept = sorted(f for f, w in model.items() if abs(w) >= LEAST_WEIGHT)
    return np.array(kept, np.int64), np.array([model[f] for f in kept]), intercept


_known: dict[str, np.ndarray] = {}  # a worker's table of the features that its model weighs


def _scorer(broadcast, text_col: str, score_col: str):
    key = uuid.uuid4().hex

    def score(batch: pa.RecordBatch) -> dict:
        features, weights, intercept = broadcast.value
        if key not in _known:
            _known.clear()
            _known[key] = np.zeros(1 << FEATURE_BITS, bool)
            _known[key][features] = True
        known = _known[key]
        texts = text_bytes(batch.column(text_col))
        total = np.full(len(texts), intercept)
        for first, end in batches(texts):
            doc, feature = _features(texts[first:end])
            hit = known[feature]
            both = np.unique(((doc[hit] + first) << FEATURE_BITS) | feature[hit])
            total += np.bincount(both >> FEATURE_BITS, weights[np.searchsorted(features, both & ((1 << FEATURE_BITS) - 1))], len(texts))
        return {n: batch.column(n) for n in batch.schema.names} | {score_col: pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))), pa.float64())}
    return score


@any_names
def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, from 0 to 1, higher for likelier toxic texts
    (a column of this name is replaced).  Null and empty texts have no
    features; their score is the intercept's."""
    base = docs.drop(score_col)
    out = base.withColumn(score_col, F.lit(0.0)).schema
    return base.mapInArrow(per_batch(_scorer(docs.sparkSession.sparkContext.broadcast(model), text_col, score_col)), out)
