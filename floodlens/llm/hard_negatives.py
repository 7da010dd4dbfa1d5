"""Operator 12, hard negatives by Strassen products of anchor and candidate tiles.

The anchors are the stated query set, all rows are candidates.  Both are dealt
into blocks, and every pair of an anchor block and a candidate block is a cell of
a grid: a task holds one cell, multiplies its vectors as int64 tiles by Strassen's
recursion (zero padding, exact integer additions) and keeps small heaps.  A first
round over the grid keeps, for each anchor, the best candidates of its own label;
the heaps of a row of cells merge into the anchor's positives.  They set each
positive's score window, and a second round keeps the best candidates of other
labels inside each window.

Scores are exact: components are whole numbers, and sums stay within 64 bits
because components beyond ``limit_of(length)`` are set to that limit (2^27 for up to
128 of them).  Products inside the recursion may wrap around; the sums of them
that make a score are exact modulo 2^64, so the score itself is.

Defined cases: rows with a null id or label, a null vector, or a null or
non-finite component take no part.  Vectors may differ in length; the shorter
one counts as filled up with zeros.  A repeated row is a candidate as often as
it occurs; rows of the anchor's own id are never its positives or negatives; a
repeated anchor is answered once.  Anchors without positives, or windows without
negatives, give no rows, and so does an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: components are whole multiples of 1 / SCALE
SCALE = 256
#: rows of a block: at most, and how many candidate blocks there are at least
ANCHOR_ROWS, CANDIDATE_ROWS, CANDIDATE_BLOCKS = 4_096, 65_536, 24
#: rows and columns of a tile, and the size at which the recursion multiplies directly
TILE, LEAF = 512, 16
#: scores that a task holds at once
SCORES = 1 << 21


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices by Strassen's seven products of halves.  Odd
    sides are padded with zeros; all additions are exact modulo 2^64."""
    n, k = a.shape
    m = b.shape[1]
    if min(n, k, m) <= leaf // 2 or k <= leaf // 2 or max(n, k, m) <= leaf:
        return a @ b if k else np.zeros((n, m), np.int64)
    h, i, j = -(-n // 2), -(-k // 2), -(-m // 2)
    if (n, k, m) != (2 * h, 2 * i, 2 * j):
        a = np.pad(a, ((0, 2 * h - n), (0, 2 * i - k)))
        b = np.pad(b, ((0, 2 * i - k), (0, 2 * j - m)))
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), np.int64)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out[:n, :m]


def product(a: np.ndarray, b: np.ndarray, tile: int = TILE) -> np.ndarray:
    """``a @ b.T`` in tiles of ``tile`` rows by ``tile`` columns."""
    out = np.empty((len(a), len(b)), np.int64)
    for i in range(0, len(a), tile):
        for j in range(0, len(b), tile):
            out[i:i + tile, j:j + tile] = strassen(a[i:i + tile], b[j:j + tile].T)
    return out


def limit_of(length: int) -> int:
    """The largest component whose squares can be summed ``length`` times in 63 bits."""
    return 1 << (61 - max(0, length - 1).bit_length()) // 2


def whole_vectors(flat: np.ndarray, sizes: np.ndarray, length: int, limit: int) -> np.ndarray:
    """Rows of floor(SCALE * component) as int64, within ``limit``, filled up with
    zeros to ``length`` or cut there."""
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(SCALE * flat), -float(limit), float(limit)).astype(np.int64)
    if (sizes == length).all():
        return whole.reshape(len(sizes), length)
    out = np.zeros((len(sizes), length), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(whole)) - (np.cumsum(sizes) - sizes)[row]
    inside = place < length
    out[row[inside], place[inside]] = whole[inside]
    return out


def best(score: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Places of the first ``keep`` by falling score, then rising id."""
    if len(score) > 4 * keep:  # no score below the keep-th largest can be among them
        near = np.flatnonzero(score >= np.partition(score, len(score) - keep)[len(score) - keep])
        return near[np.lexsort((ids[near], -score[near]))[:keep]]
    return np.lexsort((ids, -score))[:keep]


def _step(columns: int) -> int:
    return max(1, min(TILE, SCORES // max(1, columns)))


def positive_heaps(anchors: dict, rows: dict, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, score, id) of the first ``keep`` other rows of each anchor's label."""
    out = [(np.zeros(0, np.int64),) * 3]
    for label in np.intersect1d(anchors["label"], rows["label"]).tolist():
        mine, theirs = np.flatnonzero(anchors["label"] == label), np.flatnonzero(rows["label"] == label)
        ids = rows["id"][theirs]
        for at in range(0, len(mine), step := _step(len(theirs))):
            some = mine[at:at + step]
            for row, scores in zip(some.tolist(), product(anchors["x"][some], rows["x"][theirs])):
                other = np.flatnonzero(ids != anchors["id"][row])
                top = other[best(scores[other], ids[other], keep)]
                out.append((np.full(len(top), row), scores[top], ids[top]))
    return tuple(map(np.concatenate, zip(*out)))


def window_heaps(anchors: dict, rows: dict, low: np.ndarray, high: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """(anchor, window, score, id) of the first ``keep`` rows of other labels in
    each anchor's windows ``low[a, w] <= score <= high[a, w]``."""
    out = [(np.zeros(0, np.int64),) * 4]
    order = np.argsort(rows["id"], kind="stable")  # so that a stable sort by score leaves ties by id
    x, ids, labels = rows["x"][order], rows["id"][order], rows["label"][order]
    for at in range(0, len(anchors["id"]), step := _step(len(x))):
        for row, scores in enumerate(product(anchors["x"][at:at + step], x), at):
            lows, highs = low[row], high[row]
            fit = np.flatnonzero((labels != anchors["label"][row]) & (ids != anchors["id"][row]) & (scores >= lows.min()) & (scores <= highs.max()))
            fit = fit[np.argsort(-scores[fit], kind="stable")]
            falling = -scores[fit]
            first, end = np.searchsorted(falling, -highs, "left"), np.searchsorted(falling, -lows, "right")
            for w, (i, j) in enumerate(zip(first.tolist(), np.minimum(end, first + keep).tolist())):
                if i < j:
                    top = fit[i:j]
                    out.append((np.full(j - i, row), np.full(j - i, w), scores[top], ids[top]))
    return tuple(map(np.concatenate, zip(*out)))


def _sides(left: pa.Table, right: pa.Table, limit: int) -> list[dict]:
    """Ids, labels and whole vectors of both sides of a cell.  Components that the
    other side's vectors all lack count nothing."""
    tables = [(t, t.column("vector").combine_chunks()) for t in (left, right)]
    sizes = [v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for _, v in tables]
    length = min(int(n.max(initial=0)) for n in sizes)
    return [{"id": t.column("vec_id").to_numpy(), "label": t.column("label").to_numpy(),
             "x": whole_vectors(v.flatten().to_numpy(zero_copy_only=False), n, length, limit)} for (t, v), n in zip(tables, sizes)]


def _grid(anchors: DataFrame, rows: DataFrame, anchor_blocks: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the ``cell`` of the grid: anchors in every column of their row, rows in every row of their column."""
    column, line = F.col("block").cast("long"), F.col("anchor") % anchor_blocks
    left = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("cell", line * blocks + column)
    right = rows.withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1)))).withColumn("cell", F.col("line") * blocks + column)  # both long: cogroups hash keys by their type
    return left.drop("block").groupBy("cell"), right.drop("line", "block").groupBy("cell")


def _first(heaps: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """The merged heaps: the first ``keep`` entries of each key, with their ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine_hard_negatives(rows: DataFrame, is_anchor, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                        positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the id column, the stated query set.  For each
    anchor and each of its first ``positives`` other rows of its label, the first
    ``negatives`` rows of other labels whose score is from ``window[0]`` to
    ``window[1]`` percent of the positive's; all of them where there are fewer.
    Other columns of ``rows`` take no part, whatever their names.  The cells meet
    blocks of vectors, so shuffled rows grow with rows x anchor blocks, and a row
    of cells hands on at most ``positives`` (or ``positives x negatives``) entries
    of an anchor."""
    vector = F.col(f"`{vector_col}`")
    usable = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                         vector.cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = usable.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad)
    seen = usable.agg(F.count("*"), F.max(F.size("vector"))).first()
    total, limit = seen[0], limit_of(seen[1] or 0)
    blocks = max(CANDIDATE_BLOCKS, math.ceil(total / CANDIDATE_ROWS))
    # a hot id or repeated vector is dealt evenly, as blocks go by the place of a row in the input
    rows = usable.drop("is_anchor").withColumn("block", (F.monotonically_increasing_id() % blocks).cast("int"))
    distinct = usable.where("is_anchor").drop("is_anchor").distinct()
    anchors = materialize(distinct.withColumn("anchor", F.monotonically_increasing_id()), "mining-anchors")
    anchor_blocks = max(1, math.ceil(anchors.count() / ANCHOR_ROWS))

    def positive_cell(left, right):
        a, r = _sides(left, right, limit)
        row, score, ids = positive_heaps(a, r, positives)
        return pa.table({"anchor": left.column("anchor").to_numpy()[row], "score": score, "id": ids})
    left, right = _grid(anchors, rows, anchor_blocks, blocks)
    found = left.cogroup(right).applyInArrow(positive_cell, "anchor bigint, score bigint, id bigint")
    low, high = window
    score = F.col("score").cast("decimal(38,0)")
    # exact bounds of whole scores: 100 s >= low p and 100 s <= high p
    edges = _first(found, ["anchor"], positives).select(
        "anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.ceil(score * low / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high"))
    edges = materialize(edges, "mining-positives")
    windows = edges.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("windows"))
    asked = anchors.join(windows, "anchor").withColumn("low", F.col("windows.low")).withColumn("high", F.col("windows.high")).drop("windows")

    def window_cell(left, right):
        a, r = _sides(left, right, limit)
        bounds = []
        for name, rest in (("low", 1), ("high", 0)):  # fewer positives: windows that nothing fits
            lists = left.column(name).to_pylist()
            bounds.append(np.array([x + [rest] * (positives - len(x)) for x in lists], np.int64).reshape(len(lists), positives))
        row, place, score, ids = window_heaps(a, r, *bounds, negatives)
        return pa.table({"anchor": left.column("anchor").to_numpy()[row], "place": (place + 1).astype(np.int32), "score": score, "id": ids})
    left, right = _grid(asked, rows, anchor_blocks, blocks)
    found = left.cogroup(right).applyInArrow(window_cell, "anchor bigint, place int, score bigint, id bigint")
    ranked = _first(found, ["anchor", "place"], negatives)
    return (ranked.join(edges.select("anchor", "place", "positive_id", "positive_score"), ["anchor", "place"])
            .join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
