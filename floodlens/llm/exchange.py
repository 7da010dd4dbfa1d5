"""Blocks of documents that ask buckets of keys, and get answers back.

Documents are dealt into blocks by ranges of their id, of bounded text size.
A block sends the sorted distinct 64-bit keys of its windows (or words) to
buckets, which are ranges of keys: one row a block and bucket, with the keys
as packed differences.  A bucket holds each key once a block, however often
it occurs, so no key makes a hot task.  Its answers go back to the blocks,
aligned with the keys that were asked.

The steps are one lazy plan in which Spark reuses the exchange of the blocks:
texts are shuffled once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: UTF-8 bytes of text in a block, and keys in a bucket, on average
BLOCK_BYTES = 8 << 20
BUCKET_KEYS = 1_000_000
#: smaller inputs are dealt into this many blocks, of a megabyte at least, so that they keep all tasks busy
LEAST_BLOCKS, LEAST_BYTES = 64, 1 << 20


class Layout:
    """How many blocks and buckets the documents need, and the block of each id."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, bytes_per_key: float, block_bytes: int, bucket_keys: int):
        total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        self.blocks = max(1, math.ceil(total / block_bytes), min(LEAST_BLOCKS, math.ceil(total / LEAST_BYTES)))
        self.buckets = max(1, math.ceil(total / bytes_per_key / bucket_keys))
        bounds: list[int] = []
        if self.blocks > 1:
            shares = [i / self.blocks for i in range(1, self.blocks)]
            bounds = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), shares, max(10_000, 20 * self.blocks))).first()[0] or []
        self.bounds = np.unique(np.array(bounds, np.int64))

    def block(self, id_col: str) -> Column:
        """The block of an id: blocks rise with the ids; null ids are in the first."""
        bounds = self.bounds

        @F.pandas_udf("int")
        def block_of(ids: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), side="left").astype(np.int32))

        return block_of(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")))


def edges(buckets: int) -> np.ndarray:
    """First keys of the buckets after the first."""
    return np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)


def slices(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of the parts of sorted ``keys`` that are not empty."""
    at = np.concatenate([[0], np.searchsorted(keys, edges(buckets)), [len(keys)]])
    return [(b, int(at[b]), int(at[b + 1])) for b in np.flatnonzero(at[1:] > at[:-1]).tolist()]


def pack(values: np.ndarray) -> bytes:
    """Non-negative 64-bit values in as many bytes each as the largest needs."""
    values = np.ascontiguousarray(values, np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.reshape(-1).view(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    """Rising values as the first one and the differences."""
    return int(values[0]).to_bytes(8, "little") + pack(np.diff(values)) if len(values) else b""


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    steps = unpack(data[8:])
    out = np.empty(len(steps) + 1, np.uint64)
    out[0] = int.from_bytes(data[:8], "little")
    out[1:] = steps
    return np.cumsum(out, out=out)


def id_ranks(ids) -> tuple[np.ndarray, np.ndarray]:
    """(order of rows by id, dense rank of the id of each row so ordered); null ids come first, with rank -1."""
    null = ids.is_null().to_numpy().astype(bool)
    plain = ids.fill_null(0).to_numpy()
    order = np.lexsort((plain, ~null))
    rank = np.unique(plain[~null], return_inverse=True)[1]
    return order, np.concatenate([np.full(null.sum(), -1), rank[np.argsort(plain[~null], kind="stable")]]).astype(np.int64)
