"""Operator 6, substring dedup over word windows.

Every window of ``width`` words gets a Rabin-Karp hash.  Blocks of documents
send the distinct hashes of their windows to buckets, where Spark counts the
blocks of each; a block learns which of its windows stand in an earlier block
and finds repeats within itself, and merges repeated windows into maximal
removal intervals.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import any_names, text_bytes
from .exchange import BLOCK_BYTES, BUCKET_KEYS, Layout, id_ranks, pack_sorted, slices, unpack_sorted
from .hashing import prefix_hash, rolling_hash, word_hashes

BYTES_PER_WORD = 6
SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("payload", pa.binary())])
ADDED = ("n_words", "n_removed", "spans", "kept")


class _Windows:
    """The windows of a block's documents, in the order of their ids."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, width: int):
        self.order, self.rank = id_ranks(table.column(id_col))
        texts = text_bytes(table.column(text_col).combine_chunks())
        self.texts = [texts[i] for i in self.order]
        hashes, self.counts = word_hashes(self.texts)
        self.doc = np.repeat(np.arange(len(self.texts)), self.counts)
        n = max(0, len(hashes) - width + 1)
        whole = (self.doc[:n] == self.doc[width - 1:]) & (self.rank[self.doc[:n]] >= 0) if n else np.zeros(0, bool)
        self.start = np.flatnonzero(whole)
        keys = rolling_hash(prefix_hash(hashes), width)[self.start]
        self.by_key = np.argsort(keys, kind="stable")  # of equal keys, smaller ids first
        ordered = keys[self.by_key]
        self.first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.distinct = ordered[self.first]
        self.run = np.cumsum(np.bincount(self.first, minlength=len(keys))) - 1 if len(keys) else np.zeros(0, np.int64)


def _send(cols: tuple[str, str], width: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        keys, block = _Windows(table, *cols, width).distinct, table.column("_block")[0].as_py()
        parts = slices(keys, buckets)
        return pa.table([[b for b, _, _ in parts], [block] * len(parts), [pack_sorted(keys[i:j]) for _, i, j in parts]], schema=SENT)
    return run


def _count(table: pa.Table) -> pa.Table:
    """For each block's keys of one bucket, a bit: the key also stands in an earlier block."""
    table = table.sort_by("block")
    keys = [unpack_sorted(p) for p in table.column("payload").to_pylist()]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    bits = np.zeros(len(every), bool)
    bits[order[1:]] = ordered[1:] == ordered[:-1]
    at = np.cumsum([0, *map(len, keys)])
    replies = [zlib.compress(np.packbits(bits[i:j]).tobytes(), 1) for i, j in zip(at[:-1], at[1:])]
    return pa.table([table.column("bucket"), table.column("block"), pa.chunked_array([pa.array(replies, pa.binary())])], schema=SENT)


def _remove(cols: tuple[str, str], width: int, buckets: int, out: pa.Schema):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out.empty_table()
        w = _Windows(table, *cols, width)
        earlier = np.zeros(len(w.distinct), bool)
        at = {b: (i, j) for b, i, j in slices(w.distinct, buckets)}
        for bucket, reply in zip(replies.column("bucket").to_pylist(), replies.column("payload").to_pylist()):
            i, j = at[bucket]
            earlier[i:j] = np.unpackbits(np.frombuffer(zlib.decompress(reply), np.uint8), count=j - i)
        rank = w.rank[w.doc[w.start[w.by_key]]]
        repeated = earlier[w.run] | (rank > rank[w.first][w.run]) if len(rank) else np.zeros(0, bool)
        mark = np.zeros(len(w.doc) + width + 1, np.int32)
        begins = w.start[w.by_key[repeated]]
        mark[begins] += 1  # every window start is there once
        mark[begins + width] -= 1
        gone = np.cumsum(mark)[:len(w.doc)] > 0
        stop = np.cumsum(w.counts)
        n_removed, spans, kept = np.zeros(len(w.texts), np.int64), [], []
        for k, text in enumerate(w.texts):
            mine, words = gone[stop[k] - w.counts[k]:stop[k]], text.split()
            if mine.any():
                n_removed[k] = mine.sum()
                turn = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                spans.append(turn.reshape(-1, 2).tolist())
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~mine)]))
            else:
                spans.append([])
                kept.append(b" ".join(words))
        table = table.take(pa.array(w.order))
        made = {n: table.column(n) for n in table.column_names} | {
            "n_words": pa.array(w.counts), "n_removed": pa.array(n_removed), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
            "kept": pa.array(kept, pa.binary()).cast(pa.string())}
        return pa.table([made[f.name] for f in out], schema=out)
    return run


@any_names
def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, carry: list[str] | None = None,
                            block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The ``carry`` columns of ``docs`` (all by default) with ``n_words``,
    ``n_removed``, ``spans`` (maximal removed runs of words, [first, end)) and
    ``kept`` (the words left, joined by one space).

    Words are runs of bytes other than ASCII white space.  A word goes when a
    window of ``width`` words over it also starts in a document of smaller id;
    windows are judged on the input.  Null and empty texts have no words, texts
    of fewer than ``width`` words lose none.  Rows of one id don't count as
    earlier for each other; rows with a null id are neither cut nor do they
    count as earlier.  Columns of ``docs`` with the added names are replaced.
    Two windows are one when their 64-bit hashes are equal.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ADDED]
    cols = (id_col, text_col)
    layout = Layout(docs, id_col, text_col, BYTES_PER_WORD, block_bytes, bucket_keys)
    blocks = docs.select(*dict.fromkeys([*carry, *cols]), layout.block(id_col).alias("_block"))
    sent = blocks.groupBy("_block").applyInArrow(_send(cols, width, layout.buckets), "bucket int, block int, payload binary")
    replies = sent.groupBy("bucket").applyInArrow(_count, "bucket int, block int, payload binary")
    out = docs.select(*carry).schema
    for name, kind in zip(ADDED, (T.LongType(), T.LongType(), T.ArrayType(T.ArrayType(T.LongType())), T.StringType())):
        out = out.add(name, kind)
    return (blocks.groupBy("_block").cogroup(replies.groupBy("block"))
            .applyInArrow(_remove(cols, width, layout.buckets, to_arrow_schema(out)), out))
