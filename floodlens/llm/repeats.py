"""Operator 5, suffix-array dedup by longest previous factors.

A byte goes when a ``length``-byte string over it also starts in a document of
smaller id: where the longest-previous-factor (LPF) array, taken over earlier
documents, reaches ``length``.  A suffix array of all bytes would move every
suffix's context, so the suffixes are first cut down, without loss:

1. Every window of ``length`` bytes picks the smallest hash of the q-grams in
   it as its anchor.  Windows that follow each other with one anchor form a
   segment (at most ``SPAN`` windows), whose content alone decides it.  Equal
   windows have equal anchors, so only segments of one anchor can share one.
2. Blocks of documents send (anchor, segment hash) pairs to buckets.  A segment
   that stands whole in an earlier block repeats in all its windows; an anchor
   whose segments are all equal is settled with that.
3. What is left, segments of an anchor that differ, is sent as bytes.  Each
   bucket puts the suffixes of its segments (to the segment's end, ``length``
   bytes or more) in order, with the common prefixes of neighbours; the
   nearest smaller documents before and after a suffix give its previous
   factor, and a window repeats where that is ``length`` or longer.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import any_names, text_bytes
from .exchange import BLOCK_BYTES, Layout, id_ranks, pack, pack_sorted, slices, unpack, unpack_sorted
from .hashing import PIECE_BYTES, mix, prefix_hash, rolling_hash, span_hash

#: windows that can share an anchor; the q-grams are ``length - SPAN + 1`` bytes
SPAN = 31
ANCHOR_BITS, SEGMENT_BITS = 44, 48
BYTES_PER_SEGMENT = 14
#: pairs in a bucket, on average; a bucket takes about 200 bytes of memory for each
PAIRS = 500_000
ADDED = ("n_bytes", "n_removed", "spans", "kept")
SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("payload", pa.binary())])
SENT_SQL = "bucket int, block int, payload binary"
_PLACE_BITS = 24  # of a place within a piece, below the bits of a hash


def _pieces(texts: list[bytes], length: int):
    """Lists of (text, first byte, bytes) of about ``PIECE_BYTES``; a long text
    is cut into pieces that overlap so that each window is in one of them."""
    part, size = [], 0
    for k, text in enumerate(texts):
        for first in range(0, max(1, len(text) - length + 1), PIECE_BYTES):
            piece = text[first:first + PIECE_BYTES + length - 1]
            if len(piece) >= length:
                part.append((k, first, piece))
                size += len(piece)
            if size >= PIECE_BYTES:
                yield part
                part, size = [], 0
    if part:
        yield part


def _segments(part: list[tuple[int, int, bytes]], length: int):
    """(text, first byte, number of windows, anchor hash, segment hash) of the segments of some pieces."""
    span = min(SPAN, length)
    q = length - span + 1
    sizes = np.array([len(p) for _, _, p in part])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    buf = np.frombuffer(b"".join(p for _, _, p in part), np.uint8)
    prefix = prefix_hash(buf)
    grams = rolling_hash(prefix, q)
    least = (grams >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width < span:  # smallest of each run of ``span`` grams, the leftmost of equal ones
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    piece = np.repeat(np.arange(len(part)), sizes)
    inside = piece[:len(least)] == piece[length - 1:length - 1 + len(least)]
    anchor = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    anchor[~inside] = -1
    cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:len(anchor)] != piece[:len(anchor) - 1])]))
    end = np.append(cut[1:], len(anchor))
    real = anchor[cut] >= 0
    cut, end = cut[real], end[real]
    owner = piece[cut]
    text = np.array([k for k, _, _ in part])[owner]
    first = cut - starts[owner] + np.array([f for _, f, _ in part])[owner]
    named = mix(grams[anchor[cut]])  # scrambled anew: as smallest hashes they would all be in the first buckets
    return text, first, end - cut, named >> np.uint64(64 - ANCHOR_BITS), span_hash(prefix, cut, end + length - 1) >> np.uint64(64 - SEGMENT_BITS)


class _Block:
    """The segments of a block's documents (in order of id) and their distinct (anchor, segment) pairs."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, length: int):
        self.order, self.rank = id_ranks(table.column(id_col))
        texts = text_bytes(table.column(text_col).combine_chunks())
        self.texts = [texts[i] for i in self.order]
        known = [t if r >= 0 else b"" for t, r in zip(self.texts, self.rank)]
        found = [_segments(part, length) for part in _pieces(known, length)]
        empty = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
        self.text, self.first, self.windows, anchor, segment = (np.concatenate(x) for x in zip(*found)) if found else empty
        order = np.lexsort((segment, anchor))  # stable: of equal pairs, smaller ids first
        a, s = anchor[order], segment[order]
        new_a = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
        new = new_a | np.concatenate([[True], s[1:] != s[:-1]]) if len(a) else new_a
        heads = np.flatnonzero(new)
        self.anchor, self.segment = a[heads], s[heads]
        self.pair = np.empty(len(order), np.int64)  # of each segment
        self.pair[order] = np.cumsum(new) - 1
        self.head = order[heads]  # the first segment of each pair
        self.head_rank = self.rank[self.text[self.head]] if len(heads) else np.zeros(0, np.int64)
        # pairs whose anchor has other segments and other documents in this block
        group = np.cumsum(new_a[heads]) - 1 if len(heads) else np.zeros(0, np.int64)
        ranks = self.rank[self.text[order]] if len(order) else np.zeros(0, np.int64)
        at = np.flatnonzero(new_a)
        n_pairs = np.bincount(group) if len(group) else group
        mixed = np.minimum.reduceat(ranks, at) != np.maximum.reduceat(ranks, at) if len(at) else np.zeros(0, bool)
        self.contested = ((n_pairs > 1) & mixed)[group] if len(group) else np.zeros(0, bool)

    def content(self, pair: int, length: int) -> bytes:
        k = self.head[pair]
        return self.texts[self.text[k]][self.first[k]:self.first[k] + self.windows[k] + length - 1]


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([[r[i] for r in rows] for i in range(3)], schema=SENT)


def _ask(cols: tuple[str, str], length: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        b, block = _Block(table, *cols, length), table.column("_block")[0].as_py()
        out = []
        for bucket, i, j in slices(b.anchor << np.uint64(64 - ANCHOR_BITS), buckets):
            anchors = pack_sorted(b.anchor[i:j])
            out.append((bucket, block, len(anchors).to_bytes(4, "little") + anchors + pack(b.segment[i:j])))
        return _rows(out)
    return run


def _settle(table: pa.Table) -> pa.Table:
    """Two bits for each pair of one bucket: it stands in an earlier block; its
    anchor has other segments and other blocks."""
    table = table.sort_by("block")
    anchors, segments = [], []
    for p in table.column("payload").to_pylist():
        n = int.from_bytes(p[:4], "little")
        anchors.append(unpack_sorted(p[4:4 + n]))
        segments.append(unpack(p[4 + n:]))
    sizes = [len(x) for x in anchors]
    a, s, block = np.concatenate(anchors), np.concatenate(segments), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    del anchors, segments
    order = np.lexsort((s, a))
    a, s, block = a[order], s[order], block[order]
    new_a = np.concatenate([[True], a[1:] != a[:-1]])
    new = new_a | np.concatenate([[True], s[1:] != s[:-1]])
    group, at = np.cumsum(new_a) - 1, np.flatnonzero(new_a)
    n_segments = np.add.reduceat(new.astype(np.int64), at)
    spread = np.minimum.reduceat(block, at) != np.maximum.reduceat(block, at)
    bits = np.zeros((2, len(a)), bool)
    bits[0, order] = ~new
    bits[1, order] = ((n_segments > 1) & spread)[group]
    ends = np.cumsum([0, *sizes])
    replies = [zlib.compress(np.packbits(bits[:, i:j]).tobytes(), 1) for i, j in zip(ends[:-1], ends[1:])]
    return pa.table([table.column("bucket"), table.column("block"), pa.chunked_array([pa.array(replies, pa.binary())])], schema=SENT)


def _dispute(cols: tuple[str, str], length: int, buckets: int):
    """Sends the bytes of contested segments; the block's settled bits pass on, in a bucket of their own."""
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return SENT.empty_table()
        b, block = _Block(table, *cols, length), table.column("_block")[0].as_py()
        earlier, contested = np.zeros(len(b.anchor), bool), b.contested.copy()
        parts = slices(b.anchor << np.uint64(64 - ANCHOR_BITS), buckets)
        at = {k: (i, j) for k, i, j in parts}
        for bucket, reply in zip(replies.column("bucket").to_pylist(), replies.column("payload").to_pylist()):
            i, j = at[bucket]
            bits = np.unpackbits(np.frombuffer(zlib.decompress(reply), np.uint8), count=2 * (j - i)).reshape(2, -1)
            earlier[i:j] = bits[0]
            contested[i:j] |= bits[1].astype(bool)
        out = [(-1 - block, block, zlib.compress(np.packbits(earlier).tobytes(), 1))]
        ask = np.flatnonzero(contested & ~earlier)
        for bucket, i, j in parts:
            mine = ask[np.searchsorted(ask, i):np.searchsorted(ask, j)]
            if len(mine):
                body = b"".join([b.content(k, length) for k in mine.tolist()])
                arrays = [pack(mine - i), pack(b.head_rank[mine]), pack(b.windows[b.head[mine]])]
                head = b"".join(len(x).to_bytes(4, "little") for x in arrays)
                out.append((bucket, block, zlib.compress(head + b"".join(arrays) + body, 1)))
        return _rows(out)
    return run


def suffix_order(text: np.ndarray, start: np.ndarray, size: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``size`` bytes of ``text`` at ``start`` in the order of their
    bytes (equal ones by document), and the length of each one's common prefix
    with the suffix before it (0 for the first).  Eight bytes at a time, and each
    time only suffixes whose group of equal beginnings splits there are sorted."""
    n = len(start)
    order, common = np.arange(n), np.zeros(n, np.int64)
    if not n:
        return order, common
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray(len(text) + 1, ">u8", padded.data, strides=(1,))
    new = np.zeros(n, bool)
    new[0] = True
    for at in range(0, int(size.max()), 8):
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))  # places in groups of two or more
        if not len(tied):
            break
        ids = order[tied]
        left = np.clip(size[ids] - at, 0, 8)
        word = words[np.minimum(start[ids] + at, len(text))].astype(np.uint64)
        word &= np.where(left > 0, ~np.uint64(0) << (8 * np.minimum(8 - left, 7)).astype(np.uint64), np.uint64(0))
        heads = np.flatnonzero(new[tied])
        splits = np.minimum.reduceat(word, heads) != np.maximum.reduceat(word, heads)
        group = np.cumsum(new[tied]) - 1
        some = splits[group]
        places, ids, word, group = tied[some], ids[some], word[some], group[some]
        turn = np.lexsort((word, group))
        order[places], word = ids[turn], word[turn]
        cut = np.flatnonzero((group[1:] == group[:-1]) & (word[1:] != word[:-1])) + 1
        apart = word[cut] ^ word[cut - 1]
        same = sum((apart < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, 8))  # equal leading bytes
        new[places[cut]] = True
        common[places[cut]] = at + same
    group = np.cumsum(new) - 1
    order = order[np.lexsort((document[order], size[order], group))]
    least = np.minimum(size[order[1:]], size[order[:-1]])
    common[1:] = np.where(new[1:], np.minimum(common[1:], least), least)
    return order, common


def _reach_back(document: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place in suffix order, the common prefix with the previous place of
    a smaller document (0 without one): the least ``common`` on the way there.
    Places climb a tree of minima until a left neighbour's holds a smaller
    document, and walk down in it: 2 log n steps, most places need few."""
    n = len(document)
    trees = [(document, common)]
    while len(trees[-1][0]) > 1:
        d, c = (np.append(x, x[-1:]) if len(x) % 2 else x for x in trees[-1])  # a last copy has no right neighbour
        trees.append((np.minimum(d[0::2], d[1::2]), np.minimum(c[0::2], c[1::2])))
    low, found = common.copy(), np.zeros(n, np.int64)
    who = node = np.arange(n)
    down: list[tuple[np.ndarray, np.ndarray]] = []  # by level: places that walk down, and from which node
    for d, c in trees[:-1]:
        odd = node % 2 == 1
        beside = np.where(odd, node - 1, node)
        hit = odd & (d[beside] < document[who])
        down.append((who[hit], beside[hit]))
        passed = odd & ~hit
        low[who[passed]] = np.minimum(low[who[passed]], c[beside[passed]])
        on = ~hit & (node > 1) & (low[who] > 0)
        who, node = who[on], node[on] >> 1
    who = node = np.zeros(0, np.int64)
    for level in range(len(down) - 1, -1, -1):
        if len(who):  # from the nodes of the level above: right half first
            d, c = trees[level]
            right = 2 * node + 1
            right[right >= len(d)] -= 1
            hit = d[right] < document[who]
            low[who[~hit]] = np.minimum(low[who[~hit]], c[right[~hit]])
            node = np.where(hit, right, 2 * node)
        who, node = np.concatenate([who, down[level][0]]), np.concatenate([node, down[level][1]])
    found[who] = low[who]
    return found


def previous_factors(text: np.ndarray, start: np.ndarray, size: np.ndarray, document: np.ndarray) -> np.ndarray:
    """The longest-previous-factor array over documents: for each suffix (``size``
    bytes of ``text`` at ``start``) the longest beginning that a suffix of a smaller
    document shares.  In suffix order the nearest smaller documents before and
    after it share most, so two scans of nearest smaller values decide it."""
    order, common = suffix_order(text, start, size, document)
    owner = document[order]
    back = np.append(common[:1], common[:0:-1])  # the same prefixes, read from the other end
    lengths = np.empty(len(start), np.int64)
    lengths[order] = np.maximum(_reach_back(owner, common), _reach_back(owner[::-1], back)[::-1])
    return lengths


def _decide(length: int):
    """For each contested segment of one bucket, the windows that repeat, as bits."""
    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table.select(["bucket", "block", "payload"]).cast(SENT)
        index, document, windows, bodies, sizes = [], [], [], [], []
        for block, payload in zip(table.column("block").to_pylist(), table.column("payload").to_pylist()):
            data = zlib.decompress(payload)
            at, arrays = 12, []
            for k in range(3):
                n = int.from_bytes(data[4 * k:4 * k + 4], "little")
                arrays.append(unpack(data[at:at + n]).astype(np.int64))
                at += n
            index.append(arrays[0])
            document.append((block << 32) + arrays[1])
            windows.append(arrays[2])
            bodies.append(data[at:])
            sizes.append(len(arrays[0]))
        n = np.concatenate(windows)
        first = np.concatenate([[0], np.cumsum(n + length - 1)[:-1]])
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner = np.repeat(np.arange(len(n)), n)
        lengths = previous_factors(np.frombuffer(b"".join(bodies), np.uint8), first[owner] + offset, (n + length - 1)[owner] - offset,
                                   np.concatenate(document)[owner])
        reached = lengths >= length
        bits = np.bitwise_or.reduceat(reached.astype(np.uint64) << offset.astype(np.uint64), np.cumsum(n) - n)
        ends = np.cumsum([0, *sizes])
        replies = []
        for k, (i, j) in enumerate(zip(ends[:-1], ends[1:])):
            yes = np.flatnonzero(bits[i:j])
            places = pack(index[k][yes])
            replies.append(len(places).to_bytes(4, "little") + places + pack(bits[i:j][yes]))
        return pa.table([table.column("bucket"), table.column("block"), pa.chunked_array([pa.array(replies, pa.binary())])], schema=SENT)
    return run


def _cut(cols: tuple[str, str], length: int, buckets: int, out: pa.Schema):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out.empty_table()
        b = _Block(table, *cols, length)
        earlier, bits = np.zeros(len(b.anchor), bool), np.zeros(len(b.anchor), np.uint64)
        at = {k: i for k, i, _ in slices(b.anchor << np.uint64(64 - ANCHOR_BITS), buckets)}
        for bucket, reply in zip(replies.column("bucket").to_pylist(), replies.column("payload").to_pylist()):
            if bucket < 0:
                earlier = np.unpackbits(np.frombuffer(zlib.decompress(reply), np.uint8), count=len(b.anchor)).astype(bool)
            else:
                n = int.from_bytes(reply[:4], "little")
                bits[at[bucket] + unpack(reply[4:4 + n]).astype(np.int64)] = unpack(reply[4 + n:])
        whole = earlier[b.pair] | (b.rank[b.text] > b.head_rank[b.pair])
        runs: dict[int, list[np.ndarray]] = {}
        part = np.flatnonzero(~whole & (bits[b.pair] != 0))
        offset = np.arange(64, dtype=np.uint64)
        seg, bit = np.nonzero((bits[b.pair[part]][:, None] >> offset) & np.uint64(1))
        text = np.concatenate([b.text[whole], b.text[part][seg]])
        first = np.concatenate([b.first[whole], b.first[part][seg] + bit])
        end = np.concatenate([b.first[whole] + b.windows[whole], b.first[part][seg] + bit + 1]) + length - 1
        order = np.lexsort((first, text))
        text, first, end = text[order], first[order], end[order]
        for k, i, j in zip(*_groups(text)):
            runs[k] = _merge(first[i:j], end[i:j])
        n_removed, spans, kept = np.zeros(len(b.texts), np.int64), [], []
        for k, data in enumerate(b.texts):
            mine = runs.get(k)
            if mine is None:
                spans.append([])
                kept.append(data)
            else:
                n_removed[k] = (mine[:, 1] - mine[:, 0]).sum()
                spans.append(mine.tolist())
                edge = [0, *mine.ravel().tolist(), len(data)]
                kept.append(b"".join(data[edge[i]:edge[i + 1]] for i in range(0, len(edge), 2)))
        table = table.take(pa.array(b.order))
        made = {n: table.column(n) for n in table.column_names} | {
            "n_bytes": pa.array([len(t) for t in b.texts], pa.int64()), "n_removed": pa.array(n_removed),
            "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "kept": pa.array(kept, pa.binary())}
        return pa.table([made[f.name] for f in out], schema=out)
    return run


def _groups(values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(value, first, end) of the runs of sorted values."""
    if not len(values):
        return [], [], []
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[at].tolist(), at.tolist(), [*at[1:].tolist(), len(values)]


def _merge(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maximal runs of spans sorted by their first byte."""
    reach = np.maximum.accumulate(end)
    at = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]]))
    return np.stack([first[at], np.append(reach[at[1:] - 1], reach[-1])], axis=1)


@any_names
def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, carry: list[str] | None = None,
                   block_bytes: int = BLOCK_BYTES, bucket_keys: int = PAIRS) -> DataFrame:
    """The ``carry`` columns of ``docs`` (all by default) with ``n_bytes``,
    ``n_removed``, ``spans`` (maximal removed byte runs, [first, end)) and
    ``kept`` (the bytes left, binary: a cut may split a character).

    Texts are UTF-8 bytes (null: empty).  A byte goes when a ``length``-byte
    string over it also starts in a document of smaller id; strings are judged
    on the input and never cross documents.  Shorter texts lose nothing.  Rows
    of one id don't count as earlier for each other; rows with a null id are
    neither cut nor do they count as earlier.  Columns of ``docs`` with the
    added names are replaced.  ``length`` is at least 2.  Two segments of one
    anchor are one when their 48-bit hashes (besides the anchor's 44) are equal.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ADDED]
    cols = (id_col, text_col)
    layout = Layout(docs, id_col, text_col, BYTES_PER_SEGMENT, block_bytes, bucket_keys)
    blocks = docs.select(*dict.fromkeys([*carry, *cols]), layout.block(id_col).alias("_block"))
    asked = blocks.groupBy("_block").applyInArrow(_ask(cols, length, layout.buckets), SENT_SQL)
    settled = asked.groupBy("bucket").applyInArrow(_settle, SENT_SQL)
    disputed = blocks.groupBy("_block").cogroup(settled.groupBy("block")).applyInArrow(_dispute(cols, length, layout.buckets), SENT_SQL)
    decided = disputed.groupBy("bucket").applyInArrow(_decide(length), SENT_SQL)
    out = docs.select(*carry).schema
    for name, kind in zip(ADDED, (T.LongType(), T.LongType(), T.ArrayType(T.ArrayType(T.LongType())), T.BinaryType())):
        out = out.add(name, kind)
    return (blocks.groupBy("_block").cogroup(decided.groupBy("block"))
            .applyInArrow(_cut(cols, length, layout.buckets, to_arrow_schema(out)), out))
