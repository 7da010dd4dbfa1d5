"""Operator 1, LM scoring by a hidden Markov model over words.

A first exchange between blocks of documents and buckets of words counts every
word of the training documents; each block learns the counts of its own words.
Words above a share of all tokens are the model's symbols (their number is
bounded by that share), all others one rare symbol, whose probability is
shared out by smoothed counts.  Baum-Welch runs over the training documents:
tasks sum the expected counts of their documents, Spark adds them up.  Scores
come from the scaled forward recursion over whole texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize
from .common import any_names, text_bytes
from .exchange import Layout, pack, pack_sorted, slices, unpack, unpack_sorted
from .hashing import batches, word_hashes

LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END = np.uint64(0x5A5A0E4D0F70C3A1)  # the key of the token that ends each text
SMOOTH = 0.1
#: states, Baum-Welch rounds, the least share of all tokens of a symbol (so there are at most 1 / SHARE of them)
STATES, ROUNDS, SHARE = 8, 6, 4e-6
#: training runs the pieces of longer texts side by side, of this many tokens each, with the states that their neighbours hand over
PIECE = 1_024
#: tokens that a task runs through the model together, and symbols of one row of added counts
TOKENS, CHUNK = 1_000_000, 4_096
#: of a block's text, and keys of a bucket
BLOCK_BYTES, BUCKET_KEYS, BYTES_PER_KEY = 8 << 20, 500_000, 60
SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("payload", pa.binary())])


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key of each token of all texts in turn, tokens of each text): words, then one end."""
    keys, counts = [], []
    for first, end in batches(texts):
        words, n = word_hashes([t.translate(LOWER_AZ) for t in texts[first:end]])
        keys.append(np.insert(words, np.cumsum(n), END))
        counts.append(n + 1)
    return (np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _block_words(table: pa.Table, text_col: str):
    keys, counts = _tokens(text_bytes(table.column(text_col).combine_chunks()))
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, place, counts


def _ask(text_col: str, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        distinct, place, counts = _block_words(table, text_col)
        learn = np.repeat(~table.column("_held").to_numpy(), counts)
        n = np.bincount(place[learn], minlength=len(distinct)).astype(np.uint64)
        block, rows = table.column("_block")[0].as_py(), []
        for b, i, j in slices(distinct, buckets):
            keys = pack_sorted(distinct[i:j])
            rows.append((b, block, len(keys).to_bytes(4, "little") + keys + pack(n[i:j])))
        return pa.table([[r[k] for r in rows] for k in range(3)], schema=SENT)
    return run


def _count(table: pa.Table) -> pa.Table:
    """The training counts of each block's words of one bucket, and (as block -1) of all of them."""
    keys, counts = [], []
    for p in table.column("payload").to_pylist():
        n = int.from_bytes(p[:4], "little")
        keys.append(unpack_sorted(p[4:4 + n]))
        counts.append(unpack(p[4 + n:]))
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts).astype(float)).astype(np.uint64)
    ends = np.cumsum([0, *map(len, keys)])
    replies = [pack(total[place[i:j]]) for i, j in zip(ends[:-1], ends[1:])]
    some = total > 0
    body = pack_sorted(distinct[some])
    replies.append(len(body).to_bytes(4, "little") + body + (pack(total[some]) if some.any() else b""))
    bucket = table.column("bucket")[0].as_py()
    return pa.table([[bucket] * len(replies), [*table.column("block").to_pylist(), -1], replies], schema=SENT)


def _vocabulary(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(payload[:4], "little")
    return unpack_sorted(payload[4:4 + n]), unpack(payload[4 + n:]) if n else np.zeros(0, np.uint64)


class Words:
    """Totals of the training tokens, and the model's symbols: 0 for rare words, then words by their keys."""

    def __init__(self, tokens: int, distinct: int, keys: np.ndarray, counts: np.ndarray):
        self.tokens, self.distinct = tokens, distinct
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order].astype(float)
        self.rare_tokens = tokens - self.counts.sum()
        self.rare_words = distinct - len(keys)

    def symbols(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at + 1, 0)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + SMOOTH) / (self.tokens + SMOOTH * (self.distinct + 1)))

    def rare(self, counts: np.ndarray) -> np.ndarray:
        """log10 of a rare word's share of the rare symbol; unseen words share one more place."""
        return np.log10((counts + SMOOTH) / (self.rare_tokens + SMOOTH * (self.rare_words + 1)))


def _read(text_col: str, buckets: int, words, out: pa.Schema):
    """Each text as symbols, with its counts, base score and the log probability of its rare words within their symbol."""
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out.empty_table()
        w = words.value
        distinct, place, n = _block_words(table, text_col)
        at = {b: i for b, i, _ in slices(distinct, buckets)}
        counts = np.zeros(len(distinct))
        for bucket, reply in zip(replies.column("bucket").to_pylist(), replies.column("payload").to_pylist()):
            got = unpack(reply)
            counts[at[bucket]:at[bucket] + len(got)] = got
        symbol = w.symbols(distinct)
        rare = np.where(symbol == 0, w.rare(counts), 0.0)
        start = np.cumsum(n) - n
        add = lambda values: np.add.reduceat(values[place], start)
        body = symbol.astype(np.uint16 if len(w.keys) < 65_535 else np.uint32)[place]
        made = {c: table.column(c) for c in table.column_names} | {
            "n_tokens": pa.array(n), "n_known": pa.array(add((counts > 0).astype(np.int64))), "base_score": pa.array(add(w.base(counts))),
            "_rare": pa.array(add(rare)), "_symbols": pa.array([body[i:i + k].tobytes() for i, k in zip(start, n)], pa.binary())}
        return pa.table([made[f.name] for f in out], schema=out)
    return run


class Model:
    """Initial, transition and emission probabilities; ``emit`` has a row a symbol."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, words: Words, states: int) -> Model:
        """Sticky states whose emissions are the words' shares, scattered by a fixed seed."""
        share = np.concatenate([[words.rare_tokens + SMOOTH * (words.rare_words + 1)], words.counts + SMOOTH])
        emit = share[:, None] * np.random.default_rng(7).gamma(2.0, size=(len(share), states))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, words: Words) -> Model:
        """Smoothed towards the words' own shares, so that no symbol is impossible."""
        share = np.concatenate([[words.rare_tokens + SMOOTH * (words.rare_words + 1)], words.counts + SMOOTH])
        emit = emit + SMOOTH * len(share) * (share / share.sum())[:, None]
        start, move = start + SMOOTH, move + SMOOTH
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _by_time(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols by time, then by sequence; sequences left at each time) of sequences, the longest first."""
    sizes = np.array([len(s) for s in sequences])
    flat = np.concatenate(sequences).astype(np.int64)
    time = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return flat[np.argsort(time, kind="stable")], np.bincount(time)


def log_likelihood(sequences: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 probability of each sequence, by the scaled forward recursion; the longest first."""
    symbols, left = _by_time(sequences)
    out, at = np.zeros(len(sequences)), 0
    state = np.repeat(model.start[None], len(sequences), axis=0)
    for t, m in enumerate(left.tolist()):
        state = (state[:m] @ model.move if t else state[:m]) * model.emit[symbols[at:at + m]]
        scale = state.sum(axis=1)
        state /= scale[:, None]
        out[:m] += np.log10(scale)
        at += m
    return out


def expected_counts(sequences: list[np.ndarray], model: Model, before: np.ndarray | None = None,
                    after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected initial states, transitions and emissions (a row a symbol) of sequences, the longest first.

    A sequence that goes on with a text has the state of the token before it
    in ``before`` (zeros: it starts a text), and one that is gone on with the
    backward message to its last token in ``after`` (ones: it ends a text)."""
    symbols, left = _by_time(sequences)
    ends = np.cumsum(left)
    states, count = len(model.start), len(sequences)
    move, emit = model.move.astype(np.float32), model.emit.astype(np.float32)
    before = np.zeros((count, states), np.float32) if before is None else before.astype(np.float32)
    after = np.ones((count, states), np.float32) if after is None else after.astype(np.float32)
    starts = ~before.any(axis=1)
    forward, scales = np.empty((len(symbols), states), np.float32), np.empty((len(symbols), 1), np.float32)
    state = np.where(starts[:, None], model.start.astype(np.float32), before @ move)
    at = 0
    for t, m in enumerate(left.tolist()):
        state = (state[:m] @ move if t else state[:m]) * emit[symbols[at:at + m]]
        scales[at:at + m, 0] = state.sum(axis=1)
        state /= scales[at:at + m]
        forward[at:at + m] = state
        at += m
    moves = np.zeros((states, states))
    back = np.ones((0, states), np.float32)
    for t in range(len(left) - 1, -1, -1):
        m, at = left[t], ends[t] - left[t]
        here = forward[at:at + m]
        if len(back) < m:  # sequences whose last token is here
            last = after[len(back):m]
            back = np.vstack([back, last / (here[len(back):] * last).sum(axis=1, keepdims=True)])
        ahead = back * emit[symbols[at:at + m]] / scales[at:at + m]
        earlier = forward[at - left[t - 1]:at - left[t - 1] + m] if t else before
        moves += earlier.T @ ahead
        here *= back
        back = ahead @ move.T
    emits = np.stack([np.bincount(symbols, forward[:, s], len(model.emit)) for s in range(states)], axis=1)
    return forward[:left[0]][starts].sum(axis=0, dtype=float), moves * model.move, emits


def _passages(sequences: list[np.ndarray], first: np.ndarray, model: Model) -> np.ndarray:
    """For each sequence, the longest first, the matrix (up to a factor) that takes the
    state before it to the state of its last token; ``first`` ones take the initial state."""
    symbols, left = _by_time(sequences)
    out = np.where(first[:, None, None], np.eye(len(model.start)), model.move) * model.emit[symbols[:left[0]]][:, None, :]
    at = int(left[0])
    for m in left[1:].tolist():
        out[:m] = (out[:m] @ model.move) * model.emit[symbols[at:at + m]][:, None, :]
        out[:m] /= out[:m].sum(axis=(1, 2), keepdims=True)
        at += m
    return out


def pieces_of(texts: list[np.ndarray], model: Model, size: int = PIECE) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(pieces of at most ``size`` tokens, their ``before`` and ``after``) of texts.

    The matrices of all pieces are built side by side; the states at the cuts
    follow from them along each text, so the expected counts of the pieces add
    up to those of the whole texts."""
    cuts = [range(0, len(s), size) for s in texts]
    pieces = [s[i:i + size] for s, cut in zip(texts, cuts) for i in cut]
    before, after = np.zeros((len(pieces), len(model.start))), np.ones((len(pieces), len(model.start)))
    ends = np.cumsum([len(c) for c in cuts], dtype=np.int64)
    firsts = np.isin(np.arange(len(pieces)), ends - [len(c) for c in cuts])
    several = [k for end, cut in zip(ends.tolist(), cuts) if len(cut) > 1 for k in range(end - len(cut), end)]
    passage = {}
    for run in _runs([pieces[k] for k in several]):
        chosen = [several[k] for k in run]
        passage.update(zip(chosen, _passages([pieces[k] for k in chosen], firsts[chosen], model)))
    for end, cut in zip(ends.tolist(), cuts):
        begin, state = end - len(cut), model.start
        for k in range(begin + 1, end):
            state = state @ passage[k - 1]
            before[k] = state = state / state.sum()
        for k in range(end - 1, begin, -1):
            message = passage[k] @ after[k]
            after[k - 1] = message / message.sum()
    return pieces, before, after


def _sequences(column: pa.Array, wide: bool) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint32 if wide else np.uint16) for b in column.to_pylist()]


def _runs(sequences: list[np.ndarray]):
    """Lists of positions, the longest sequences first, of about ``TOKENS`` tokens together."""
    part, size = [], 0
    for k in sorted(range(len(sequences)), key=lambda k: -len(sequences[k])):
        if part and size + len(sequences[k]) > TOKENS:
            yield part
            part, size = [], 0
        part.append(k)
        size += len(sequences[k])
    if part:
        yield part


def _expect(shared, wide: bool):
    def run(parts):
        model = shared.value
        states = len(model.start)
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit)
        for batch in parts:
            whole = _sequences(batch.column("_symbols"), wide)
            pieces, before, after = pieces_of(whole, model)
            for chosen in _runs(pieces):
                a, b, c = expected_counts([pieces[k] for k in chosen], model, before[chosen], after[chosen])
                start += a
                move += b
                emit += c
        rows = [np.vstack([start, move]), *(emit[i:i + CHUNK] for i in range(0, len(emit), CHUNK))]
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(-1, len(rows) - 1), pa.int32()), "counts": pa.array([r.tobytes() for r in rows], pa.binary())})
    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c) for c in table.column("counts").to_pylist())
    return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def train(coded: DataFrame, words: Words, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the rows of ``coded`` that aren't held out."""
    spark = coded.sparkSession
    model = Model.first(words, states)
    wide = len(words.keys) >= 65_535
    learn = coded.where("NOT _held").select("_symbols")
    for _ in range(rounds):
        sums = (learn.mapInArrow(_expect(spark.sparkContext.broadcast(model), wide), "part int, counts binary")
                .groupBy("part").applyInArrow(_add, "part int, counts binary").collect())
        got = [np.frombuffer(r.counts).reshape(-1, states) for r in sorted(sums, key=lambda r: r.part)]
        if not got:
            break
        model = Model.from_counts(got[0][0], got[0][1:], np.vstack(got[1:]), words)
    return model


@any_names
def score_texts(docs: DataFrame, held_out: Column, text_col: str = "text", id_col: str = "doc_id", carry: list[str] | None = None,
                states: int = STATES, rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """The ``carry`` columns of ``docs`` (all by default) with ``held_out``,
    ``n_tokens``, ``n_known`` (tokens met in training), ``train_tokens``,
    ``base_score`` (log10 under smoothed word shares) and ``score`` (log10
    under the hidden Markov model) of every whole text.

    Tokens are runs of bytes other than ASCII white space, A-Z lower-cased, and
    one end; null texts are empty and have the end only.  Rows where
    ``held_out`` is true teach nothing; null counts as false.  Repeated rows
    count and are scored each.  Columns of ``docs`` with the added names are
    replaced.  Words are told apart by 64-bit hashes.  If every row is held
    out, the model has one symbol and unseen words only.
    """
    spark = docs.sparkSession
    added = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in added]
    layout = Layout(docs, id_col, text_col, BYTES_PER_KEY, BLOCK_BYTES, BUCKET_KEYS)
    blocks = docs.select(*dict.fromkeys([*carry, text_col]), F.coalesce(held_out, F.lit(False)).alias("_held"), layout.block(id_col).alias("_block"))
    asked = blocks.groupBy("_block").applyInArrow(_ask(text_col, layout.buckets), "bucket int, block int, payload binary")
    counted = materialize(asked.groupBy("bucket").applyInArrow(_count, "bucket int, block int, payload binary"), "word-counts")

    def sums(parts):
        for batch in parts:
            found = [_vocabulary(p)[1] for p in batch.column("payload").to_pylist()]
            yield pa.RecordBatch.from_pydict({"tokens": pa.array([int(c.sum()) for c in found], pa.int64()), "words": pa.array([len(c) for c in found], pa.int64())})
    everything = counted.where("block = -1")
    total = everything.mapInArrow(sums, "tokens bigint, words bigint").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).first()
    tokens, distinct = total.tokens or 0, total.words or 0
    least = max(1, math.ceil(share * tokens))

    def frequent(parts):
        for batch in parts:
            for p in batch.column("payload").to_pylist():
                keys, counts = _vocabulary(p)
                some = counts >= least
                yield pa.RecordBatch.from_pydict({"keys": pa.array([keys[some].tobytes()], pa.binary()), "counts": pa.array([counts[some].tobytes()], pa.binary())})
    top = everything.mapInArrow(frequent, "keys binary, counts binary").collect()
    words = Words(tokens, distinct, np.frombuffer(b"".join(r["keys"] for r in top), np.uint64), np.frombuffer(b"".join(r["counts"] for r in top), np.uint64))

    coded = docs.select(*carry).withColumns({"_held": F.lit(True), "n_tokens": F.lit(0).cast("long"), "n_known": F.lit(0).cast("long"), "base_score": F.lit(0.0),
                                             "_rare": F.lit(0.0), "_symbols": F.lit(b"")}).schema
    replies = counted.where("block >= 0")
    coded = materialize(blocks.groupBy("_block").cogroup(replies.groupBy("block"))
                        .applyInArrow(_read(text_col, layout.buckets, spark.sparkContext.broadcast(words), to_arrow_schema(coded)), coded), "symbols")
    shared = spark.sparkContext.broadcast(train(coded, words, states, rounds))
    wide = len(words.keys) >= 65_535

    def score(parts):
        for batch in parts:
            sequences = _sequences(batch.column("_symbols"), wide)
            out = batch.column("_rare").to_numpy().copy()
            for chosen in _runs(sequences):
                out[chosen] += log_likelihood([sequences[k] for k in chosen], shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), batch.column("_held"), batch.column("n_tokens"), batch.column("n_known"),
                                              pa.array(np.full(len(out), tokens)), batch.column("base_score"), pa.array(out)], [*carry, *added])
    result = coded.select(*carry, F.col("_held").alias("held_out"), "n_tokens", "n_known", F.lit(0).cast("long").alias("train_tokens"), "base_score", F.lit(0.0).alias("score")).schema
    return coded.mapInArrow(score, result)
