"""Operator 1 against plain counting and a plain forward recursion."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodlens.llm import hmm
from floodlens.llm.common import read
from floodlens.llm.hmm import Model, Words, expected_counts, log_likelihood
from floodlens.llm.queries import QUERIES


def words_of(text):
    return (text or "").encode().translate(hmm.LOWER_AZ).split() + [None]


def brute_base(rows, held):
    counts = Counter(w for d, t in rows if not held(d) for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    return n, [(d, held(d), len(words_of(t)), sum(counts[w] > 0 for w in words_of(t)),
                sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words_of(t))) for d, t in rows]


def forward(sequence, model):
    p = model.start * model.emit[sequence[0]]
    for s in sequence[1:]:
        p = (p @ model.move) * model.emit[s]
    return math.log10(p.sum())


def some_model(states, symbols, seed=1):
    rng = np.random.default_rng(seed)
    emit = rng.random((symbols, states))
    move = rng.random((states, states))
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def test_forward_is_exact():
    model, rng = some_model(3, 5), np.random.default_rng(4)
    sequences = sorted((rng.integers(0, 5, rng.integers(1, 40)) for _ in range(30)), key=len, reverse=True)
    assert np.allclose(log_likelihood(sequences, model), [forward(s, model) for s in sequences])
    # probabilities of all sequences of one length add up to 1
    every = [np.array([a, b, c]) for a in range(5) for b in range(5) for c in range(5)]
    assert math.isclose(sum(10 ** log_likelihood(every, model)), 1)


def test_expected_counts_against_enumeration():
    model = some_model(2, 3)
    sequences = [np.array([0, 2, 1, 1]), np.array([1, 0]), np.array([2])]
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    for s in sequences:
        paths = [[(k >> t) & 1 for t in range(len(s))] for k in range(2 ** len(s))]
        weight = [model.start[p[0]] * math.prod(model.move[a, b] for a, b in zip(p, p[1:])) * math.prod(model.emit[o, q] for o, q in zip(s, p)) for p in paths]
        for p, w in zip(paths, np.array(weight) / sum(weight)):
            start[p[0]] += w
            for a, b in zip(p, p[1:]):
                move[a, b] += w
            for o, q in zip(s, p):
                emit[o, q] += w
    for got, want in zip(expected_counts(sequences, model), (start, move, emit)):
        assert np.allclose(got, want, atol=1e-5)


@pytest.mark.parametrize("size", [1, 7, 1_024])
def test_pieces_add_up_to_whole_texts(size):
    """Texts cut anywhere teach what they teach whole: initial states, transitions over the cuts, emissions."""
    model, rng = some_model(4, 9), np.random.default_rng(2)
    texts = [rng.integers(0, 9, n) for n in ((5_000, 3, 1_024, 1_025, 1, 2_500) if size > 100 else (40, 1, 7, 8, 15))]
    whole = expected_counts(sorted(texts, key=len, reverse=True), model)
    pieces, before, after = hmm.pieces_of(texts, model, size)
    assert max(map(len, pieces)) <= size and sum(map(len, pieces)) == sum(map(len, texts))
    order = sorted(range(len(pieces)), key=lambda k: -len(pieces[k]))
    cut = expected_counts([pieces[k] for k in order], model, before[order], after[order])
    for got, want in zip(cut, whole):
        assert np.allclose(got, want, rtol=1e-4, atol=1e-4)
    assert math.isclose(cut[0].sum(), len(texts), rel_tol=1e-4) and math.isclose(cut[1].sum(), sum(len(t) - 1 for t in texts), rel_tol=1e-4)


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(0)
    sequences = sorted((np.repeat(rng.integers(0, 2), 30) * 3 + rng.integers(0, 3, 30) for _ in range(60)), key=len, reverse=True)
    counts = np.bincount(np.concatenate(sequences), minlength=6)
    words = Words(int(counts.sum()), 5, np.arange(5, dtype=np.uint64), counts[1:])
    model, last = Model.first(words, 2), -np.inf
    for _ in range(12):
        now = log_likelihood(sequences, model).sum()
        assert now > last - 1e-6 * abs(now) - 2
        last = now
        model = Model.from_counts(*expected_counts(sequences, model), words)
    share = math.log10(1 / 6) * 30 * 60
    assert last > share + 300  # two kinds of text: half the symbols each


@pytest.fixture(scope="module")
def rows():
    long = " ".join(f"w{k % 37}" for k in range(5000))
    return [(1, "The the THE cat"), (2, "a b a b a b"), (3, None), (4, ""), (5, "  \n\t "), (6, long), (6, "the the"), (7, "É é É"), (7, "É é É"),
            (None, "no id"), (10, "unseen words here"), (11, "cat a the")]


def test_frame_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(d, t, 3.5) for d, t in rows], "doc_id bigint, text string, score double")
    held = lambda d: d == 10
    got = hmm.score_texts(docs, F.col("doc_id") == 10, rounds=2, share=0.05).collect()
    n, want = brute_base(rows, held)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got), key=repr) == sorted(((*w[:4], round(w[4], 6)) for w in want), key=repr)
    assert {r.train_tokens for r in got} == {n} and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert len({r.score for r in got if r.text == "É é É"}) == 1


def test_nothing_to_learn_from(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = hmm.score_texts(docs, F.lit(True)).collect()
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {0} and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert hmm.score_texts(docs.limit(0), F.lit(False)).count() == 0


def test_query_counts_and_beats_the_base(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in read(spark, sf, "documents", "doc_id", "text").collect()]
    got = {r.doc_id: r for r in QUERIES["op1_hmm"](spark, sf).collect()}
    n, want = brute_base(rows, lambda d: zlib.crc32(str(d).encode()) % 10 == 0)
    for d, held, tokens, known, base in want:
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, n) and math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
