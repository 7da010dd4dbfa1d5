"""Operators 11 and 12 against plain numpy."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodlens.llm import hard_negatives
from floodlens.llm.common import read
from floodlens.llm.hard_negatives import limit_of, mine_hard_negatives, product, strassen
from floodlens.llm.queries import QUERIES
from floodlens.llm.whitening import Fit, eigenpairs, polar, whiten

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------- whitening
def test_polar_factor_is_the_matrix_sign():
    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 40):
        a = rng.normal(size=(n, n))
        a = a + a.T
        values, vectors = np.linalg.eigh(a)
        assert np.allclose(polar(a), (vectors * np.sign(values)) @ vectors.T, atol=1e-10)


@pytest.mark.parametrize("a", [np.eye(5) * 3, np.zeros((4, 4)), np.ones((6, 6)), np.diag([1.0, 1, 2, 2, 2, 5]),
                               np.kron(np.eye(3), [[2.0, 1], [1, 2]]), np.diag(10.0 ** -np.arange(12)), np.array([[7.0]])])
def test_repeated_and_graded_eigenvalues(a):
    values, vectors = eigenpairs(a)
    size = max(np.linalg.norm(a), 1e-300)
    assert (np.diff(values) <= 0).all()
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * size


def test_random_covariance():
    x = np.random.default_rng(2).normal(size=(300, 64))
    a = np.cov(x.T, bias=True)
    values, vectors = eigenpairs(a)
    want, basis = np.linalg.eigh(a)
    assert np.allclose(values, want[::-1], rtol=1e-12)
    assert np.allclose(np.abs((vectors * basis[:, ::-1]).sum(0)), 1, atol=1e-10)


def plain_whitening(vectors):
    """{id: [(deviation, whitened, explained), ...]} by numpy's eigh, up to sign."""
    good = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), np.int64)
    n, sums = len(fit), fit.sum(0)
    covariance = np.cov((fit - sums / n).T, bias=True)
    values, basis = np.linalg.eigh(covariance)
    values, basis = values[::-1][:16], basis[:, ::-1][:, :16]
    out = []
    for i, x in good:
        x = np.array(x)
        out.append((i, n, int(((n * x - sums).astype(object) ** 2).sum()), (x - sums / n) @ basis / np.sqrt(values), values / np.trace(covariance)))
    return out


def check_whitening(out, vectors):
    rows, want = defaultdict(list), plain_whitening(vectors)
    for r in out:
        rows[r.vec_id].append(r)
    assert len(out) == 16 * len(want)
    signs = None
    for i, n, deviation, white, explained in want:
        mine = sorted(rows[i], key=lambda r: r.component)[:: len(rows[i]) // 16]
        assert [r.component for r in mine] == list(range(1, 17))
        assert {(r.n, r.deviation) for r in mine} == {(n, deviation)}
        got = np.array([r.whitened for r in mine])
        signs = np.sign(got * white) if signs is None else signs
        assert np.allclose(got, white * signs, atol=1e-8)
        assert np.allclose([r.explained for r in mine], explained, rtol=1e-9)
    assert max(r.identity_error for r in out) < 1e-9


def test_whitening_query(spark):
    vectors = [(r.vec_id, r.embedding) for r in read(spark, SF, "embeddings").collect()]
    check_whitening(QUERIES["op11_whitening"](spark, SF).collect(), vectors)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 20)).tolist()
    rows = [(k, v) for k, v in enumerate(base)] + [(100, base[3]), (100, base[3]), (101, None), (102, [None] * 20), (103, [math.nan] + base[0][1:]),
                                                   (104, [math.inf] + base[0][1:]), (105, base[4])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, component int, `a.b` string")
    check_whitening(whiten(df).collect(), rows)


def test_whitening_of_few_empty_and_uneven_vectors(spark):
    kind = "vec_id string, embedding array<float>"
    assert whiten(spark.createDataFrame([], kind)).collect() == []
    assert whiten(spark.createDataFrame([("a", []), ("b", None), ("c", [1.0, 2.0]), ("d", [1.0, 2.0])], kind)).collect() == []  # one distinct vector
    out = whiten(spark.createDataFrame([("a", [0.0, 1.0]), ("b", [0.0, 2.0]), (None, [0.0, 3.0]), ("d", [1.0]), ("e", [3.0]), ("f", [1e300])], kind.replace("float", "double"))).collect()
    pair = {r.vec_id: r for r in out if r.n == 3 and r.vec_id not in ("d", "e", "f")}
    assert set(pair) == {"a", "b", None} and {r.component for r in out} == {1}  # the other direction has no spread
    assert abs(abs(pair["a"].whitened) - math.sqrt(1.5)) < 1e-12 and abs(pair["b"].whitened) < 1e-12 and pair["b"].explained == 1.0
    assert {r.vec_id for r in out} == {"a", "b", None, "d", "e", "f"}


def test_deviation_beyond_63_bits():
    fit = Fit(1 << 31, [5 << 31])
    assert fit.deviation(np.array([[5], [6], [9]])) == [0, 1 << 62, None]
    assert Fit(3, [10]).deviation(np.array([[2], [4]])) == [16, 4]


# --------------------------------------------------------- hard negatives
@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 0, 4), (17, 33, 65), (100, 64, 130), (64, 64, 64), (1, 200, 90)])
def test_strassen_is_exact(shape):
    n, k, m = shape
    rng = np.random.default_rng(n)
    a, b = rng.integers(-limit_of(k), limit_of(k) + 1, (n, k)), rng.integers(-limit_of(k), limit_of(k) + 1, (k, m))
    want = (a.astype(object) @ b.astype(object)) if k else np.zeros((n, m), object)
    for leaf in (8, 64):
        assert (strassen(a, b, leaf) == want).all()
    assert (product(a, b.T, tile=7) == want).all()


def plain_mining(rows, is_anchor):
    rows = [(i, label, [math.floor(256 * float(c)) for c in v]) for i, v, label in rows
            if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out, seen = [], set()
    for i, label, x in rows:
        if not is_anchor(i) or (i, label, tuple(x)) in seen:
            continue
        seen.add((i, label, tuple(x)))
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, other) for j, other, y in rows if j != i)
        for s, j, _ in [t for t in scored if t[2] == label][:5]:
            fit = [t for t in scored if t[2] != label and -30 * s <= -100 * t[0] <= -90 * s]
            out += [(i, j, k, t[1], -s, -t[0]) for k, t in enumerate(fit[:10], 1)]
    return sorted(out)


def test_mining_query(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.label is not None and r.vec_id % 7 == 0 else r.label) for r in read(spark, SF, "embeddings").collect()]
    out = QUERIES["op12_hard_negatives"](spark, SF)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, out.collect())) == plain_mining(rows, lambda i: i % 100 == 0)


def test_mining_of_odd_rows_in_small_blocks(spark, monkeypatch):
    """Ties, repeated rows and anchors, nulls, uneven lengths, clashing names, many small cells."""
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 4)
    monkeypatch.setattr(hard_negatives, "CANDIDATE_ROWS", 9)
    monkeypatch.setattr(hard_negatives, "CANDIDATE_BLOCKS", 2)
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(c) for c in rng.integers(-2, 4, rng.choice([3, 4]))], int(rng.integers(0, 3))) for i in rng.permutation(120)]
    rows += rows[:7] + [rows[0]] * 30 + [(5, [1.0, 2.0], 1), (500, None, 1), (500, [1.0], None), (None, [1.0], 1), (510, [math.nan], 2), (520, [None, 1.0], 2), (530, [], 1), (540, [3e-3, 1e3], 0)]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "vec_id long, embedding array<double>, label int, anchor int, `a.b` int").repartition(3)
    out = mine_hard_negatives(df, F.col("vec_id") % 10 == 0)
    want = plain_mining(rows, lambda i: i % 10 == 0)
    assert len(want) > 300 and sorted(map(tuple, out.collect())) == want
    assert mine_hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert mine_hard_negatives(df, F.col("vec_id") < 0).collect() == []


def test_huge_components_are_held_within_the_limit(spark):
    rows = [(0, [1e300, 1.0], 1), (1, [1e300, 0.0], 1), (2, [2e6, 0.0], 2)]
    out = mine_hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0).collect()
    limit = limit_of(2)
    assert limit * limit * 2 < 1 << 63
    assert [tuple(r) for r in out] == [(0, 1, 1, 2, limit * limit, 512_000_000 * limit)]
