"""Operators 2 and 8 and their components against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from floodlens.llm import flat_graph, minhash
from floodlens.llm.common import read
from floodlens.llm.components import connected_components
from floodlens.llm.flat_graph import audit_recall, build_graph, entry_points, prune, range_search, unite
from floodlens.llm.minhash import near_duplicates, one_permutation
from floodlens.llm.queries import QUERIES


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_connected_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)]
    rng.shuffle(links)
    rows = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in links] + [(7, 7), (None, 3), (160, 100)]
    got = {r.u: r.root for r in connected_components(spark.createDataFrame(rows, "u bigint, v bigint")).collect()}
    want = components(1300, links)
    assert got == {k: r for k, r in enumerate(want) if k != r}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def brute_documents(rows, width, percent):
    sets = []
    for _, text in rows:
        words = (text or "").encode().translate(minhash.LOWER_AZ).split()
        sets.append({tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = components(len(rows), links)
    least = {}
    for k, r in enumerate(root):
        if rows[k][0] is not None:
            least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    out = [(rows[k][0], len(sets[k]), least[r] if rows[k][0] is not None else None) for k, r in enumerate(root)]
    return sorted(((d, n, c, d is None or d == c) for d, n, c in out), key=repr)


def edited(rng, words, share):
    return [rng.choice("xyzuvw") * rng.randint(1, 3) if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(300)]
    rows += [(k, " ".join(edited(rng, base, rng.random() * 0.04))) for k in rng.sample(range(1000, 3000), 90)]  # many pairs about the threshold
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for k in range(30):  # a chain whose ends share little
        chain[6 * k:6 * k + 6] = [rng.choice(vocabulary) for _ in range(6)]
        rows.append((k, " ".join(chain)))
    rows += [(200 + k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))) for k in range(60)]
    rows += [(400, "one two"), (401, "ONE  two\n"), (402, "one two three"), (403, None), (404, ""), (405, " \n"), (403, "same id, other text than null"), (406, "É a b c d"), (407, "é a b c d")]
    rows += [(None, rows[0][1]), (None, None), rows[5], (rows[6][0], "another text of this id, with nothing like it")]
    rows += [(5000 - k, rows[3][1]) for k in range(20)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_documents_against_brute_force(spark, texts, width, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)  # buckets are split into several blocks
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in texts], "doc_id bigint, text string, node int, keys int")
    got = near_duplicates(docs, width=width).drop("text_hash")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_documents(texts, width, 80)


def test_no_documents(spark):
    for rows in ([], [(1, None), (2, "")]):
        got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        assert [(r.doc_id, r.component_id, r.kept) for r in sorted(got)] == [(d, d, True) for d, _ in rows]


def test_densification_estimates_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for size in (12, 60, 400):
        for _ in range(20):
            union = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            a, b = np.unique(union[: int(size * 0.9)]), np.unique(union[int(size * 0.1):])
            errors.append((one_permutation(a, 160) == one_permutation(b, 160)).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.03


def brute_vectors(rows, threshold):
    sound = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a in sound:
        for b in sound:
            if a > b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                x, y = x / abs(x).max(), y / abs(y).max()
                if x @ y >= threshold * np.sqrt(x @ x) * np.sqrt(y @ y):
                    links.append((a, b))
    root = components(len(rows), links)
    least, n = {}, [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    for k, r in enumerate(root):
        if rows[k][0] is not None:
            least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    return sorted(((i, n[k], None if i is None else least[root[k]], i is None or least[root[k]] == i) for k, (i, _) in enumerate(rows)), key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 24))
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(700) + 10, base[rng.integers(0, 40, 700)] + rng.normal(size=(700, 24)) * rng.random((700, 1)) * 0.6)]
    rows += [(2000 + k, (np.array(rows[0][1]) * (k + 1)).tolist()) for k in range(5)] + [(3000 + k, rows[1][1]) for k in range(30)]
    rows += [(1, None), (2, []), (3, [0.0] * 24), (4, [None] + [1.0] * 23), (5, [float("nan")] + [1.0] * 23), (6, [float("inf")] + [1.0] * 23), (7, [1.0, 2.0]), (8, [2.0, 4.1]),
             (None, rows[1][1]), (9, [1e300] * 24), (9, [1e-300] * 24), rows[4]]
    return rows


@pytest.mark.parametrize("shard,piece", [(2_048, 4_096), (300, 64)])
def test_vectors_against_brute_force(spark, vectors, shard, piece, monkeypatch):
    monkeypatch.setattr(flat_graph, "SHARD", shard)
    monkeypatch.setattr(flat_graph, "SLICE", piece)
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id bigint, embedding array<double>, node int, label string")
    got = flat_graph.near_duplicates(table)
    want = brute_vectors(vectors, 0.9)
    rows = sorted(map(tuple, got.collect()), key=repr)
    if shard == 2_048:
        assert rows == want
    by_id = {w[0]: w[1] for w in want}
    assert all(r[1] <= by_id[r[0]] for r in rows if r[0] not in (None, 9))  # none linked below the threshold
    assert audit_recall(table, got, every=1).first().recall >= 0.9


def pairs_apart(n, cosine, size=64, seed=4):
    """``n`` pairs of the given cosine, of directions without any order."""
    rng = np.random.default_rng(seed)
    x, u = flat_graph.unit(rng.normal(size=(n, size))), rng.normal(size=(n, size))
    u = flat_graph.unit(u - (u * x).sum(axis=1, keepdims=True) * x)
    return x, cosine * x + np.sqrt(1 - cosine ** 2) * u


@pytest.mark.parametrize("count", [76, 1024])
def test_pairs_at_the_threshold_share_a_shard(count):
    sample = flat_graph.unit(np.random.default_rng(6).normal(size=(8192, 64))).astype(np.float32)
    centres, reach = flat_graph.fit_centroids(sample, count, 0.9), flat_graph.overlap_reach(sample, 0.9)
    x, y = (flat_graph.shards_of(v.astype(np.float32), centres, reach) for v in pairs_apart(2000, 0.9))
    assert sum(bool(set(a) & set(b)) for a, b in zip(x, y)) >= 1998
    flat = np.zeros((8192, 64), np.float32)  # three dimensions only: the reach that loses no pair
    flat[:, :3] = sample[:, :3]
    assert flat_graph.overlap_reach(flat_graph.unit(flat), 0.9) == pytest.approx(np.sqrt(0.05))


def test_pairs_are_linked_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(flat_graph, "SHARD", 64)
    x, y = pairs_apart(2500, 0.901)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.vstack([x, y]))], "vec_id bigint, embedding array<double>")
    got = audit_recall(table, flat_graph.near_duplicates(table), every=1).first()
    assert got.links == 5000 and got.recall >= 0.995


def test_a_vector_is_searched_for_once_in_however_many_shards(monkeypatch):
    """Lists and searches are one a vector; every pair is in a home of either."""
    x, y = (v.astype(np.float32) for v in pairs_apart(2000, 0.9))
    centres, reach = flat_graph.fit_centroids(x, 76, 0.9), flat_graph.overlap_reach(x, 0.9)
    (a, b), (p, q) = (flat_graph.shards_of(v, centres, reach) for v in (x, y)), ((v @ centres.T).argmax(axis=1) for v in (x, y))
    assert sum(q[k] in a[k] or p[k] in b[k] for k in range(2000)) >= 1998 and sum(map(len, a)) > 6000
    asked = []
    search = flat_graph.own_search
    monkeypatch.setattr(flat_graph, "own_search", lambda asking, *rest: asked.append(len(asking)) or search(asking, *rest))
    for shard in range(len(centres)):
        here = [(v, m, h) for v, m, h in zip([*x, *y], a + b, [*p, *q]) if shard in m]
        n = len(here)
        if n:
            cut = pa.table({"shard": pa.array([shard] * n), "node": pa.array(range(n)), "home": pa.array([int(h) for _, _, h in here]), "vector": pa.array([v.tolist() for v, _, _ in here])})
            lists = {r["node"]: r["around"] for r in flat_graph._build(cut).to_pylist()}
            cut = cut.append_column("homes", pa.array([m for _, m, _ in here])).append_column("around", pa.array([lists.get(k, []) for k in range(n)], pa.list_(pa.int64())))
            for c in ("i", "j", "slice", "copies"):
                cut = cut.append_column(c, pa.array([int(c == "copies")] * n))
            flat_graph._search(0.9)(cut)
    assert sum(asked) == 4000


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert flat_graph.near_duplicates(none).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id bigint, embedding array<float>")
    assert sorted(map(tuple, flat_graph.near_duplicates(odd).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_graph_search_recall_and_degree():
    rng = np.random.default_rng(8)
    x = flat_graph.unit(np.vstack([rng.normal(size=(1500, 32)), np.repeat(rng.normal(size=(30, 32)), 20, axis=0) + rng.normal(size=(600, 32)) * 0.1])).astype(np.float32)
    graph = build_graph(x)
    assert graph.shape[1] <= flat_graph.DEGREE * 3 // 2 and prune(x, np.full((len(x), 4), -1)).max() == -1
    found = np.zeros((len(x), len(x)), bool)
    for rows, mask in range_search(x, x, graph, entry_points(x), 0.9):
        found[rows] = mask
    true = x @ x.T >= 0.9
    assert found.sum() / true.sum() > 0.95 and not (found & ~(x @ x.T >= 0.899)).any()


def test_unite():
    links = np.zeros((5, 5), bool)
    links[3, 4] = links[1, 3] = True
    assert unite(np.arange(5), np.arange(5), np.arange(5), links).tolist() == [0, 1, 2, 1, 1]


def test_queries_over_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in read(spark, sf, "documents", "doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op8_minhash"](spark, sf).collect()), key=repr) == brute_documents(rows, 4, 80)
    rows = [(r.vec_id, r.embedding) for r in read(spark, sf, "embeddings", "vec_id", "embedding").collect()]
    assert sorted(map(tuple, QUERIES["op2_flat_graph"](spark, sf).collect()), key=repr) == brute_vectors(rows, 0.9)
