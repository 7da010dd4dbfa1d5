"""Operator 2, embedding near-dedup over a robust-pruned flat graph.

Vectors are dealt into overlapping shards, around the centroids of a bounded
sample; the one of its best centroid is its home, where it is no guest.  Two
vectors in range are both in the home of one of them, so that only the home of
a vector builds its list and searches for it: work is a list and a search a
vector, in however many shards it is a guest.  A list has the nearest candidates
of the shard, pruned so that an edge is dropped where a kept neighbour is much
closer to its end; reverse edges, pruned alike where there are many, go to
guests too.  A vector's lists are united over its shards.  Every vector then
searches the graph from its own vertex, expanding each vertex in range until no
new one turns up.  All pairs of vectors that were found together are verified
in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import per_batch
from .components import connected_components

#: places in a shard on average were each vector in OVERLAP of them, at most in a slice of one on average, shards that a vector is in at least
SHARD, SLICE, OVERLAP = 2_048, 4_096, 3
#: standard deviations of a pair's offset across two centroids that shards overlap by
DEVIATIONS = 3.5
#: vectors that centroids are fitted on, at most about; centroids at most; rounds
SAMPLE, MAX_CENTROIDS, ROUNDS = 16_384, 4_096, 5
#: edges of a vertex in one shard, candidates for them (nearest and random), pruning slack
DEGREE, NEAREST, RANDOM, SLACK = 24, 64, 32, 1.2
#: vertices that a search from medoids keeps, entry vertices, queries searched at a time
BEAM, ENTRIES, QUERIES = 40, 32, 1_024
#: vertices out of range that a search from its own vertex expands, pairs verified at a time
STRAYS, PAIRS = 4, 1 << 21
#: the float32 search keeps what is this little below the threshold, for the exact check
MARGIN = 1e-4


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, count: int, apart: float) -> np.ndarray:
    """Spherical k-means; centroids more alike than ``apart`` are one, so that
    a tight group isn't split between them."""
    def spread(candidates: np.ndarray, most: int) -> np.ndarray:
        kept = candidates[:1]
        for c in candidates[1:]:
            if len(kept) == most:
                break
            if (kept @ c).max() < apart:
                kept = np.vstack([kept, c])
        return kept
    centres = spread(sample, count)
    for _ in range(ROUNDS):
        owner = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), centres)
    return spread(centres, count)


def overlap_reach(sample: np.ndarray, threshold: float) -> float:
    """How far behind its best centroid, as a share of the distance between the
    two, another may be for a vector to be in its shard too.

    Vectors of cosine ``threshold`` are ``sqrt(2 - 2 threshold)`` apart.  If
    each is only in the other shards, their difference, taken along the line
    between their best centroids, is more than twice the reach; half their
    distance so is a reach that loses no pair.  Along one line it takes
    ``1 / sqrt(d)`` of a difference's length on average, where d is the number
    of dimensions that the sample fills: ``DEVIATIONS`` of that are enough, and
    with few dimensions the reach is the whole half."""
    spread = np.linalg.eigvalsh((sample.T @ sample).astype(float) / len(sample))
    filled = spread.sum() ** 2 / (spread ** 2).sum()
    return float(np.sqrt(max(0.0, 1 - threshold) / 2) * min(1.0, DEVIATIONS / np.sqrt(filled)))


def shards_of(x: np.ndarray, centres: np.ndarray, reach: float) -> list[list[int]]:
    """The shards of each vector: of its ``OVERLAP`` nearest centroids, and of all within ``reach``."""
    alike = x @ centres.T
    best = alike.argmax(axis=1)
    square = (centres ** 2).sum(axis=1)
    apart = np.sqrt(np.maximum(0, square[best][:, None] + square - 2 * centres[best] @ centres.T))
    inside = alike[np.arange(len(x)), best][:, None] - alike <= reach * apart + 1e-6
    np.put_along_axis(inside, np.argsort(-alike, axis=1, kind="stable")[:, :OVERLAP], True, axis=1)
    return [np.flatnonzero(row).tolist() for row in inside]


def prune(x: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, whose: np.ndarray | None = None) -> np.ndarray:
    """Robust pruning of the candidates (a row each, padded by -1) of every vertex,
    or of the vertices ``whose``: the nearest one left is kept, and those that are
    ``SLACK`` times closer to it than to the vertex go.  Rows of ``degree``, padded
    by -1."""
    whose = np.arange(len(candidates)) if whose is None else whose
    out = np.full((len(candidates), degree), -1, np.int64)
    for at in range(0, len(candidates) if candidates.shape[1] else 0, 512):
        rows = candidates[at:at + 512]
        me = whose[at:at + 512]
        points = x[rows]
        far = np.maximum(0, 2 - 2 * np.einsum("ncd,nd->nc", points, x[me]))
        far[(rows < 0) | (rows == me[:, None])] = np.inf
        lines = np.arange(len(rows))
        for k in range(degree):
            best = far.argmin(axis=1)
            some = np.isfinite(far[lines, best])
            if not some.any():
                break
            picked = np.where(some, rows[lines, best], -1)
            out[at:at + len(rows), k] = picked
            between = np.maximum(0, 2 - 2 * np.einsum("ncd,nd->nc", points, points[lines, best]))
            far[(SLACK ** 2 * between <= far) & some[:, None]] = np.inf
            far[lines, best] = np.inf
    return out


def build_graph(x: np.ndarray, seed: int = 0, own: int | None = None) -> np.ndarray:
    """Adjacency rows (padded by -1) of the pruned graph of unit vectors.  With
    ``own``, only so many first vertices look for neighbours, among all; the
    others have the reverse edges."""
    n, own = len(x), len(x) if own is None else own
    rng = np.random.default_rng(seed)
    near, far = min(NEAREST, n - 1), min(RANDOM, n - 1)
    candidates = np.full((own, near + far), -1, np.int64)
    for at in range(0, own, 512):
        alike = x[at:min(at + 512, own)] @ x.T
        alike[np.arange(len(alike)), np.arange(at, at + len(alike))] = -9
        if near:
            candidates[at:at + 512, :near] = np.argpartition(-alike, near - 1, axis=1)[:, :near]
    candidates[:, near:] = rng.integers(0, n, (own, far))
    first = np.full((n, DEGREE), -1, np.int64)
    first[:own] = prune(x, candidates)
    u, k = np.nonzero(first >= 0)
    v = first[u, k]
    order = np.lexsort((rng.random(len(v)), v))
    u, v = u[order], v[order]
    turn = np.arange(len(v)) - np.searchsorted(v, v)
    back = np.full((n, 2 * NEAREST), -1, np.int64)
    some = turn < back.shape[1]
    back[v[some], turn[some]] = u[some]
    both, most = np.hstack([first, back]), DEGREE + DEGREE // 2
    out = -np.sort(-both, axis=1)[:, :most]
    many = np.flatnonzero((both >= 0).sum(axis=1) > most)
    out[many] = prune(x, both[many], most, many)
    return out


def entry_points(x: np.ndarray) -> np.ndarray:
    """The medoid (the vertex nearest to the mean), and the vertices farthest from those chosen so far."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    alike = x @ x[chosen[0]]
    for _ in range(min(ENTRIES, len(x)) - 1):
        chosen.append(int(alike.argmin()))
        alike = np.maximum(alike, x @ x[chosen[-1]])
    return np.unique(chosen)


def range_search(queries: np.ndarray, x: np.ndarray, graph: np.ndarray, entries: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of queries, and for each the vertices of cosine ``least`` or more
    that greedy search from ``entries`` meets, as a mask: each step expands a
    query's best vertex that isn't expanded yet, of its beam of ``BEAM`` or in
    range; it ends when none is left."""
    n = len(x)
    graph = np.where(graph < 0, n, graph)
    for at in range(0, len(queries), QUERIES):
        q = queries[at:at + QUERIES]
        alike = np.full((len(q), n + 1), -9, np.float32)  # of vertices met
        alike[:, entries] = q @ x[entries].T
        waiting = alike.copy()  # of those not expanded yet
        floor = np.full(len(q), -9, np.float32)
        active, step = np.arange(len(q)), 0
        while True:
            best = waiting[active].argmax(axis=1)
            value = waiting[active, best]
            go = (value > -9) & ((value >= least) | (value >= floor[active]))
            active, best = active[go], best[go]
            if not len(active):
                break
            waiting[active, best] = -9
            around = graph[best]
            lines, flat = np.repeat(active, around.shape[1]), around.ravel()
            new = (flat < n) & (alike[lines, flat] == -9)
            lines, flat = lines[new], flat[new]
            met = np.einsum("ij,ij->i", q[lines], x[flat])
            alike[lines, flat] = met
            waiting[lines, flat] = met
            step += 1
            if step % 8 == 0 and n > BEAM:  # the worst of the beam; an older one only lets more through
                floor[active] = -np.partition(-alike[active, :n], BEAM - 1, axis=1)[:, BEAM - 1]
        yield np.arange(at, at + len(q)), alike[:, :n] >= least


def own_search(asking: np.ndarray, x: np.ndarray, ends: np.ndarray, around: np.ndarray, entries: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of ``asking``, vertices of the graph, and for each the vertices of
    cosine ``least`` or more that a search from it and ``entries`` meets, as a
    mask.  The search expands the vertex itself, the ``STRAYS`` best that it meets
    then, and all in range.  Vertex v's list is ``around[ends[v]:ends[v + 1]]``."""
    n = len(x)
    for at in range(0, len(asking), QUERIES):
        me = asking[at:at + QUERIES]
        q = x[me]
        alike = np.full((len(me), n), -9, np.float32)  # of vertices met
        alike[:, entries] = q @ x[entries].T
        alike[np.arange(len(me)), me] = 1
        line, which = np.nonzero(alike[:, entries] >= least)
        waiting = [(line, entries[which]), (np.arange(len(me)), me)]
        itself = True
        while waiting:
            lines, front = waiting.pop()
            if len(lines) > QUERIES:
                waiting.append((lines[QUERIES:], front[QUERIES:]))
                lines, front = lines[:QUERIES], front[:QUERIES]
            many = ends[front + 1] - ends[front]
            flat = around[np.repeat(ends[front] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            lines = np.repeat(lines, many)
            new = alike[lines, flat] == -9
            lines, flat = np.divmod(np.unique(lines[new] * n + flat[new]), n)
            met = np.einsum("ij,ij->i", q[lines], x[flat])
            alike[lines, flat] = met
            go = met >= least
            if itself:
                order = np.lexsort((-met, lines))
                go[order[np.arange(len(order)) - np.searchsorted(lines, lines) < STRAYS]] = True
                itself = False
            if go.any():
                waiting.append((lines[go], flat[go]))
        yield me, alike >= least


def unite(root: np.ndarray, rows: np.ndarray, cols: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Components (the smallest vertex of each) after links between ``rows`` and ``cols``, a mask."""
    u, v = np.nonzero(linked)
    u, v = rows[u], cols[v]
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    data = column.combine_chunks()
    return data.flatten().to_numpy().reshape(len(data), -1)


def _counted(table: pa.Table, shard: int):
    """Which pairs are counted in ``shard``, as a mask: of those in a home of
    either, those whose smallest such shard this is."""
    home, lists = table.column("home").to_numpy(), table.column("homes").combine_chunks()
    mine = home == shard
    names = np.unique(home)
    place = np.searchsorted(names, home)
    row, at = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    known = np.isin(at, names)
    member = np.zeros((len(home), len(names)), bool)
    member[row[known], np.searchsorted(names, at[known])] = True

    def mask(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        mine_row, mine_col = mine[rows][:, None], mine[cols]
        guest_col = mine_row & ((home[cols] > shard) | ~member[rows][:, place[cols]])
        guest_row = mine_col & ((home[rows] > shard)[:, None] | ~member[cols][:, place[rows]].T)
        return np.where(mine_row & mine_col, True, np.where(mine_row, guest_col, guest_row))
    return mask


def _build(table: pa.Table) -> pa.Table:
    """The lists of the vectors that are at home in a slice of a shard, or in two, and reverse edges."""
    node, mine = table.column("node").to_numpy(), table.column("home").to_numpy() == table.column("shard")[0].as_py()
    order = np.lexsort((node, ~mine))
    node = node[order]
    graph = build_graph(_matrix(table.column("vector"))[order].astype(np.float32), own=int(mine.sum()))
    many = (graph >= 0).sum(axis=1)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), pa.array(node[graph[graph >= 0]], pa.int64()))
    some = pa.array(many > 0)
    return pa.table({"node": pa.array(node), "around": lists}).filter(some)


def _lists(column: pa.ChunkedArray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, around) of the lists, cut to the vertices in ``node``, as their places."""
    lists = column.combine_chunks()
    row, to = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    order = np.argsort(node)
    at = order[np.minimum(np.searchsorted(node[order], to), len(node) - 1)]
    here = node[at] == to
    return np.append(0, np.cumsum(np.bincount(row[here], minlength=len(node)))), at[here]


def _search(threshold: float):
    """Links found inside one slice of a shard, or between two, by the vectors
    at home there: a row a vector with the rows linked to it (a pair counts in
    one shard), and a row a link of a forest of them."""
    def run(table: pa.Table) -> pa.Table:
        shard, i, j = (table.column(c)[0].as_py() for c in ("shard", "i", "j"))
        table = table.sort_by([("slice", "ascending"), ("node", "ascending")])
        node, part, copies = (table.column(c).to_numpy() for c in ("node", "slice", "copies"))
        exact = _matrix(table.column("vector"))
        x = exact.astype(np.float32)
        every = np.arange(len(node))
        near, asking = every.copy(), np.flatnonzero(table.column("home").to_numpy() == shard)
        for rows, found in own_search(asking, x, *_lists(table.column("around"), node), entry_points(x), threshold - MARGIN) if len(asking) else ():
            near = unite(near, rows, every, found)
        counted = _counted(table, shard)
        links, root = np.zeros(len(node)), every.copy()
        order = np.argsort(near, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(near[order])) + 1):
            step = max(1, min(QUERIES, PAIRS // len(group)))
            for at in range(0, len(group) if len(group) > 1 else 0, step):  # all pairs of what was found together, exactly
                rows = group[at:at + step]
                linked = exact[rows] @ exact[group].T >= threshold
                linked &= (rows[:, None] != group) & ((part[rows][:, None] != part[group]) | (i == j))
                root = unite(root, rows, group, linked)
                links[rows] += (linked & counted(rows, group)) @ copies[group].astype(float)
        some = np.flatnonzero((links > 0) | (root != every))
        return pa.table({"node": pa.array(node[some]), "root": pa.array(node[root[some]]), "links": pa.array(links[some].astype(np.int64))})
    return run


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their class, classes): equal vectors are one class, called
    node; vectors that can't be compared have none."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("vector"))
    sound = "id IS NOT NULL AND size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(vector, x -> x <> 0)"
    rows = rows.select("id", "vector", F.when(F.expr(f"coalesce({sound}, false)"), F.xxhash64(F.col("vector"), F.size("vector"))).alias("node"))
    classes = (rows.where("node IS NOT NULL").groupBy("node")
               .agg(F.first("vector").alias("vector"), F.min("id").alias("least"), F.count("*").alias("copies")))
    return rows.select("id", "node"), classes


def _directions(vectors: list[list[float]]) -> np.ndarray:
    x = np.array(vectors)
    return unit(x / np.abs(x).max(axis=1, keepdims=True))  # no overflow, no underflow to zero


def _normal(batch: pa.RecordBatch) -> dict:
    """The vectors of one length as directions."""
    out = _directions(batch.column("vector").to_pylist())
    return {n: batch.column(n) for n in batch.schema.names} | {"vector": pa.array(list(out), pa.list_(pa.float64()))}


def _assigner(broadcast):
    def assign(batch: pa.RecordBatch) -> dict:
        x = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)
        x = x.astype(np.float32)
        homes, home = shards_of(x, *broadcast.value), (x @ broadcast.value[0].T).argmax(axis=1)
        return {n: batch.column(n) for n in batch.schema.names} | {"homes": pa.array(homes, pa.list_(pa.int32())), "home": pa.array(home, pa.int32())}
    return assign


def _shards(spark: SparkSession, classes: DataFrame, threshold: float) -> DataFrame:
    """Classes of one dimension with the shards that each is in, and its home."""
    n = classes.count()
    draw = F.xxhash64("node", F.lit("sample"))
    sample = classes if n <= SAMPLE else classes.where(F.shiftrightunsigned(draw, 1) < F.lit(int(SAMPLE / n * (1 << 63))).cast("long"))
    drawn = sample.select("vector", draw.alias("draw"), "node").collect()
    drawn = np.array([r.vector for r in sorted(drawn, key=lambda r: (r.draw, r.node))], np.float32)
    centres = fit_centroids(drawn, max(1, min(MAX_CENTROIDS, -(-n * OVERLAP // SHARD))), threshold)
    shared = spark.sparkContext.broadcast((centres, overlap_reach(drawn, threshold)))
    return classes.mapInArrow(per_batch(_assigner(shared)), classes.withColumns({"homes": F.array().cast("array<int>"), "home": F.lit(0)}).schema)


def _dealt(placed: DataFrame, size: DataFrame) -> DataFrame:
    """Each vector in all of its shards, once for each pair of slices, ``i`` and ``j``, that its own is one of."""
    at = placed.withColumn("shard", F.explode("homes")).join(size, "shard").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    at = at.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return at.withColumns({"i": F.least("slice", "k"), "j": F.greatest("slice", "k")}).drop("slices", "k")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(``id_col``, n_links, component_id, kept), a row for each row of ``vectors``.

    Two vectors are linked when their cosine, in double precision, is
    ``threshold`` or more and the graph search of either meets the other;
    none is linked below it.  ``n_links`` counts other rows linked directly,
    ``component_id`` is the smallest id that links reach, ``kept`` marks the
    rows of that id.  Null, empty and zero vectors, vectors with null or
    non-finite components, and rows of a null id are linked with nothing and
    kept; vectors of different lengths aren't compared.  Rows of equal vectors
    are searched once and count each.
    """
    spark = vectors.sparkSession
    rows, classes = _classes(vectors, id_col, vector_col)
    classes = materialize(classes, "vectors")
    found = None
    for r in classes.groupBy(F.size("vector").alias("d")).agg(F.count("*")).orderBy("d").collect():
        alike = classes.where(F.size("vector") == r.d).mapInArrow(per_batch(_normal), classes.schema)
        placed = materialize(_shards(spark, materialize(alike, "unit-vectors"), threshold), "shards")
        size = placed.select(F.explode("homes").alias("shard")).groupBy("shard").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
        lists = _dealt(placed.select("node", "homes", "home", F.col("vector").cast("array<float>").alias("vector")), size).drop("homes", "slice")
        lists = lists.groupBy("shard", "i", "j").applyInArrow(_build, "node bigint, around array<bigint>")
        graph = materialize(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("around"))).alias("around")), "graph")
        pairs = _dealt(placed.join(graph, "node", "left").withColumn("around", F.coalesce("around", F.array().cast("array<bigint>"))), size)
        links = pairs.groupBy("shard", "i", "j").applyInArrow(_search(threshold), "node bigint, root bigint, links bigint")
        found = links if found is None else found.union(links)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialize(found, "vector-links")
    roots = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    info = classes.select("node", "least", "copies").join(counts, "node", "left").join(roots, F.col("node") == F.col("u"), "left")
    info = info.select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    smallest = info.groupBy("root").agg(F.min("least").alias("component"))
    info = info.join(smallest, "root").select("node", "n_links", "component")
    out = rows.join(info, "node", "left").select(F.col("id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def audit_recall(vectors: DataFrame, result: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, every: int = 100) -> DataFrame:
    """(links, found, recall) over the rows whose id is divisible by ``every``:
    their links by brute force, in blocks, against the ``n_links`` of ``result``."""
    rows, classes = _classes(vectors, id_col, vector_col)
    full = rows.join(classes.select("node", "vector"), "node").select("id", "vector")
    parts = max(1, -(-full.count() // SLICE))
    spread = full.select(F.col("vector").alias("x"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("block"))
    asked = full.where(F.col("id") % every == 0).select("vector", F.pmod(F.xxhash64("id"), F.lit(-(-parts // every))).cast("int").alias("part"),
                                                        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("at"))
    asked = asked.groupBy("part", "at").agg(F.collect_list("vector").alias("queries"))  # of about SLICE queries at most

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        n, base = 0, right.column("x").to_pylist()
        for queries in left.column("queries").to_pylist():
            for d in {len(v) for v in queries}:
                same = [v for v in base if len(v) == d]
                if same:
                    n += int((_directions([v for v in queries if len(v) == d]) @ _directions(same).T >= threshold).sum())
        return pa.table({"links": pa.array([n], pa.int64())})
    true = asked.groupBy("at").cogroup(spread.groupBy("block")).applyInArrow(count, "links bigint")
    alone = full.where(F.col("id") % every == 0).agg(F.count("*").alias("itself"))
    found = result.where(F.col(id_col) % every == 0).agg(F.sum("n_links").alias("found"))
    both = true.agg(F.sum("links").alias("links")).join(alone).join(found)
    return both.select((F.col("links") - F.col("itself")).alias("links"), "found").withColumn("recall", F.expr("if(links > 0, found / links, 1.0)"))
