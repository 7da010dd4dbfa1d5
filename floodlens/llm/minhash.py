"""Operator 8, MinHash near-dedup.

One-permutation hashing splits the hash range into bins and keeps each bin's
smallest shingle hash; empty bins copy a full one by optimal densification.
Bands of bins are bucket keys.  Equal shingle sets are one class.  In a bucket,
each class is compared with the smallest one only: a star of as many edges as
the bucket has members.  Stars settle most buckets; where one still holds
several components, its classes of different components are compared inside
tasks, in pairs of bounded blocks, so that no link of a bucket is lost and no
list of pairs is made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import per_batch, text_bytes
from .components import connected_components
from .hashing import batches, mix, prefix_hash, rolling_hash, span_hash, word_hashes

#: with 32 bands of 5 bins, a pair at 0.8 shares no bucket with a chance of 4e-6
BANDS, ROWS = 32, 5
#: classes in a block; a task compares two blocks
BLOCK = 512
#: candidate classes up to this many are broadcast to find their texts; more are joined by a shuffle
BROADCAST_NODES = 2_000_000
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles: ``width`` words in
    a row, A-Z lower-cased; with fewer words, all of them as one; without words, none."""
    out = []
    for first, end in batches(texts):
        hashes, counts = word_hashes([t.translate(LOWER_AZ) for t in texts[first:end]])
        stop = np.cumsum(counts)
        for n, e in zip(counts.tolist(), stop.tolist()):
            prefix = prefix_hash(hashes[e - n:e])
            out.append(np.unique(rolling_hash(prefix, width) if n >= width else span_hash(prefix, np.zeros(min(n, 1), np.int64), np.full(min(n, 1), n))))
    return out


def one_permutation(shingles: np.ndarray, bins: int) -> np.ndarray:
    """The smallest hash of each bin of a set that isn't empty; an empty bin
    copies the first full bin that its own sequence of hashes meets."""
    at = ((shingles >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    least, source = np.zeros(bins, np.uint64), np.full(bins, -1)
    least[at[head]] = shingles[head]
    source[at[head]] = at[head]
    full = source >= 0
    empty = np.flatnonzero(~full)
    attempt = 0
    while len(empty):
        probe = ((mix(empty.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(attempt + 1)) >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64)
        hit = full[probe]
        source[empty[hit]] = probe[hit]
        empty = empty[~hit]
        attempt += 1
    return least[source]


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key


def _node(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """(id, text_hash, n_shingles, node, keys): ``node`` names the shingle set (null without
    words), ``keys`` are the buckets of its bands."""
    def run(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(text_bytes(batch.column("text")), width)
        keys = [band_keys(one_permutation(s, bands * rows), bands).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys), pa.int64()))
        return {"id": batch.column("id"), "text_hash": batch.column("text_hash"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "node": pa.array([_node(s) if len(s) else None for s in sets], pa.int64()), "keys": lists}
    return (docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
            .mapInArrow(per_batch(run), "id bigint, text_hash bigint, n_shingles bigint, node bigint, keys array<bigint>"))


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, shingles) of the classes in ``nodes`` (id, node), from the text of the smallest id."""
    side = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes

    def run(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(text_bytes(batch.column("text")), width)
        return {"want": batch.column("node"), "node": pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                "shingles": pa.array([s.tobytes() for s in sets], pa.binary())}
    found = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(side, "id")
             .select("node", "text").mapInArrow(per_batch(run), "want bigint, node bigint, shingles binary"))
    return found.where("want = node").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _links(percent: int):
    """Links between the classes of a group: between sides 0 and 1, or all of
    side 2, where their parts differ; cut down to a forest."""
    def run(table: pa.Table) -> pa.Table:
        node, side, part = (table.column(c).to_numpy() for c in ("node", "side", "part"))
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets])
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        at = np.cumsum(size) - size
        root = np.arange(len(node))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x
        out = []
        flags = np.zeros(flat.max() + 1, bool)
        alone = side[0] == 2
        for a in np.flatnonzero(side != 1).tolist():
            other = np.arange(len(node)) > a if alone else side == 1
            close = 100 * np.minimum(size, size[a]) >= percent * np.maximum(size, size[a])  # else the union is too large
            meet = np.flatnonzero(other & close & (part != part[a]))
            if not len(meet):
                continue
            mine = flat[at[a]:at[a] + size[a]]
            flags[mine] = True
            if len(meet) * 4 < len(node):
                both = np.array([np.count_nonzero(flags[flat[at[b]:at[b] + size[b]]]) for b in meet])
            else:
                both = np.add.reduceat(flags[flat].astype(np.int64), at)[meet]
            flags[mine] = False
            for b in meet[100 * both >= percent * (size[a] + size[meet] - both)].tolist():
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((node[a], node[b]))
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})
    return run


def _compare(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) inside ``groups`` (bucket, i, j, node, side, part)."""
    return groups.join(sets, "node").groupBy("bucket", "i", "j").applyInArrow(_links(percent), "u bigint, v bigint")


def _star_groups(members: DataFrame) -> DataFrame:
    """Each class of a bucket against the smallest one, in groups of a centre and up to about ``BLOCK`` others."""
    stars = members.where("node <> least").groupBy("least", "node").agg(F.lit(0))
    several = stars.groupBy("least").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    hub = several.select(F.col("least").alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.lit(0).alias("j"),
                         F.col("least").alias("node"), F.lit(0).alias("side"), F.col("least").alias("part"))
    rim = stars.join(several, "least").select(F.col("least").alias("bucket"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("i"), F.lit(0).alias("j"),
                                              "node", F.lit(1).alias("side"), F.col("node").alias("part"))
    return hub.union(rim)


def _open_groups(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of blocks of the buckets of three classes or more that hold several
    components.  Classes of a bucket's largest component make blocks of their
    own, which meet the blocks of the rest only."""
    placed = (members.where("n > 2").join(roots, F.col("node") == F.col("u"), "left")
              .select("bucket", "node", F.coalesce("root", "node").alias("part")))
    parts = placed.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    shape = (parts.groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
             .select("bucket", F.col("most.part").alias("major"), F.ceil(F.col("most.n") / BLOCK).cast("int").alias("c"),
                     F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("r")))
    rows = placed.join(shape, "bucket")
    major = rows.where("part = major").select("bucket", "node", "part", "c", "r", F.pmod(F.xxhash64("node"), F.col("c")).cast("int").alias("i"))
    rest = rows.where("part <> major").select("bucket", "node", "part", "c", "r", (F.col("c") + F.pmod(F.xxhash64("node"), F.col("r"))).cast("int").alias("j"))
    meets_rest = major.select("bucket", "i", F.explode(F.sequence(F.col("c"), F.col("c") + F.col("r") - 1)).alias("j"), "node", F.lit(0).alias("side"), "part")
    meets_major = rest.select("bucket", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("i"), "j", "node", F.lit(1).alias("side"), "part")
    among = rest.select("bucket", "node", "part", "j", F.explode(F.sequence(F.col("c"), F.col("c") + F.col("r") - 1)).alias("k"))
    among = among.select("bucket", F.least("j", "k").alias("i"), F.greatest("j", "k").alias("j"), "node",
                         F.when(F.col("j") == F.col("k"), 2).when(F.col("j") < F.col("k"), 0).otherwise(1).alias("side"), "part")
    return meets_rest.union(meets_major).union(among)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(``id_col``, n_shingles, component_id, kept, text_hash), a row for each
    row of ``docs``; ``text_hash`` (xxhash64 of the text) tells rows of one id apart.

    Documents are linked when their sets of ``width``-word shingles have
    100 * intersection >= ``percent`` * union; candidates come from shared
    buckets, links are confirmed on the full sets of 64-bit shingle hashes.
    ``component_id`` is the smallest id that links reach, ``kept`` marks the
    row whose id that is.  Texts without words, null texts and rows of a null
    id are linked with nothing: their component is their own id, and they are
    kept.  Rows that repeat an id and a set are one class, and all are kept.
    """
    signed = materialize(signatures(docs, id_col, text_col, width, bands, rows), "signatures")
    known = signed.where("id IS NOT NULL AND node IS NOT NULL")
    classes = materialize(known.groupBy("node").agg(F.min("id").alias("id"), F.first("keys").alias("keys")), "classes")
    filled = classes.select("node", F.explode("keys").alias("key"))
    buckets = filled.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("hash")).where("n > 1")
    same = buckets.groupBy("n", "least", "hash").agg(F.min("key").alias("key"))  # buckets of the same classes are one
    members = materialize(filled.join(same, "key").select(F.col("key").alias("bucket"), "node", "n", "least"), "members")
    nodes = classes.select("node", "id").join(members.select("node").distinct(), "node", "left_semi")
    sets = materialize(_sets(docs, materialize(nodes, "nodes"), id_col, text_col, width), "sets")
    stars = materialize(_compare(_star_groups(members), sets, percent), "star-links")
    roots = connected_components(stars)
    more = materialize(_compare(_open_groups(members, roots), sets, percent), "more-links")
    if more.head(1):
        roots = connected_components(roots.select("u", F.col("root").alias("v")).union(more))
    placed = classes.select("node", "id").join(roots, F.col("node") == F.col("u"))
    smallest = (placed.select("root", "id").union(roots.select("root").distinct().join(classes, F.col("root") == F.col("node")).select("root", "id"))
                .groupBy("root").agg(F.min("id").alias("least")))
    moved = roots.join(smallest, "root").select(F.col("u").alias("node"), "least").union(smallest.select(F.col("root").alias("node"), "least"))
    own = classes.select(F.col("node").alias("own_node"), F.col("id").alias("own"))
    out = signed.drop("keys").join(moved, "node", "left").join(own, F.col("node") == F.col("own_node"), "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("bigint")).otherwise(F.coalesce("least", "own", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), "text_hash")
