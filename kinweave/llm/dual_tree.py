"""Centroid clustering by dual-tree Lloyd rounds on vectors of integers.

Vectors are dealt to blocks of BLOCK rows; a task makes a cover tree of each block once, and blocks with their trees
are kept in the shared folder. In each round the centroids get a tree too, and the two trees are walked together: a
pair (node of vectors, node of centroids) is left out where its least distance exceeds the greatest that any vector of
the node can have to its nearest centroid. A node for which one centroid is left gives its sum at once; only pairs of
leaves are compared vector by vector, in exact integers. A round returns a count and a sum for each centroid, added up in
the task before they move.

A tree is the greedy permutation of its block: each next centre is the point farthest from all before it, at distance s;
its level is floor(log2 s). The centres of a level and those above are more than that level's scale apart and cover all
points within twice of it; a centre's parent is the nearest one of a higher level. Every other point hangs at its nearest centre.

Defined results: vectors that are null, have another number of components or hold one that is null, NaN or infinite are
left out. Repeated rows are vectors of their own. A row without a key is clustered, but never a first centroid. Of equal
keys the lesser vector comes first. Fewer vectors than centroids asked for: as many centroids. Ties go to the smaller
number. A component of more than LARGEST in size is an error, as squared distances would not fit a long. Other columns
aren't read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import kept, tidy

#: Vectors of one tree: what a task holds at a time.
BLOCK = 4_096
#: Points for which a tree has one centre.
BUCKET = 16
#: Greatest size of a component (as integer): 64 squares of twice of it are less than 2^63.
LARGEST = 1 << 27
#: Sums of products below it are exact in doubles.
EXACT = float(1 << 52)
#: What rounding of roots may add to a bound, relative and absolute.
SLACK = 1e-9


@dataclass
class Tree:
    """Nodes in the order of their centres' choice. A node's points stand from ``begin`` to ``end``, those nearest to its own centre (its bucket) up to ``own``. Children of node i are ``child[first[i]:first[i + 1]]``."""

    points: np.ndarray  # in the tree's order
    order: np.ndarray  # their places in the input
    begin: np.ndarray
    own: np.ndarray
    end: np.ndarray
    radius: np.ndarray  # of all points of a node, around its first point, the centre
    own_radius: np.ndarray
    first: np.ndarray
    child: np.ndarray


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, pair by pair or to one."""
    d = x.astype(np.int64) - y
    return np.einsum("ij,ij->i", d, d)


def cover_tree(points: np.ndarray, bucket: int = BUCKET) -> Tree:
    """The tree of integer points (one at least)."""
    n = len(points)
    wide = points.astype(np.float64)
    most = max(1, -(-n // bucket))
    # Greedy permutation; equal distances choose the first point.
    centres, reach, parents = [0], [], [-1]
    near, owner = squares(points, points[0]), np.zeros(n, np.int64)
    while len(centres) < most:
        far = int(np.argmax(near))
        if near[far] == 0:
            break
        centres.append(far)
        reach.append(near[far])
        there = wide - wide[far]
        d = np.einsum("ij,ij->i", there, there)
        d = d.astype(np.int64) if d.max(initial=0.0) < EXACT else squares(points, points[far])
        closer = d < near
        near[closer], owner[closer] = d[closer], len(centres) - 1
    level = np.floor(np.log2(np.array(reach, np.float64)) / 2).astype(np.int64) if reach else np.empty(0, np.int64)
    at = points[centres].astype(np.float64)
    for k in range(1, len(centres)):
        above = 1 + int(np.searchsorted(-level, -level[k - 1], "left"))  # the root, and all of higher levels
        there = at[:above] - at[k]
        parents.append(int(np.argmin(np.einsum("ij,ij->i", there, there))))
    parent = np.array(parents)
    m = len(centres)
    child = np.argsort(parent[1:], kind="stable") + 1
    first = np.searchsorted(parent[child], np.arange(m + 1), "left")
    # Points in depth-first order, a node's bucket before its children, its centre first of all.
    rank, stack, seen = np.empty(m, np.int64), [0], 0
    last = np.arange(m)
    trail = []
    while stack:
        i = stack.pop()
        rank[i] = seen
        seen += 1
        trail.append(i)
        stack.extend(child[first[i] : first[i + 1]][::-1].tolist())
    for i in reversed(trail[1:]):  # the last node, by rank, of each one's subtree
        if rank[last[i]] > rank[last[parent[i]]]:
            last[parent[i]] = last[i]
    is_centre = np.zeros(n, bool)
    is_centre[centres] = True
    order = np.lexsort((~is_centre, rank[owner]))
    sizes = np.bincount(owner, minlength=m)
    starts = np.concatenate(([0], np.cumsum(sizes[np.argsort(rank)])))
    begin, own, end = starts[rank], starts[rank + 1], starts[rank[last] + 1]
    points = points[order]
    radius, own_radius = np.zeros(m), np.zeros(m)
    for i in range(m):
        d = np.sqrt(squares(points[begin[i] : end[i]], points[begin[i]]).astype(np.float64))
        radius[i], own_radius[i] = d.max(), d[: own[i] - begin[i]].max()
    return Tree(points, order, begin, own, end, radius, own_radius, first, child)


def _parts(tree: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, part): the parts of each node. A node's own bucket has the node's number plus the number of nodes; a bucket's only part is itself."""
    m = len(tree.begin)
    inner = nodes < m
    counts = np.where(inner, 1 + tree.first[np.where(inner, nodes, 0) + 1] - tree.first[np.where(inner, nodes, 0)], 1)
    row = np.repeat(np.arange(len(nodes)), counts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    of = nodes[row]
    out = np.where(of < m, of + m, of)  # the bucket
    deeper = at > 0
    out[deeper] = tree.child[tree.first[of[deeper]] + at[deeper] - 1]
    return row, out


def nearest(tree: Tree, centroids: np.ndarray, over: Tree) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The nearest centroid of each point of ``tree`` that was compared (others -1), and the ranges (begin, end, centroid) that needed no comparison. ``over`` is the centroids' tree."""
    m, k = len(tree.begin), len(over.begin)
    wide = lambda t: (np.concatenate((t.begin, t.begin)), np.concatenate((t.radius, t.own_radius)))
    (q_at, q_radius), (r_at, r_radius) = wide(tree), wide(over)
    single = np.concatenate((over.end, over.own)) - np.concatenate((over.begin, over.begin)) == 1
    bound = np.full(2 * m, np.inf)
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    whole: list[tuple[int, int, int]] = []
    while True:
        d = np.sqrt(squares(tree.points[q_at[q]], over.points[r_at[r]]).astype(np.float64))
        np.minimum.at(bound, q, d + q_radius[q])
        near = d - q_radius[q] - r_radius[r] <= bound[q] * (1 + SLACK) + SLACK
        q, r = q[near], r[near]
        # One centroid is left for all of a node's points.
        some, where, count = np.unique(q, return_inverse=True, return_counts=True)
        alone = (count[where] == 1) & single[r]
        for node, c in zip(q[alone].tolist(), r[alone].tolist(), strict=True):
            whole.append((int(tree.begin[node % m]), int((tree.end if node < m else tree.own)[node % m]), int(over.order[r_at[c]])))
        q, r = q[~alone], r[~alone]
        if not len(q) or (q.min() >= m and (single[r] | (r >= k)).all()):
            break
        row, deeper = _parts(tree, q)
        bound[deeper] = np.minimum(bound[deeper], bound[q[row]])
        q, r = deeper, r[row]
        open_ = ~single[r]
        row, deeper = _parts(over, r[open_])
        q, r = np.concatenate((q[~open_], q[open_][row])), np.concatenate((r[~open_], deeper))
    found = np.full(len(tree.points), -1, np.int64)
    if len(q):
        least = np.full(len(tree.points), np.iinfo(np.int64).max)
        ends = np.concatenate((over.end, over.own))
        pairs = np.array([(int(over.order[i]), b) for a, b in zip(r.tolist(), q.tolist(), strict=True) for i in range(r_at[a], ends[a])])
        pairs = np.unique(pairs, axis=0)
        for c in np.unique(pairs[:, 0]).tolist():  # ascending, so that of equal distances the smaller number stays
            leaves = pairs[pairs[:, 0] == c, 1] % m
            sizes = tree.own[leaves] - tree.begin[leaves]
            at = np.repeat(tree.begin[leaves] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            d = squares(tree.points[at], centroids[c])
            better = d < least[at]
            least[at[better]], found[at[better]] = d[better], c
    return found, whole


def labels(tree: Tree, centroids: np.ndarray, over: Tree) -> np.ndarray:
    """The nearest centroid of each point."""
    found, whole = nearest(tree, centroids, over)
    for a, b, c in whole:
        found[a:b] = c
    return found


def sums(tree: Tree, centroids: np.ndarray, over: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(count, sum) of the points nearest to each centroid; ranges of one centroid are taken from running sums."""
    k, dim = centroids.shape
    count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
    found, whole = nearest(tree, centroids, over)
    if whole:
        running = np.concatenate((np.zeros((1, dim), np.int64), np.cumsum(tree.points, axis=0, dtype=np.int64)))
        for a, b, c in whole:
            count[c] += b - a
            total[c] += running[b] - running[a]
    for c in range(k):
        mine = tree.points[found == c]
        count[c] += len(mine)
        total[c] += mine.sum(axis=0, dtype=np.int64)
    return count, total


def _usable(vector: Column, dim: int) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, bad)


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(k, v): keys and vectors of doubles that are taken."""
    return df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where(_usable(F.col("v"), dim))


_NODES = ("begin", "own", "end", "radius", "own_radius", "first", "child")


def forest(rows: DataFrame, dim: int, scale: int, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """A row for each block, kept in the shared folder: its keys in the tree's order, the points as bytes of the smallest integers that hold them (``width``), the nodes' arrays as bytes."""
    kind = rows.schema["k"].dataType.simpleString()

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, block):
                some = batch.slice(start, block)
                floats = some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                points = np.floor(floats * scale)
                size = np.abs(points).max()
                if not size <= LARGEST:
                    raise ValueError(f"a component of more than {LARGEST} in size: squared distances would not fit a long")
                width = next(w for w in (1, 2, 4) if size < 1 << (8 * w - 1))
                tree = cover_tree(points.astype(f"<i{width}"), bucket)
                keys = some.column(0).take(pa.array(tree.order))
                cells = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([width], pa.int32()), pa.array([tree.points.tobytes()], pa.binary())]
                cells += [pa.array([getattr(tree, n).tobytes()], pa.binary()) for n in _NODES]
                yield pa.RecordBatch.from_arrays(cells, names=["keys", "width", "points", *_NODES])

    made = rows.mapInArrow(tidy(build), f"keys array<{kind}>, width int, points binary, " + ", ".join(f"{n} binary" for n in _NODES))
    return kept(made, "forest")


def _trees(batch, dim: int) -> Iterator[tuple]:
    """(keys, tree) of stored rows."""
    for i in range(batch.num_rows):
        cell = {n: batch.column(n)[i] for n in batch.schema.names}
        points = np.frombuffer(cell["points"].as_py(), f"<i{cell['width'].as_py()}").reshape(-1, dim)
        nodes = {n: np.frombuffer(cell[n].as_py(), np.float64 if "radius" in n else np.int64) for n in _NODES}
        yield cell["keys"].values, Tree(points=points, order=np.arange(len(points)), **nodes)


def _first(rows: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The k vectors whose keys have the smallest hashes."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("k").cast("string")), 256)
    found = rows.where("k IS NOT NULL").orderBy(by, "v").limit(k).select("v").collect()
    return np.floor(np.array([r.v for r in found], np.float64) * scale).astype(np.int64)


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: each the floor of its vectors' mean; one without vectors stays. What comes to the driver is a row for each centroid."""
    dim = centroids.shape[1]

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        over = cover_tree(centroids, 1)
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, tree in _trees(batch, dim):
                n, s = sums(tree, centroids, over)
                count, total = count + n, total + s
        some = np.flatnonzero(count)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dim, pa.int32()), pa.array(total[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), values], names=["cluster", "n", "s"])

    parts = trees.mapInArrow(tidy(work), "cluster int, n bigint, s array<bigint>")
    exact = "decimal(38,0)"
    found = parts.groupBy("cluster").agg(F.sum(F.col("n").cast(exact)).alias("n"), F.array(*[F.sum(F.col("s")[i].cast(exact)) for i in range(dim)]).alias("s")).collect()
    out = centroids.copy()
    for r in found:
        out[r.cluster] = [int(x) // int(r.n) for x in r.s]
    return out


def fit(rows: DataFrame, trees: DataFrame, k: int, rounds: int, seed: int, scale: int) -> np.ndarray:
    """The centroids after all rounds."""
    centroids = _first(rows, k, seed, scale)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(trees, centroids)
    return centroids


def assigned(trees: DataFrame, centroids: np.ndarray, kind: str) -> DataFrame:
    """(k, cluster, distance) of every vector; the distance is squared."""
    dim = centroids.shape[1]

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        over = cover_tree(centroids, 1)
        for batch in batches:
            for keys, tree in _trees(batch, dim):
                found = labels(tree, centroids, over)
                yield pa.RecordBatch.from_arrays([keys, pa.array(found, pa.int32()), pa.array(squares(tree.points, centroids[found]))], names=["k", "cluster", "distance"])

    return trees.mapInArrow(tidy(work), f"k {kind}, cluster int, distance bigint")


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dim: int = 64, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Key, cluster, distance (squared), cluster_inertia and inertia (distances summed over the cluster and over all) and centroid_sha256 of each vector that is taken; components are floor(scale * x)."""
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    rows = usable(df, key, vector, dim)
    trees = forest(rows, dim, scale)
    centroids = fit(rows, trees, k, rounds, seed, scale)
    if not len(centroids):  # no vector with a key: nothing to start from
        return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    found = kept(assigned(trees, centroids, kind), "assigned")
    parts = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    told = spark.createDataFrame([(c, d, sum(parts.values()), centroid_digest(centroids[c])) for c, d in parts.items()] or [], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    out = found.join(F.broadcast(told), "cluster")  # a row for each centroid
    return out.select(F.col("k").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
