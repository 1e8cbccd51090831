"""Centroid clustering with ball-tree filtering.

Vectors are integers here: floor(256 x) of each component. Every task builds metric trees over its own vectors, at most
``TREE_POINTS`` each, once; a node is a ball with radius, count and integer sum. In a round the balls are compared with
the centroids: by the triangle inequality a ball whose nearest centroid is nearer than any other for all that it may
hold goes to it whole, by its count and sum; the others are opened, and in leaves vectors are compared one by one, in
exact arithmetic. What a round sends to the driver is a row a centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, staged

#: Vectors of a tree and of a leaf.
TREE_POINTS, LEAF_POINTS = 4_096, 32
#: Integers are held to this size either way, so that squared distances of 64 components fit 64 bits.
LARGEST = 1 << 27
#: Up to this size all sums of a distance are exact in double precision.
EXACT_IN_DOUBLE = 1 << 22
TREES = "ids array<long>, no_id array<boolean>, points array<int>, start array<int>, stop array<int>, child array<int>, radius array<double>, total array<long>"


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list a tree."""
    return pa.ListArray.from_arrays(pa.array([0, rows.size], pa.int32()), pa.array(rows.reshape(-1), kind))


def grow(points: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Order of the points, and the nodes (start, stop, first child or 0, radius, sum), the root first and children in pairs.

    A node is split at the middle of its points along the line between two that are far apart. Equal points are a leaf of any size.
    """
    order = np.arange(len(points))
    nodes: list[list] = [[0, len(points), 0]]
    measured = []
    at = 0
    while at < len(nodes):
        start, stop, _ = nodes[at]
        own = points[order[start:stop]].astype(np.float64)
        total = points[order[start:stop]].sum(axis=0, dtype=np.int64)
        off = own - total / (stop - start)
        far = np.einsum("ij,ij->i", off, off)
        radius = float(np.sqrt(far.max()))
        measured.append((radius, total))
        if stop - start > LEAF_POINTS and radius > 0:
            one = own[far.argmax()]
            gaps = own - one
            two = own[np.einsum("ij,ij->i", gaps, gaps).argmax()]
            along = np.argsort(own @ (two - one), kind="stable")
            order[start:stop] = order[start:stop][along]
            middle = (start + stop) // 2
            nodes[at][2] = len(nodes)
            nodes += [[start, middle, 0], [middle, stop, 0]]
        at += 1
    return order, [(*n, *m) for n, m in zip(nodes, measured)]


def _plant(id_col: int, vector_col: int, size: int):
    """Trees of a task's rows (id, integers)."""

    def tree(ids: list, points: np.ndarray) -> pa.RecordBatch:
        order, nodes = grow(points)
        known = np.array([i is not None for i in ids])
        numbers = np.array([i or 0 for i in ids], dtype=np.int64)
        columns = [
            _lists(numbers[order], pa.int64()),
            _lists(~known[order], pa.bool_()),
            _lists(points[order], pa.int32()),
            *(_lists(np.array([n[k] for n in nodes]), pa.int32()) for k in (0, 1, 2)),
            _lists(np.array([n[3] for n in nodes]), pa.float64()),
            _lists(np.array([n[4] for n in nodes]), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in TREES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[np.ndarray] = []
        for batch in batches:
            values = batch.column(vector_col).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            names = batch.column(id_col).to_pylist()
            while len(names):
                room = TREE_POINTS - len(ids)
                ids += names[:room]
                held.append(values[:room])
                names, values = names[room:], values[room:]
                if len(ids) == TREE_POINTS:
                    yield tree(ids, np.concatenate(held))
                    ids, held = [], []
        if ids:
            yield tree(ids, np.concatenate(held))

    return run


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors, by matrix product where double precision holds them."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT_IN_DOUBLE:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (p @ c.T)).astype(np.int64)
    p = points.astype(np.int64)
    return np.stack([((p - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def filtered(tree: dict, centroids: np.ndarray) -> np.ndarray:
    """Centroid of every point of a tree whose ball or a ball above it goes to one centroid whole, else -1.

    A centroid is out of question for a ball if it is farther from the ball's centre than the nearest one by more than
    twice the radius (and what rounding may be): then it is strictly farther from every point of the ball.
    """
    size = centroids.shape[1]
    start, stop, child, radius = tree["start"], tree["stop"], tree["child"], tree["radius"]
    total = tree["total"].reshape(-1, size)
    of = np.full(stop[0], -1)
    scale = 1e-9 * (1 + np.abs(centroids).max(initial=0)) * np.sqrt(size)
    level = np.array([0])
    while len(level):
        centre = total[level] / (stop[level] - start[level])[:, None]
        gaps = np.sqrt(np.maximum((centre * centre).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2 * centre @ centroids.T, 0))
        nearest = gaps.argmin(axis=1)
        best = gaps[np.arange(len(level)), nearest]
        rivals = (gaps <= (best + 2 * radius[level] + 1e-3 + scale)[:, None]).sum(axis=1)
        for node, c in zip(level[rivals == 1], nearest[rivals == 1]):
            of[start[node] : stop[node]] = c
        opened = child[level[rivals > 1]]
        opened = opened[opened > 0]
        level = np.concatenate([opened, opened + 1])
    return of


def _trees(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[dict, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            tree = {name: batch.column(name)[k].values.to_numpy(zero_copy_only=False) for name in batch.schema.names}
            yield tree, tree["points"].reshape(-1, size)


def assigned(tree: dict, points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of every point, of as near ones the first."""
    of = filtered(tree, centroids.astype(np.float64))
    rest = np.flatnonzero(of < 0)
    if len(rest):
        of[rest] = squared_distances(points[rest], centroids).argmin(axis=1)
    return of


def _sums(centroids: np.ndarray):
    """(cluster, n, total) of a task's vectors; balls that go whole count by their own sums."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for tree, points in _trees(batches, size):
            of = filtered(tree, centroids.astype(np.float64))
            whole = of >= 0
            if whole.any():
                total += _ball_sums(tree, of, len(centroids), size)
            rest = np.flatnonzero(~whole)
            if len(rest):
                of[rest] = squared_distances(points[rest], centroids).argmin(axis=1)
                np.add.at(total, of[rest], points[rest].astype(np.int64))
            n += np.bincount(of, minlength=len(centroids))
        got = np.flatnonzero(n)
        if len(got):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1) * size, pa.int32()), pa.array(total[got].reshape(-1), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int32()), pa.array(n[got], pa.int64()), lists], names=["cluster", "n", "total"])

    return run


def _ball_sums(tree: dict, of: np.ndarray, k: int, size: int) -> np.ndarray:
    """Sums a cluster over the largest balls that went whole, without a look at their points."""
    start, stop, child, total = tree["start"], tree["stop"], tree["child"], tree["total"].reshape(-1, size)
    out = np.zeros((k, size), np.int64)
    level = np.array([0])
    while len(level):
        # A ball went whole if its first and last points did, to one cluster, and no point between went elsewhere.
        one = np.array([(of[start[x] : stop[x]] == of[start[x]]).all() for x in level]) & (of[start[level]] >= 0)
        np.add.at(out, of[start[level[one]]], total[level[one]])
        opened = child[level[~one]]
        opened = opened[opened > 0]
        level = np.concatenate([opened, opened + 1])
    return out


def _results(centroids: np.ndarray):
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, points in _trees(batches, size):
            of = assigned(tree, points, centroids)
            gaps = points.astype(np.int64) - centroids[of]
            ids = pa.array(tree["ids"], pa.int64(), mask=tree["no_id"].astype(bool))
            yield pa.RecordBatch.from_arrays([ids, pa.array(of, pa.int32()), pa.array((gaps * gaps).sum(axis=1), pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``size`` components, none null or not finite. Centroids start as the ``k`` vectors whose
    sha256 of ``seed:id`` is smallest (fewer if there are fewer); rows that repeat an id start in the order of their
    components, rows without an id never start one but are assigned like others. Components beyond ``LARGEST`` / 256 in
    size count as that. Ties go to the smaller cluster, an empty cluster keeps its centroid. An empty table gives an
    empty result; extra columns are ignored.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    held = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v")).filter((F.size("v") == size) & finite)
    whole = F.transform("v", lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x * 256))).cast("int"))
    ints = held.select("vec_id", whole.alias("v"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = ints.filter("vec_id IS NOT NULL").orderBy(digest, "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long"
    if not first:
        empty = vectors.sparkSession.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
        return empty
    centroids = np.array([r["v"] for r in first], dtype=np.int64)
    trees = staged(ints.mapInArrow(lean(_plant(0, 1, size)), TREES), "trees")
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    for _ in range(rounds):
        sums = trees.mapInArrow(lean(_sums(centroids)), "cluster int, n long, total array<long>")
        for r in sums.groupBy("cluster").agg(exact(F.col("n")), *(exact(F.col("total")[j]) for j in range(size))).collect():
            centroids[r[0]] = [int(s) // int(r[1]) for s in r[2:]]
    out = staged(trees.mapInArrow(lean(_results(centroids)), schema), "assigned")
    discard(trees)
    inertia = {r[0]: int(r[1]) for r in out.groupBy("cluster").agg(exact(F.col("distance"))).collect()}
    whole_sum = sum(inertia.values())
    facts = [(j, inertia.get(j, 0), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    named = out.sparkSession.createDataFrame([(j, min(s, (1 << 63) - 1), min(whole_sum, (1 << 63) - 1), h) for j, s, h in facts], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


#: The 40 clusters of ``embeddings`` after five rounds, in components: round by round, a row a vector and component.
def _oracle(k: int = 40, rounds: int = 5, size: int = 64, seed: int = 2) -> str:
    parts = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"flat AS (SELECT vec_id, unnest(v) AS x, unnest(range({size})) AS j FROM kept)",
        f"start AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) <= {k})",
        f"c0 AS (SELECT c, unnest(v) AS x, unnest(range({size})) AS j FROM start)",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS (SELECT f.vec_id, c.c, sum((f.x - c.x) * (f.x - c.x)) AS d FROM flat f JOIN c{n} c USING (j) GROUP BY ALL)")
        parts.append(f"a{n} AS (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{n} GROUP BY vec_id)")
        if n < rounds:
            parts.append(f"m{n} AS (SELECT a.c, f.j, sum(f.x) AS s, count(*) AS n FROM a{n} a JOIN flat f USING (vec_id) GROUP BY ALL)")
            parts.append(f"c{n + 1} AS (SELECT c.c, c.j, coalesce(CASE WHEN m.s >= 0 THEN m.s // m.n ELSE -((-m.s + m.n - 1) // m.n) END, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (c, j))")
    last = rounds
    return "WITH " + ", ".join(parts) + f""", h AS (SELECT c, sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY j)) AS s FROM c{last} GROUP BY c)
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.s AS centroid_sha256
FROM a{last} a JOIN h ON a.c = h.c"""


ORACLE = _oracle()
