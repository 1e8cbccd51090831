"""Embedding near-duplicates by dual traversal of cover trees: exact links at a cosine threshold.

Vectors at unit length link when their distance is at most sqrt(2 - 2 cos). They are sorted by the nearest of a few
pivots and by the distance to it, so that what is close lies close, and cut into trees of at most ``TREE_POINTS``. In a
tree, centres at radius 1 are chosen so that every point is within the radius of one, centres at 1/2 so within each of
these, and so on: nested levels with halving radii. Trees are the leaves of a tree of nodes above them, ``FAN`` to one.

Two nodes are compared by their centres and covering radii: too far apart for any link, they are dropped; so close that
all their points link, they count by their sizes, without a look at the points; else both are opened. Above the trees
this is a join of pairs with children, level by level; a pair of trees that stays open goes to one task, which goes on
level by level in the same way down to the points. So a dense group of any size costs node pairs, not pairs of points.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_split, lean, staged
from .components import components

#: Distinct vectors of a tree, trees or nodes under a node above.
TREE_POINTS, FAN_BITS = 4_096, 4
#: Covering radii of the levels in a tree; its root covers all.
RADII = (1.0, 0.5, 0.25, 0.125)
#: Vectors that the pivots are chosen from, and how many; they decide only what lies close to what.
SAMPLE, PIVOTS = 4_096, 256
#: What distances may be off by.
SLACK = 1e-7
#: Rows of a distance matrix that are held at a time.
BLOCK = 512


def unit(values: np.ndarray) -> np.ndarray:
    """Rows at unit length; scaled by their largest component first, so that no square overflows or vanishes."""
    scaled = values / np.abs(values).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def pivots_of(points: np.ndarray, many: int) -> np.ndarray:
    """Points each as far as can be from those before: any number of the first are a net of some radius."""
    chosen, far = [0], np.full(len(points), np.inf)
    while len(chosen) < min(many, len(points)):
        far = np.minimum(far, 2 - 2 * points @ points[chosen[-1]])
        chosen.append(int(far.argmax()))
    return points[chosen]


def _place(pivots: np.ndarray):
    """(vec_id, cell, gap, mark, v): nearest pivot, rounded distance to it and digest of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            u = unit(values)
            near = u @ pivots.T
            cell = near.argmax(axis=1)
            gap = np.round(1 - near[np.arange(len(u)), cell], 6)
            marks = [zlib.crc32(row.tobytes()) for row in values]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1) * u.shape[1], pa.int32()), pa.array(u.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), pa.array(gap), pa.array(marks, pa.int64()), lists], names=["vec_id", "cell", "gap", "mark", "v"])

    return run


def levels_of(points: np.ndarray) -> np.ndarray:
    """For every point its centre at each radius, nested: points of one centre have had one centre before."""
    n = len(points)
    path = np.zeros((n, len(RADII)), np.int32)
    dots = np.empty((n, n), np.float32)
    for a in range(0, n, BLOCK):
        dots[a : a + BLOCK] = points[a : a + BLOCK] @ points.T
    above = np.zeros(n, np.int32)
    for level, radius in enumerate(RADII):
        centre = np.full(n, -1, np.int32)
        close = dots >= 1 - radius * radius / 2
        # Centres of the level above stay centres; then each point that none covers becomes one.
        for c in [*np.unique(above).tolist(), *range(n)]:
            if centre[c] < 0:
                centre[close[c] & (centre < 0) & (above == above[c])] = c
                centre[c] = c
        path[:, level] = above = centre
    return path


GROWN = "kind int, tree long, uid long, vec_id long, weight long, radius double, v array<double>, path array<int>"


def _grow():
    """Members (0), points (1) and a summary (2) of each tree, from a task's rows in order; equal vectors that follow each other are one point."""

    def batch(kind: int, tree, uid, vec_id, weight, radius, v: np.ndarray | None, path: np.ndarray | None) -> pa.RecordBatch:
        n = len(uid)
        column = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x, t)
        lists = lambda x, t: pa.nulls(n, pa.list_(t)) if x is None else pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1), t))
        longs = [column(x, pa.int64()) for x in (tree, uid, vec_id, weight)]
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), *longs, column(radius, pa.float64()), lists(v, pa.float64()), lists(path, pa.int32())], names=[c.split()[0] for c in GROWN.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        made, n_trees = 0, 0
        reps: list[int] = []
        weights: list[int] = []
        held: list[np.ndarray] = []

        def tree() -> Iterator[pa.RecordBatch]:
            points = np.stack(held)
            centre = points.mean(axis=0)
            gaps = points - centre
            radius = float(np.sqrt(np.einsum("ij,ij->i", gaps, gaps).max()))
            own, first = (pid << 20) + n_trees, (pid << 40) + made - len(held)
            uids = np.arange(first, first + len(held))
            yield batch(1, [own] * len(held), uids, reps, weights, None, points, levels_of(points))
            yield batch(2, [own], [first], None, [sum(weights)], [radius], centre[None, :], None)

        last = None
        for rows in batches:
            if not rows.num_rows:
                continue
            values = rows.column(1).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
            uids = np.empty(len(values), np.int64)
            for k, (name, v) in enumerate(zip(rows.column(0).to_pylist(), values)):
                if last is not None and held and np.array_equal(v, last):
                    weights[-1] += 1
                    reps[-1] = min(reps[-1], name)
                else:
                    if len(held) == TREE_POINTS:
                        yield from tree()
                        held, reps, weights, n_trees = [], [], [], n_trees + 1
                    held.append(v)
                    reps.append(name)
                    weights.append(1)
                    made, last = made + 1, v
                uids[k] = (pid << 40) + made - 1
            yield batch(0, None, uids, rows.column(0), None, None, None, None)
        if held:
            yield from tree()

    return run


class Tree:
    """A tree in a task: points with weights, and a level's centres, radii, weights and nodes of points."""

    def __init__(self, points: np.ndarray, weight: np.ndarray, path: np.ndarray):
        self.points, self.weight, self.levels = points, weight, []
        above = np.zeros(len(points), np.int64)
        for k in range(path.shape[1]):
            centre, node = np.unique(path[:, k], return_inverse=True)
            gaps = points - points[centre[node]]
            radius = np.zeros(len(centre))
            np.maximum.at(radius, node, np.sqrt(np.einsum("ij,ij->i", gaps, gaps)))
            total = np.bincount(node, weights=weight).astype(np.int64)
            self.levels.append((centre, radius, total, node, above[centre]))
            above = node


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a and b; labels are the smallest of their class before and after."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := label[label], label):
            label[:] = up


def dual(one: Tree, two: Tree, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked weight of the points of both trees, and the class of each, those of the second numbered after the first (``same``: like the first)."""
    reach = np.sqrt(2 - 2 * threshold)
    n_one, shift = len(one.points), 0 if same else len(one.points)
    counts = np.zeros(n_one, np.int64), np.zeros(len(two.points), np.int64)
    label = np.arange(shift + len(two.points))
    alive = np.ones((1, 1), bool)

    def add(side: int, at: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(at, weights=weight, minlength=size).astype(np.int64)

    for (c1, r1, w1, node1, up1), (c2, r2, w2, node2, up2) in zip(one.levels, two.levels):
        rows, cols = np.flatnonzero(alive.any(axis=1)[up1]), np.flatnonzero(alive.any(axis=0)[up2])
        nxt = np.zeros((len(c1), len(c2)), bool)
        p2 = two.points[c2[cols]]
        hit1, hit2 = np.zeros(len(c1), np.int64), np.zeros(len(c2), np.int64)
        for a in range(0, len(rows), BLOCK):
            part = rows[a : a + BLOCK]
            gap = np.sqrt(np.maximum(2 - 2 * one.points[c1[part]] @ p2.T, 0))
            both = r1[part][:, None] + r2[cols][None, :]
            open_ = alive[up1[part]][:, up2[cols]]
            inside = open_ & (gap + both <= reach - SLACK) & (both > 0)
            nxt[np.ix_(part, cols)] = open_ & ~inside & (gap - both <= reach + SLACK)
            i, j = np.nonzero(inside)
            i, j = part[i], cols[j]
            hit1 += add(0, i, w2[j], len(c1))
            hit2 += add(1, j, w1[i], len(c2))
            unite(label, c1[i], shift + c2[j])
        for hit, node, centre, count, off in ((hit1, node1, c1, counts[0], 0), (hit2, node2, c2, counts[1], shift)):
            count += hit[node]
            met = np.flatnonzero(hit[node])
            unite(label, off + met, off + centre[node[met]])
        alive = nxt
    node1, node2 = one.levels[-1][3], two.levels[-1][3]
    rows, cols = np.flatnonzero(alive.any(axis=1)[node1]), np.flatnonzero(alive.any(axis=0)[node2])
    for a in range(0, len(rows), BLOCK):
        part = rows[a : a + BLOCK]
        i, j = np.nonzero(alive[node1[part]][:, node2[cols]] & (one.points[part] @ two.points[cols].T >= threshold))
        i, j = part[i], cols[j]
        counts[0][:] += add(0, i, two.weight[j], n_one)
        counts[1][:] += add(1, j, one.weight[i], len(two.points))
        unite(label, i, shift + j)
    return counts[0], counts[1], label


def _compare(threshold: float):
    """(uid, n, mate) of the points of a pair of trees that link: the weight linked, and a point of the same component."""

    def tree(rows: pa.Table) -> tuple[np.ndarray, Tree]:
        array = lambda c: rows.column(c).combine_chunks()
        stack = lambda c: array(c).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        return array("uid").to_numpy(), Tree(stack("v"), array("weight").to_numpy(), stack("path"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        # Centres are numbers within their tree, whose points are numbered in a row.
        side = table.column("side").to_numpy()
        uid1, one = tree(table.filter(pa.array(side == 0)))
        same = table.column("a")[0] == table.column("b")[0]
        uid2, two = (uid1, one) if same else tree(table.filter(pa.array(side == 1)))
        n1, n2, label = dual(one, two, threshold, same)
        uid, n = (uid1, n1) if same else (np.r_[uid1, uid2], np.r_[n1, n2])
        met = np.flatnonzero(n)
        return pa.table({"uid": uid[met], "n": n[met], "mate": uid[label[met]]})

    return run


NODE = "node long, weight long, radius double, rep long, v array<double>"


def _above(frame: pd.DataFrame) -> pd.DataFrame:
    """The node over a few nodes: its centre is theirs by weight, its radius covers theirs."""
    centres, weight = np.stack(frame["v"]), frame["weight"].to_numpy()
    centre = weight @ centres / weight.sum()
    radius = (np.sqrt(((centres - centre) ** 2).sum(axis=1)) + frame["radius"].to_numpy()).max()
    return pd.DataFrame({"node": [int(frame["up"].iloc[0])], "weight": [int(weight.sum())], "radius": [float(radius)], "rep": [int(frame["rep"].min())], "v": [centre]})


def _gap(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _linked(vectors: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, n_links, component_id) of vectors of one length; vectors: vec_id, v."""
    spark = vectors.sparkSession
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()  # a bounded sample, for pivots only
    pivots = pivots_of(unit(np.array([r["v"] for r in some], dtype=np.float64)), PIVOTS)
    placed = staged(vectors.mapInArrow(lean(_place(pivots)), "vec_id long, cell int, gap double, mark long, v array<double>"), "placed")
    n_parts = max(1, -(-placed.count() // TREE_POINTS))
    keys = ["cell", "gap", "mark", "vec_id"]
    sorted_ = placed.repartitionByRange(n_parts, *keys).coalesce(n_parts).sortWithinPartitions(*keys).select("vec_id", "v")
    grown = staged(sorted_.mapInArrow(lean(_grow()), GROWN), "trees")
    discard(placed)
    points = grown.filter("kind = 1")
    top = grown.filter("kind = 2")
    last = top.agg(F.max(F.shiftright("tree", 20)), F.max(F.col("tree").bitwiseAND((1 << 20) - 1))).first()
    k_bits = int(last[1]).bit_length()
    node_of = F.shiftleft(F.shiftright("tree", 20), k_bits).bitwiseOR(F.col("tree").bitwiseAND((1 << 20) - 1))
    levels = [staged(top.select(node_of.alias("node"), "weight", "radius", F.col("uid").alias("rep"), "v"), "nodes")]
    for _ in range(-(-((int(last[0]) << k_bits) + int(last[1])).bit_length() // FAN_BITS)):
        up = levels[-1].withColumn("up", F.shiftright("node", FAN_BITS))
        levels.append(staged(up.groupBy("up").applyInPandas(_above, NODE), "nodes"))

    # Down from the pair of the root with itself.
    reach = float(np.sqrt(2 - 2 * threshold))
    open_ = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    inside = []
    for depth in range(len(levels) - 1, -1, -1):
        nodes = levels[depth]
        if depth < len(levels) - 1:
            child = lambda c: nodes.select(F.shiftright("node", FAN_BITS).alias(c), F.col("node").alias(f"{c}_"))  # noqa: B023, E731
            open_ = open_.join(child("a"), "a").join(child("b"), "b").filter("a_ <= b_").select(F.col("a_").alias("a"), F.col("b_").alias("b"))
        full = lambda c: nodes.select(F.col("node").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("weight", "radius", "rep", "v")))  # noqa: B023, E731
        met = open_.join(full("a"), "a").join(full("b"), "b").withColumn("gap", _gap(F.col("a_v"), F.col("b_v"))).withColumn("both", F.col("a_radius") + F.col("b_radius"))
        met = met.filter(F.col("gap") - F.col("both") <= reach + SLACK).withColumn("whole", F.col("gap") + F.col("both") <= reach - SLACK).drop("a_v", "b_v", "a_radius", "b_radius", "gap", "both")
        met = staged(met, "pairs")
        inside.append((depth, met.filter("whole")))
        open_ = met.filter("NOT whole").select("a", "b")

    sides = open_.select("a", "b", F.inline(F.array(F.struct(F.col("a").alias("tree"), F.lit(0).alias("side")), F.struct(F.col("b").alias("tree"), F.lit(1).alias("side"))))).filter("side = 0 OR a < b")
    held = points.select(node_of.alias("tree"), "uid", "weight", "v", "path")
    found = sides.join(held, "tree").select("a", "b", "side", "uid", "weight", "v", "path").groupBy("a", "b").applyInArrow(_compare(threshold), "uid long, n long, mate long")
    found = staged(found, "found")

    # What whole pairs of nodes add to all points of the trees below them.
    by_tree, ties = [], []
    for depth, whole in inside:
        give = whole.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b_weight").alias("n"), F.col("a_rep").alias("rep"), F.lit(0).alias("side")), F.struct(F.col("b").alias("node"), F.col("a_weight").alias("n"), F.col("b_rep").alias("rep"), F.lit(1).alias("side")))), "a", "b").filter("side = 0 OR a < b")
        given = give.groupBy("node").agg(F.sum("n").alias("n"), F.min("rep").alias("over"))
        below = levels[0].select(F.col("node").alias("tree"), F.col("rep").alias("own"), F.shiftright("node", FAN_BITS * depth).alias("node"))
        by_tree.append(below.join(given, "node").select("tree", "own", "n", "over"))
        ties.append(whole.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")))
    whole_trees = staged(reduce(DataFrame.unionByName, by_tree), "whole")
    ties.append(whole_trees.select(F.col("own").alias("a"), F.col("over").alias("b")))
    summed = whole_trees.groupBy("tree").agg(F.sum("n").alias("n"), F.min("own").alias("mate"))
    of_points = points.select(node_of.alias("tree"), "uid").join(summed, "tree").select("uid", "n", "mate")
    every = found.unionByName(of_points)
    links = reduce(DataFrame.unionByName, ties).unionByName(every.select(F.col("uid").alias("a"), F.col("mate").alias("b")))
    label = components(links)
    total = every.groupBy("uid").agg(F.sum("n").alias("n"))
    named = points.select("uid", "vec_id").join(label.withColumnRenamed("node", "uid").hint("merge"), "uid", "left").join(total.hint("merge"), "uid", "left")
    named = staged(named.select("uid", "vec_id", "n", F.coalesce("label", "uid").alias("label")), "named")
    least = named.groupBy("label").agg(F.min("vec_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    per_point = join_split(named, least, ["label"], "size", named.count()).select("uid", "n", "component_id")
    return grown.filter("kind = 0").select("uid", "vec_id").join(per_point.hint("merge"), "uid").select("vec_id", (F.col("n") - 1).alias("n_links"), "component_id")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Links are cosines of at least ``threshold`` in double precision, between vectors of one length. Vectors that are
    null, empty, zero or hold a null or not finite component, and rows without an id, link with nothing and are their
    own component. Rows that repeat an id are vectors of their own; a component is named by its smallest id. Equal
    vectors link and count like others. An empty table gives an empty result; extra columns are ignored.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    linkable = F.coalesce(F.col("vec_id").isNotNull() & ok, F.lit(False))
    alone = rows.filter(~linkable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    good = rows.filter(linkable)
    out = alone
    for size in [r[0] for r in good.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]:
        out = out.unionByName(_linked(good.filter(F.size("v") == size), threshold))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: The same over all pairs, and components by the smallest id that is reached.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT a AS node, b AS other FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT node, min(other) AS least FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.node LEFT JOIN n ON vec_id = n.a
"""
