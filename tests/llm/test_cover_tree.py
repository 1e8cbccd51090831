import numpy as np
import pytest

from codelode.llm import cover_tree
from codelode.llm.queries import ORACLES, QUERIES

from ..compare import compare

SCHEMA = "vec_id long, embedding array<double>, kept string, label int"


def brute(rows, threshold):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None for i, v in rows]
    unit = [np.array(v) / np.abs(v).max() if g else None for (_, v), g in zip(rows, good)]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    near = [[k for k in range(len(rows)) if k != j and good[j] and good[k] and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= threshold] for j in range(len(rows))]
    out = []
    for j, (i, _) in enumerate(rows):
        seen, todo = {j}, [j]
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        least = i if i is None else min(rows[k][0] for k in seen)
        out.append((i, len(near[j]), least, i is not None and i == least))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def near_groups(seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 6))
    loose = base[rng.integers(0, 12, 150)] * rng.uniform(0.5, 2, (150, 1)) + rng.normal(size=(150, 6)) * 0.15
    return np.concatenate([loose, np.repeat(base[:1], 40, 0), base[1] + rng.normal(size=(80, 6)) * 0.01, rng.normal(size=(60, 6))])


@pytest.mark.parametrize("per_tree", [9, 4_096])
def test_against_all_pairs(spark, monkeypatch, per_tree):
    """One tree, and many under nodes of several levels, where whole nodes of a dense group count unopened."""
    monkeypatch.setattr(cover_tree, "TREE_POINTS", per_tree)
    rows = [(k, v.tolist()) for k, v in enumerate(near_groups(5))]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    assert got(cover_tree.near_duplicates(df)) == brute(rows, 0.95)


def test_odd_rows(spark):
    """Null, empty, zero, not finite and huge vectors, null and repeated ids, other lengths."""
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [0.0, 1.0]), (5, [0.0, 3.0]), (None, [1.0, 0.0]), (6, None), (7, []), (8, [0.0, 0.0]), (9, [1.0, None]), (10, [float("nan"), 1.0]), (11, [float("inf"), 1.0]), (12, [1e300, 1e290]), (13, [1e-310, 0.0]), (14, [1.0, 0.0, 0.0]), (15, [5.0, 0.1, 0.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    assert got(cover_tree.near_duplicates(df)) == brute(rows, 0.95)


def test_empty_table(spark):
    out = cover_tree.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and out.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_levels_cover_and_nest():
    points = cover_tree.unit(near_groups(7))
    path = cover_tree.levels_of(points)
    for k, radius in enumerate(cover_tree.RADII):
        assert (np.linalg.norm(points - points[path[:, k]], axis=1) <= radius + 1e-3).all()
        assert (path[path[:, k], k] == path[:, k]).all()
        if k:
            assert (path[path[:, k], k - 1] == path[:, k - 1]).all()


def test_dense_group_counts_by_nodes(monkeypatch):
    """A tight group links as one node with itself: no two of its points are compared."""
    rng = np.random.default_rng(0)
    points = cover_tree.unit(rng.normal(size=8) + rng.normal(size=(300, 8)) * 1e-4)
    tree = cover_tree.Tree(points, np.ones(300, np.int64), cover_tree.levels_of(points))
    n, _, label = cover_tree.dual(tree, tree, 0.95, True)
    assert (n == 300).all() and (label == 0).all() and len(tree.levels[0][0]) == 1


def test_against_sql(spark):
    compare(spark, "op12_embedding_dedup", QUERIES["op12_embedding_dedup"], ORACLES["op12_embedding_dedup"])
