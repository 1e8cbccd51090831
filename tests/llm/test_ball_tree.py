import hashlib
import math

import numpy as np
import pytest

from codelode.llm import ball_tree
from codelode.llm.queries import ORACLES, QUERIES

from ..compare import compare

SCHEMA = "vec_id long, embedding array<float>, cluster string, label int"


def brute(rows, k, rounds, size):
    """The contract in plain integers."""
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(256 * float(np.float32(x))))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [list(v) for _, v in seeds]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        of = [min(range(len(centroids)), key=lambda c: (gap(v, centroids[c]), c)) for _, v in kept]
        if turn == rounds:
            break
        for c in range(len(centroids)):
            own = [v for (_, v), o in zip(kept, of) if o == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    far = [gap(v, centroids[o]) for (_, v), o in zip(kept, of)]
    inertia = [sum(d for d, o in zip(far, of) if o == c) for c in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((-1 if i is None else i), o, d, inertia[o], sum(far), sha[o]) for (i, _), o, d in zip(kept, of, far))


def got(df):
    return sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in df.collect())


@pytest.mark.parametrize("scale", [1.0, 30_000.0])
def test_against_plain_integers(spark, monkeypatch, scale):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(150, 5)), rng.normal(size=5) + rng.normal(size=(150, 5)) * 0.001, np.repeat(rng.normal(size=(1, 5)), 120, 0)]) * scale
    rows = [(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    assert got(ball_tree.cluster(df, k=7, rounds=3, size=5)) == brute(rows, 7, 3, 5)


def test_odd_rows(spark):
    """Null, short, empty and not finite vectors drop out; repeated and null ids, ties and huge components have results."""
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [3.0, 1.0]), (None, [0.5, 0.0]), (3, None), (4, [1.0]), (5, []), (6, [1.0, None]), (7, [float("nan"), 0.0]), (8, [float("inf"), 0.0]), (9, [3e38, -3e38]), (10, [-0.001, 2.5])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    for k in (1, 3, 40):
        assert got(ball_tree.cluster(df, k=k, rounds=2, size=2)) == brute(rows, k, 2, 2)


def test_empty_table(spark):
    out = ball_tree.cluster(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_whole_balls_take_no_look_at_points():
    """A tight far group goes to its centroid as one ball, a group between two centroids is opened."""
    rng = np.random.default_rng(0)
    near, between = rng.integers(-3, 4, (200, 4)), np.array([500, 0, 0, 0]) + rng.integers(-60, 61, (200, 4))
    centroids = np.array([[0, 0, 0, 0], [1000, 0, 0, 0]])
    for points, whole in ((near, True), (between, False)):
        order, nodes = ball_tree.grow(points)
        tree = {name: np.array([n[k] for n in nodes]) for k, name in enumerate(("start", "stop", "child", "radius"))} | {"total": np.array([n[4] for n in nodes]).reshape(-1)}
        of = ball_tree.filtered(tree, centroids.astype(float))
        exact = ((points[order][:, None] - centroids) ** 2).sum(axis=2).argmin(axis=1)
        assert ((of < 0) | (of == exact)).all()
        assert (of >= 0).all() if whole else (of < 0).any()


def test_against_sql(spark):
    compare(spark, "op13_centroids", QUERIES["op13_centroids"], ORACLES["op13_centroids"])
