"""Counts of dependents by bitmaps against both closures."""

import random

import pytest

from codelode.operators import graph


def edges_of(kind):
    r = random.Random(kind)
    if kind == 0:  # large cycles that lead into each other, and a tail
        return [(k, (k + 1) % 6) for k in range(6)] + [(3, 20)] + [(20 + k, 20 + (k + 1) % 7) for k in range(7)] + [(25, 40), (40, 41)]
    if kind == 1:  # a hub that all lead to and that leads on
        return [(k, 1_000) for k in range(200)] + [(1_000, 2_000), (2_000, 1_000), (2_000, 2_000)]
    return [(r.randrange(60), r.randrange(60)) for _ in range(r.choice([30, 70, 150]))]


@pytest.mark.parametrize("kind", range(5))
def test_counts_equal_both_closures(spark, kind):
    edges = spark.createDataFrame([(f"m{a}", f"m{b}") for a, b in edges_of(kind) * 2], "src string, dst string")
    scope = spark.createDataFrame([(f"m{k}",) for k in [*range(61), 1_000, 2_000, 9_999]], "stem string")
    want = {}
    for r in graph.closure(edges).collect():
        want.setdefault(r.dst, set()).add(r.src)
    again = {}
    for r in graph.closure_by_frontier(edges).collect():
        again.setdefault(r.dst, set()).add(r.src)
    assert want == again
    got = {r.stem: r.dependents for r in graph.dependent_counts(edges, scope).collect()}
    assert got == {r.stem: len(want.get(r.stem, ())) for r in scope.collect()}
    some = scope.filter("stem IN ('m3', 'm25', 'm1000', 'm9999')")
    assert {r.stem: r.dependent_files for r in graph.dependents_of(edges, some).collect()} == {r.stem: sorted(want.get(r.stem, ())) for r in some.collect()}


def test_without_edges(spark):
    scope = spark.createDataFrame([("a",)], "stem string")
    assert graph.dependent_counts(spark.createDataFrame([], "src string, dst string"), scope).collect() == [("a", 0)]


def test_more_nodes_than_a_bitmap_holds(spark):
    """70,000 files that one imports through another: three bitmaps, no 70,000 pairs for each."""
    from pyspark.sql import functions as F

    k = F.col("id")
    leaves = spark.range(70_000).select(F.format_string("f%d", k).alias("src"), F.lit("hub").alias("dst"))
    edges = leaves.unionByName(spark.createDataFrame([("hub", "base"), ("base", "core")], "src string, dst string"))
    scope = spark.createDataFrame([("hub",), ("base",), ("core",), ("f7",)], "stem string")
    assert {r.stem: r.dependents for r in graph.dependent_counts(edges, scope).collect()} == {"hub": 70_000, "base": 70_001, "core": 70_002, "f7": 0}


def test_few_dependents_take_few_bytes(spark, monkeypatch):
    """What is kept between rounds has no row for which there is no pair, and none of kilobytes."""
    kept = []
    settled = graph.settled

    def record(df, label="settled"):
        out = settled(df, label)
        if label in ("bits", "bitmaps"):
            kept.append((out.count(), {f.dataType.simpleString() for f in out.schema.fields}))
        return out

    monkeypatch.setattr(graph, "settled", record)
    edges = spark.createDataFrame([(f"m{k}", f"m{k + 1}") for k in range(0, 60, 3)] + [(f"m{k}", f"m{k + 2}") for k in range(0, 60, 3)] + [("m1", "m61")], "src string, dst string")
    scope = spark.createDataFrame([("m0",), ("m1",), ("m61",)], "stem string")
    assert {r.stem: r.dependents for r in graph.dependent_counts(edges, scope).collect()} == {"m0": 0, "m1": 1, "m61": 2}
    assert kept and all("binary" not in kinds for _, kinds in kept) and kept[-1][0] <= 42


def scored(spark):
    """A chain of 150 files with a cycle and a hub, their scope and commits."""
    pairs = [(k, k + 1) for k in range(149)] + [(149, 140), (9, 200), (3, 200), (200, 70)]
    edges = spark.createDataFrame([(f"m{a}", f"m{b}") for a, b in pairs], "src string, dst string")
    scope = spark.createDataFrame([(f"m{k}",) for k in [*range(150), 200, 300]], "stem string")
    to = {}
    for a, b in pairs:
        to.setdefault(b, set()).add(a)
    want = {}
    for k in [*range(150), 200, 300]:
        seen, at = set(), {k}
        while at:
            at = {b for x in at for b in to.get(x, ())} - seen
            seen |= at
        want[f"m{k}"] = sorted(f"m{x}" for x in seen - {k})
    return edges, scope, scope.selectExpr("stem", "2L AS commit_count"), want


def test_lists_come_from_a_closure_of_numbers(spark, monkeypatch):
    edges, scope, _, want = scored(spark)
    kinds, closure = [], graph.closure
    monkeypatch.setattr(graph, "closure", lambda e: kinds.append({f.dataType.simpleString() for f in e.schema.fields}) or closure(e))
    assert {r.stem: (r.dependents, r.dependent_files) for r in graph.dependents(edges, scope).collect()} == {k: (len(v), v) for k, v in want.items()}
    assert {r.stem: r.dependents for r in graph.reached_counts(edges, scope).collect()} == {k: len(v) for k, v in want.items()}
    assert kinds == [{"bigint"}] * 2


def test_recomputation_reads_no_pairs(spark, monkeypatch):
    edges, scope, commits, _ = scored(spark)
    scores = graph.risk_levels(edges, scope, commits).selectExpr("file", "dependents + if(file IN ('m7', 'm200'), 1, 0) AS dependents", "commit_count", "risk_level").filter("file <> 'm11'")
    scores = scores.localCheckpoint()
    for name in ("closure", "closure_by_frontier"):
        monkeypatch.setattr(graph, name, lambda e: 1 / 0)
    assert {tuple(r) for r in graph.risk_mismatches(scores, edges, scope, commits).collect()} == {("m7", "other numbers"), ("m200", "other numbers"), ("m11", "no score")}
