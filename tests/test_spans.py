"""Spans that overlap or contain others, by bins of their levels."""

import random
import time

import pytest
from pyspark.sql import functions as F

from codelode.operators import evaluate

SPANS, GOLD = "file string, span long, start long, end long", "file string, gold long, g_start long, g_end long"


@pytest.mark.parametrize("contain", [False, True])
def test_against_all_pairs(spark, contain):
    """All lengths from nothing to the whole file, repeats, ends before starts, negative lines and nulls."""
    r = random.Random(7)

    def some(n):
        out = []
        for k in range(n):
            at, size = r.randrange(-50, 3_000), r.choice([0, 0, 1, 3, 15, 16, 17, 200, 4_000, -3])
            out.append((r.choice(["a", "a", "b", None]), k, r.choice([at, at, at, None]) if k % 9 == 0 else at, at + size))
        return out + out[:10]

    spans, gold = some(300), some(200)
    got = evaluate.spans_meet(spark.createDataFrame(spans, SPANS), spark.createDataFrame(gold, GOLD), contain)
    assert got.columns == ["file", "span", "start", "end", "gold", "g_start", "g_end"]
    ok = (lambda s, e, a, b: s <= a and e >= b) if contain else (lambda s, e, a, b: s <= b and e >= a)
    want = [(f, i, s, e, j, a, b) for f, i, s, e in spans for g, j, a, b in gold if f is not None and f == g and None not in (s, e, a, b) and ok(s, e, a, b)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_one_file_of_many_spans(spark):
    """100,000 spans and as many gold spans of one file, which are 10^10 pairs."""
    k = F.col("id")
    spans = spark.range(100_000).select(F.lit("a").alias("file"), k.alias("span"), (k * 10).alias("start"), (k * 10 + 4).alias("end"))
    gold = spark.range(100_000).select(F.lit("a").alias("file"), k.alias("gold"), (k * 10 + 3).alias("g_start"), (k * 10 + 8 + F.when(k % 1_000 == 0, 100_000).otherwise(0)).alias("g_end"))
    begin = time.time()
    n = evaluate.spans_meet(spans, gold).count()
    long_ones = sum(min(99_999, (1_000 * j * 10 + 8 + 100_000) // 10) - 1_000 * j for j in range(100))
    assert n == 100_000 + long_ones and time.time() - begin < 120


def test_gold_reached(spark):
    spans = spark.createDataFrame([(1, "a", 1, 5), (1, "a", 1, 5), (2, "b", 1, 5), (3, "a", 90, 95)], "id long, file string, start long, end long")
    gold = spark.createDataFrame([(1, "a", 4, 9), (1, "a", 4, 9), (1, "a", 40, 41), (2, "a", 1, 5), (3, "a", 80, 100), (4, None, 1, 2)], "id long, file string, g_start long, g_end long")
    got = {r.id: (r.hit, r.complete, r.recall) for r in evaluate.gold_reached(gold, spans).collect()}
    assert got == {1: (True, False, 0.5), 2: (False, False, 0.0), 3: (True, True, 1.0), 4: (False, False, 0.0)}
