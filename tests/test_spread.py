"""Work on each file is dealt out to all cores, and closures have the fewest steps as depths."""

import random

from codelode import queries
from codelode.operators import graph

from .compare import SF


def test_files_are_parsed_by_all_cores(spark):
    files = queries._files(spark, SF)
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    held = files.groupBy("file_path").count()
    assert held.filter("count > 1").isEmpty() and held.count() == queries._parts(spark, SF).count()


def test_depths_of_paths_and_cycles(spark):
    r = random.Random(5)
    pairs = [(k, k + 1) for k in range(20)] + [(20, 7)] + [(r.randrange(21), r.randrange(30)) for _ in range(12)]
    to = {}
    for a, b in pairs:
        to.setdefault(a, set()).add(b)
    want = {}
    for a in range(30):
        seen, at, depth = {a}, {a}, 0
        while at:
            at, depth = {b for x in at for b in to.get(x, ())} - seen, depth + 1
            want.update({(a, b): depth for b in at})
            seen |= at
    got = graph.closure(spark.createDataFrame(pairs, "src int, dst int"))
    assert {(x.src, x.dst): x.depth for x in got.collect()} == want


def test_no_vocabulary_is_sent_whole(spark):
    from codelode.operators import evaluate

    answers = spark.createDataFrame([(1, "`known_name` and `other_name`", "known_name")], "id long, answer string, context string")
    out = evaluate.odd_identifiers(answers, spark.createDataFrame([("known_name",)], "token string"))
    assert "strategy=merge" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.collect() == [(1, "other_name", "fabricated")]


def test_facts_only_of_the_kinds_asked_for(spark):
    from codelode.functions import parse

    source = "import m2\nclass C(D):\n    def run(self):\n        f()\ndef f():\n    pass\n"
    files = spark.createDataFrame([("m1.py", source)], "file_path string, source string")
    whole = parse.facts(files)
    for kinds in (("import",), ("definition",), ("class", "import"), ("call",)):
        some = parse.facts(files, kinds=kinds)
        assert sorted(map(str, some.collect())) == sorted(map(str, whole.filter(whole.what.isin(*kinds)).collect())) != []
    assert {r.what for r in queries._facts(spark, SF, "import").select("what").distinct().collect()} == {"import"}


def test_percentiles_make_only_their_measures(spark, monkeypatch):
    from codelode import queries_evaluation
    from codelode.operators import summary

    made, measured = [], summary.measured
    monkeypatch.setattr(summary, "measured", lambda rows, wanted: made.extend(m.name for m in wanted) or measured(rows, wanted))
    assert queries_evaluation.evaluation_percentiles(spark, SF).count() > 0
    assert sorted(made) == ["latency_s", "retrieval_s"]


def test_expansion_makes_no_vectors(spark, monkeypatch):
    from codelode.functions import metrics

    monkeypatch.setattr(metrics, "hashed_embedding", lambda text: 1 / 0)
    assert queries.expand_calls(spark, "/root/testdata/sf0.001").count() > 0
