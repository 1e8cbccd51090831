"""Tables of code bases kept by fingerprint, and evaluations as written files."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from codelode import queries_evaluation
from codelode.functions import metrics as M
from codelode.functions import parse
from codelode.operators import summary
from codelode.plans import ask, shared_tables

SOURCES = {"a.py": "import b\nclass A:\n    def run(self):\n        self.run()\n", "b.py": "def f():\n    return 1\n", "empty.py": "", "lib/c.py": "from a import A\n"}


def files(spark, sources):
    return spark.createDataFrame(list(sources.items()), "file_path string, source string")


def parsed(catalog):
    """(file, digest) pairs of every run, with repeats."""
    return sorted(r.file_path for p in catalog.complete("facts") for r in catalog.spark.read.parquet(p).select("file_path", "digest").distinct().collect())


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_only_changed_files_are_parsed(spark, tmp_path):
    catalog = shared_tables.Catalog(spark, str(tmp_path / "catalog"))
    assert rows(catalog.facts(files(spark, SOURCES))) == rows(parse.facts(files(spark, SOURCES))) and parsed(catalog) == sorted(SOURCES)
    catalog.facts(files(spark, SOURCES))
    assert parsed(catalog) == sorted(SOURCES)
    edited = {**SOURCES, "b.py": "def g():\n    return 2\n"}
    del edited["lib/c.py"]
    assert rows(catalog.facts(files(spark, edited))) == rows(parse.facts(files(spark, edited))) and parsed(catalog) == sorted([*SOURCES, "b.py"])
    assert rows(catalog.facts(files(spark, SOURCES))) == rows(parse.facts(files(spark, SOURCES))) and parsed(catalog) == sorted([*SOURCES, "b.py"])


def test_a_killed_run_leaves_nothing_that_is_read(spark, tmp_path):
    catalog = shared_tables.Catalog(spark, str(tmp_path / "catalog"))
    catalog.facts(files(spark, SOURCES))
    run = Path(catalog.complete("facts")[0].removeprefix("file:"))
    (run / "_SUCCESS").unlink()
    assert catalog.complete("facts") == [] and rows(catalog.facts(files(spark, SOURCES))) == rows(parse.facts(files(spark, SOURCES)))


def test_tables_by_fingerprint(spark, tmp_path):
    catalog, made = shared_tables.Catalog(spark, str(tmp_path / "catalog")), []
    scope = spark.createDataFrame([("a", 0), ("b", 1)], "stem string, ord int")
    commits = spark.createDataFrame([("a", 3), ("b", 1)], "stem string, commit_count long")
    embed = lambda text: made.append(1) or M.hashed_embedding(text)
    asked = spark.createDataFrame([(1, "what does A.run do?"), (2, "how risky is a change of b.py?")], "question_id long, question string")
    first = rows(ask.ask(asked, catalog.code_base(files(spark, SOURCES), scope, commits, embed)).select("question_id", "answer"))
    again = rows(ask.ask(asked, catalog.code_base(files(spark, SOURCES), scope, commits, embed)).select("question_id", "answer"))
    assert first == again and len(made) == 1 and [len(catalog.complete(n)) for n in ("risk", "calls", "index")] == [1, 1, 1]
    more = spark.createDataFrame([("a", 9), ("b", 1)], "stem string, commit_count long")
    catalog.code_base(files(spark, SOURCES), scope, more, embed)
    assert [len(catalog.complete(n)) for n in ("risk", "calls", "index")] == [2, 1, 1] and len(made) == 1
    assert catalog.forget("risk", 1) == 1 and len(catalog.complete("risk")) == 1
    assert shared_tables.fingerprint(scope, "stem") == shared_tables.fingerprint(scope.orderBy(F.desc("stem")).repartition(3), "stem") != shared_tables.fingerprint(scope.limit(1), "stem")


def test_written_evaluation(spark, tmp_path):
    some = queries_evaluation._rows(spark, "/root/testdata/sf0.001")
    summary.write_evaluation(some, str(tmp_path), {"generator": "offline", "when": "now"})
    read = lambda name: [json.loads(x) for p in sorted((tmp_path / name).glob("*.json")) for x in p.read_text().splitlines()]
    table = {(x["measure"], x["slice"]): x for x in read("summary.json")}
    n = some.count()
    assert read("meta.json") == [{"n_queries": n, "generator": "offline", "when": "now"}]
    assert table["completed", "all"]["n"] == n and table["completed", "all"]["rate"].startswith(f"{some.filter('error IS NULL').count()}/{n} = ")
    assert table["latency_s", "all"]["p50"] <= table["latency_s", "all"]["p95"] and len(read("failures.json")) == summary.failures(summary.measured(some, summary.measures())).count()
    none = summary.summary(summary.measured(some.limit(0), summary.measures()))
    assert none.filter("n > 0").count() == 0
