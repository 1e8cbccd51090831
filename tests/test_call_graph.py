"""The call graph reads only what it needs, and leads no call on after something was found for it."""

import ast
import inspect

from codelode import queries
from codelode.functions import parse
from codelode.operators import graph

SOURCES = {
    "a.py": "import os, b\nfrom typing import Any\nclass A(Z):\n def go(self):\n  self.step(); self.nope(); super().go()\n  f(); g(); h(); A(); len([]); os.getcwd(); (lambda: f())()\n def __init__(self): pass\ndef f(): pass\n",
    "b.py": "def g(): self.x()\nclass B(A):\n def step(self):\n  super().go(); super().nope()\n  f()\n",
}


def _graph(facts):
    edges, missed = graph.call_graph(parse.call_sites(facts), parse.definitions(facts), parse.classes(facts), parse.imports(facts))
    return edges, missed


def test_calls_need_no_texts_of_definitions(spark):
    files = spark.createDataFrame(list(SOURCES.items()), "file_path string, source string")
    few, whole = parse.facts(files, kinds=parse.CALL_FACTS), parse.facts(files)
    assert {(r.kind, r.text) for r in few.filter("what = 'definition'").collect()} == {("function", None)}
    got, want = ([sorted(map(tuple, df.collect())) for df in _graph(f)] for f in (few, whole))
    assert got == want and want[0]
    reasons = {(r[0].split("::")[1], r[2]): r[3] for r in want[1]}
    assert reasons == {
        ("A.go", "self.nope(...)"): "no class of the hierarchy defines it",
        ("A.go", "<expr>.go(...)"): "no ancestor defines it",
        ("B.step", "<expr>.nope(...)"): "no ancestor defines it",
        ("A.go", "h(...)"): "no function or class of that name is known here",
        ("A.go", "len(...)"): "no function or class of that name is known here",
        ("A.go", "os.getcwd(...)"): "the receiver's type isn't known",
        ("A.go", "<unknown call>"): "the receiver's type isn't known",
        ("g", "self.x(...)"): "self outside a class",
        ("B.step", "f(...)"): "no function or class of that name is known here",
    }


def test_imports_of_no_known_file_meet_no_call(spark):
    """Before its join with calls, imports are cut to files that define functions; unresolved calls are grouped by no key of theirs."""
    files = spark.createDataFrame(list(SOURCES.items()), "file_path string, source string")
    for df in _graph(parse.facts(files)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join LeftSemi, (other#" in plan
    assert "Aggregate [caller#" not in plan


def test_queries_of_calls_read_only_their_facts(spark, monkeypatch):
    asked, facts = [], parse.facts
    monkeypatch.setattr(parse, "facts", lambda files, *a, kinds=parse.FACTS, **k: asked.append(kinds) or facts(files, *a, kinds=kinds, **k))
    for query in (queries.call_edges, queries.unresolved_calls):
        assert query(spark, "/root/testdata/sf0.001").count() > 0
    assert asked == [parse.CALL_FACTS] * 2


def test_nodes_are_walked_in_their_order():
    tree = ast.parse(inspect.getsource(parse))
    assert parse.walk(tree) == [n for n in ast.walk(tree) if not isinstance(n, ast.expr_context)]
