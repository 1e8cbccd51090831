"""Parsing, call graph, imports, risk, retrieval and answers on small sources written for the purpose."""

import logging
import os
import random

import pytest
from pyspark.sql import functions as F

from codelode.functions import metrics as M
from codelode.functions import parse
from codelode.operators import evaluate, graph, retrieval
from codelode.plans import ask, errors
from codelode.sources import code
from codelode.streaming.refresh import latest_chunks, refresh_chunks, refresh_folder


def graph_of(spark, **sources):
    files = spark.createDataFrame([(f"{n.replace('__', '/')}.py", s) for n, s in sources.items()], "file_path string, source string")
    facts = parse.facts(files)
    edges, missed = graph.call_graph(parse.call_sites(facts), parse.definitions(facts), parse.classes(facts), parse.imports(facts))
    return {tuple(r) for r in edges.collect()}, [(r.caller, r.repr) for r in missed.collect()]


def test_calls_of_self_subclasses_super_and_constructors(spark):
    base = "class A:\n def go(self):\n  self.step()\n def step(self): pass\n def __init__(self): pass\n"
    kids = "class B(A):\n def step(self):\n  super().step()\nclass C(A):\n def step(self): pass\ndef make():\n B()\n C.other()\n"
    edges, missed = graph_of(spark, m=base + kids)
    assert edges == {("m.py::A.go", f"m.py::{c}.step") for c in "ABC"} | {("m.py::B.step", "m.py::A.step"), ("m.py::make", "m.py::A.__init__")}
    assert missed == [("m.py::make", "C.other(...)")]


def test_calls_across_files_and_folders(spark):
    edges, missed = graph_of(spark, a="from b import f\nfrom pkg.c import g\ndef run():\n f()\n g()\n h()\n x.y()\n", b="def f(): pass\n", pkg__c="def g():\n return lambda: f()\ndef f(): pass\n")
    assert edges == {("a.py::run", "b.py::f"), ("a.py::run", "pkg/c.py::g"), ("pkg/c.py::g", "pkg/c.py::f")}
    assert sorted(missed) == [("a.py::run", "h(...)"), ("a.py::run", "x.y(...)")]


def test_first_import_wins_and_cycles_of_classes_end(spark):
    edges, _ = graph_of(spark, a="import c\nimport b\ndef run(): f()\n", b="def f(): pass\n", c="def f(): pass\n", d="class X(Y):\n def go(self): self.nope()\nclass Y(X): pass\n")
    assert edges == {("a.py::run", "c.py::f")}


def test_file_that_does_not_parse_is_an_error_that_may_pass(spark):
    assert parse.UnparsableSource.retryable
    with pytest.raises(Exception, match="m.py"):
        graph_of(spark, m="def (:\n")


def chunked(source):
    return [(kind, name, a, b, parent) for _, kind, name, a, b, _, parent in parse.chunks_of("m.py", source)]


def test_chunks_of_small_and_large_definitions():
    small = "import os\n\n@deco\ndef f():\n    pass\nasync def g():\n    pass\nclass A:\n    x = 1\n    def m(self): pass\n\nY = 2\n"
    assert chunked(small) == [("function", "f", 4, 5, None), ("async_function", "g", 6, 7, None), ("class", "A", 8, 10, None), ("module_level", "<module>", 1, 12, None)]
    body = "\n".join(f"        v{k} = '{k:060d}'" for k in range(30))
    large = f"class A:\n    'doc'\n    def m(self):\n{body}\n    async def n(self):\n        pass\n    class Inner: pass\n"
    got = chunked(large)
    assert [g[:2] for g in got] == [("split", "m[part 1/2]"), ("split", "m[part 2/2]"), ("async_function", "n")] and all(g[4] == "A" for g in got)
    (first, second) = got[:2]
    assert first[2] == 3 and second[3] == 33 and second[2] == first[3] - parse.OVERLAP_LINES + 1
    assert chunked("") == [] and chunked("\n\n") == []


def test_size_gate_is_inclusive():
    assert parse.is_small("x" * 1603) and not parse.is_small("x" * 1604)


def test_windows_cover_every_line_and_move_on():
    rnd = random.Random(1)
    for _ in range(200):
        lines = ["x" * rnd.choice([0, 1, 30, 700, 4000]) for _ in range(rnd.randrange(60))]
        spans = parse.windows(lines)
        assert sorted({k for a, b in spans for k in range(a, b)}) == list(range(len(lines)))
        for (a, b), (c, d) in zip(spans, spans[1:]):
            assert c == max(b - 3, a + 1) and d >= b
        for a, b in spans:
            assert sum(len(x) + 1 for x in lines[a : b - 1]) < 1600 and (b == len(lines) or sum(len(x) + 1 for x in lines[a:b]) >= 1600)


def imported(source, **more):
    return [m for _, _, m in parse.imports_of("m.py", source, "lib", **more)]


def test_imports_that_run():
    assert imported("import a, lib._x\nfrom lib.b import c\nfrom . import d\nfrom .e import f\n") == ["a", "lib._x", "b", "e"]
    guarded = "if TYPE_CHECKING:\n import a\nelse:\n import b\nif typing.TYPE_CHECKING:\n import c\ndef f():\n import d\n if x:\n  import e\n else:\n  import g\n"
    assert imported(guarded) == ["b", "d", "e", "g"]
    tried = "try:\n import a\nexcept E:\n import b\nelse:\n import c\nfinally:\n import d\nmatch x:\n case 1:\n  import e\nwith y:\n import g\n"
    assert imported(tried) == ["a", "c", "d", "g"]
    assert imported(tried, everywhere=True) == ["a", "b", "c", "d", "e", "g"]
    assert [m for _, _, m in parse.relative_imports_of("m.py", "from . import a, b\nfrom .c import d\nfrom ..e import f\nimport g\nif TYPE_CHECKING:\n from .h import i\nelse:\n from .j import k\n")] == ["a", "b", "c", "j"]


def test_import_graph_keeps_to_the_scope(spark):
    imports = spark.createDataFrame([("a", 0, "b"), ("a", 1, "b"), ("a", 2, "os"), ("b", 0, "b"), ("c", 0, "a"), ("zz", 0, "a")], "stem string, seq int, module string")
    assert {tuple(r) for r in graph.import_edges(imports, code.scope_table(spark, ["a.py", "b", "c", "d"])).collect()} == {("a", "b"), ("c", "a")}
    with pytest.raises(ValueError):
        code.scope_table(spark, [])


@pytest.mark.parametrize(
    "edges,commits,levels",
    [
        ([("client", "types")], {"types": 5, "client": 100}, {"types": "high", "client": "low"}),
        ([("client", "types")], {"types": 100, "client": 5}, {"types": "medium", "client": "low"}),
        ([("client", "types")], {"types": 5, "client": 5}, {"types": "high", "client": "low"}),
        ([("api", "types"), ("client", "types")], {"types": 1, "api": 100, "client": 100}, {"types": "high", "api": "high", "client": "high"}),
        ([("client", "types"), ("api", "client")], {"types": 5, "api": 5, "client": 5}, {"types": "high", "client": "high", "api": "low"}),
    ],
)
def test_risk_levels(spark, edges, commits, levels):
    scope = code.scope_table(spark, sorted(commits))
    scores = graph.risk_scores(spark.createDataFrame(edges, "src string, dst string"), scope, spark.createDataFrame(list(commits.items()), "stem string, commit_count long"))
    rows = scores.collect()
    assert {r.file: r.risk_level for r in rows} == levels
    rank = ["high", "medium", "low"]
    assert [(rank.index(r.risk_level), r.file) for r in rows] == sorted((rank.index(r.risk_level), r.file) for r in rows)
    if ("api", "client") in edges:
        assert {r.file: r.dependent_files for r in rows} == {"types": ["api", "client"], "client": ["api"], "api": []}


def test_closures_agree_and_handle_cycles(spark):
    rnd = random.Random(2)
    edges = spark.createDataFrame([(rnd.randrange(30), rnd.randrange(30)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(20)], "src int, dst int")
    one = {(r.src, r.dst): r.depth for r in graph.closure(edges).collect()}
    assert set(one) == {tuple(r) for r in graph.closure_by_frontier(edges).collect()} and one[100, 120] == 20
    assert graph.closure(edges.limit(0)).collect() == []


CHUNKS = [
    ("a.py", "split", "big[part 2/2]", 30, 50, "part two", None),
    ("a.py", "split", "big[part 1/2]", 1, 32, "part one", None),
    ("a.py", "method", "go", 60, 61, "def go", "Client"),
    ("b.py", "method", "go", 5, 6, "def go of b", "AsyncClient"),
    ("b.py", "function", "helper", 9, 10, "def helper", None),
    ("b.py", "module_level", "<module>", 1, 20, "X = 1", None),
]


def index_of(spark, vectors):
    chunks = spark.createDataFrame(CHUNKS, code.CHUNK_SCHEMA)
    index = retrieval.chunk_index(chunks, lambda text: F.lit(None).cast("array<float>")).drop("embedding")
    near = spark.createDataFrame([(n, [float(v)]) for n, v in vectors.items()], "name string, embedding array<float>")
    return index.join(near.withColumn("embedding", F.col("embedding").cast("array<float>")), "name")


def retrieved(spark, vectors, edges, question="what?"):
    questions = spark.createDataFrame([(1, question)], "question_id long, question string")
    calls = spark.createDataFrame(edges, "caller string, callee string")
    return retrieval.retrieve(questions, index_of(spark, vectors), calls, lambda q: F.array(F.lit(0.0).cast("float")))


ORDER = {"big[part 1/2]": 1, "big[part 2/2]": 2, "helper": 3, "<module>": 4, "go": 5}


def test_retrieval_dedupes_reassembles_and_expands(spark):
    rows = retrieved(spark, ORDER, [("a.py::big", "b.py::helper"), ("a.py::big", "a.py::big"), ("b.py::helper", "b.py::AsyncClient.go"), ("b.py::helper", "b.py::Gone.go")]).collect()
    got = {(r.section, r.base_name, r.parent_class): r for r in rows}
    assert set(got) == {(0, "big", ""), (0, "helper", ""), (0, "<module>", ""), (1, "go", "AsyncClient")}
    big = got[0, "big", ""]
    assert (big.text, big.start_line, big.end_line, big.place) == ("part one\npart two", 1, 50, 1)


def test_a_named_definition_is_added_once(spark):
    rows = retrieved(spark, ORDER, [("x", "y")], "what does Client.go do?").collect()
    assert sorted((r.place, r.base_name, r.parent_class) for r in rows)[-1] == (4, "go", "Client") and len(rows) == 4
    close = retrieved(spark, {**ORDER, "go": 0}, [("x", "y")], "what does Client.go do?").collect()
    assert len(close) == 3


def test_vector_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "HELD", 20)
    rnd = random.Random(3)
    rows = [(k, [float(rnd.randrange(3)) for _ in range(4)]) for k in range(90)] + [(900, None), (901, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = retrieval.vector_topk(table.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), table, 5).collect()
    real = dict(rows[:90])
    for q in range(0, 90, 10):
        want = sorted((sum((x - y) ** 2 for x, y in zip(real[q], v)), k) for k, v in real.items())[:5]
        assert sorted((r.distance, r.vec_id) for r in got if r.query_id == q) == want


def test_nodes_are_built_and_taken_apart(spark):
    parts = retrieval.node_parts(F.col("n"))
    df = spark.createDataFrame([("a/b.py", "C", "m"), ("a.py", "", "f")], "f string, c string, m string").withColumn("n", retrieval.node_of(F.col("f"), F.col("c"), F.col("m")))
    assert [tuple(r) for r in df.select("n", *parts.values()).collect()] == [("a/b.py::C.m", "a/b.py", "C", "m"), ("a.py::f", "a.py", "", "f")]


QUESTIONS = {1: "is Client safe?", 2: "look at _models.py and client.py", 3: "CLIENT.PY", 4: "models.py", 5: "_models", 6: "models", 7: "nothing", 8: "urls.py then _models, URL", 9: ""}


def test_files_named_in_questions(spark):
    scope = code.scope_table(spark, ["client", "_models", "urls", "config"])
    classes = spark.createDataFrame([("Client", "client"), ("URL", "urls"), ("Other", "elsewhere")], "class_name string, stem string")
    q = spark.createDataFrame(list(QUESTIONS.items()), "question_id int, question string")
    got = {r.question_id: r.target_files for r in ask.extract_targets(q, scope, classes).collect()}
    assert got == {1: ["client"], 2: ["_models", "client"], 3: ["client"], 4: ["_models"], 5: ["_models"], 6: [], 7: [], 8: ["urls", "_models"], 9: []}


def code_base(spark):
    files = spark.createDataFrame([("base.py", "class Base:\n    def run(self):\n        return helper()\n"), ("util.py", "import base\ndef helper():\n    return other()\ndef other():\n    return 1\n")], "file_path string, source string")
    facts = parse.facts(files)
    scope = code.scope_table(spark, ["base", "util"])
    commits = spark.createDataFrame([("base", 1), ("util", 5)], "stem string, commit_count long")
    risk = graph.risk_scores(graph.import_edges(parse.imports(facts), scope), scope, commits)
    calls = graph.call_graph(parse.call_sites(facts), parse.definitions(facts), parse.classes(facts), parse.imports(facts))[0]
    return ask.CodeBase(scope, risk, graph.class_to_file(parse.classes(facts)), retrieval.chunk_index(parse.chunks(files), M.hashed_embedding), calls)


def test_questions_are_answered_by_their_branch(spark):
    said = [(1, "how risky is it to change base.py?"), (2, "what is the impact?"), (3, "what does helper return?"), (4, "is it dangerous to edit util.py or Base?")]
    got = {r.question_id: r for r in ask.ask(spark.createDataFrame(said, "question_id long, question string"), code_base(spark)).collect()}
    high = "base.py: HIGH risk -- 1 files depend on it, and with 1 commits it is seldom changed"
    low = "util.py: LOW risk -- only 0 files depend on it"
    assert got[1].answer == high and got[1].intent == "risk_assessment" and [d.file for d in got[1].risk_details] == ["base"] and got[1].citations == []
    assert got[2].answer == "Which file do you mean? Known are: base, util" and got[2].risk_details is None
    assert got[4].answer == f"{low}\n\n{high}"
    assert got[3].intent == "code_explanation" and "util.py :: helper (lines 2-3)" in got[3].citations and "[helper, lines 2-3]"[1:7] in got[3].answer
    assert got[3].answer.startswith("Relevant code: ")
    with pytest.raises(Exception, match="validation_error"):
        ask.ask(spark.createDataFrame([(1, "")], "question_id long, question string"), code_base(spark)).collect()


def test_citations_and_context(spark):
    rows = spark.createDataFrame([(1, 0, 1, "a.py", "C", "m", 3, 4, "body"), (1, 1, 1, "b.py", "", "f", 5, 6, "more")], "query_id int, section int, place int, file_path string, parent_class string, base_name string, start_line int, end_line int, text string")
    (r,) = retrieval.context_text(retrieval.cited(rows)).collect()
    assert r.context == "[C.m, lines 3-4]\nbody\n\n[f, lines 5-6]\nmore" and r.citations == ["a.py :: C.m (lines 3-4)", "b.py :: f (lines 5-6)"]


def test_retries_fallback_and_error_kinds():
    waits, tries = [], []

    def failing(error, times):
        def call(x):
            tries.append(x)
            if len(tries) <= times:
                raise error
            return x

        return call

    assert errors.with_retries(failing(errors.ModelUnavailable(), 2), sleep=waits.append)(7) == 7 and waits == [1.0, 2.0]
    tries.clear()
    with pytest.raises(errors.ModelUnavailable):
        errors.with_retries(failing(errors.ModelUnavailable(), 9), sleep=waits.append)(7)
    assert len(tries) == 3
    tries.clear()
    assert errors.with_retries(failing(errors.RateLimited(), 1), fallback=lambda x: -x, sleep=waits.append)(7) == -7
    assert isinstance(errors.classified(KeyError("k")), errors.InternalError) and isinstance(errors.classified(OSError()), errors.ModelUnavailable)
    tries.clear()
    assert errors.attempted(lambda: failing(errors.DataUnavailable(), 1)(5), sleep=waits.append)[:2] == (5, 2) and waits[-1] == 30.0
    result, n, error = errors.attempted(lambda: 1 / 0, sleep=waits.append)
    assert result is None and error.retryable and n == 1
    assert errors.attempted(lambda: 1 / 0, sleep=waits.append, any_error=True)[1] == 3
    log = logging.getLogger("t")
    seen = []
    log.handle = lambda record: seen.append(record.levelname)
    errors.logged(errors.RateLimited("x"), log)
    errors.logged(errors.InternalError("x"), log)
    assert seen == ["WARNING", "ERROR"] and errors.RateLimited("x").response() == {"error_code": "rate_limited", "message": "x", "retryable": True}


def test_sources_chunk_table_rows_and_stages(spark, tmp_path):
    folder, path = tmp_path / "src", str(tmp_path / "chunks")
    (folder / "sub").mkdir(parents=True)
    (folder / "same.py").write_text("def f(): pass\n")
    (folder / "sub" / "same.py").write_text("def g(): pass\n")
    files = code.read_sources(spark, str(folder), recursive=True)
    assert {(r.file_path, r.stem) for r in files.collect()} == {("same.py", "same"), ("sub/same.py", "sub.same")}
    assert [r.file_path for r in code.in_scope(code.read_sources(spark, str(folder)), code.scope_table(spark, ["same.py"])).collect()] == ["same.py"]
    index = retrieval.chunk_index(parse.chunks(files), M.hashed_embedding)
    with pytest.raises(errors.IndexUnavailable):
        code.read_chunks(spark, path)
    assert code.add_chunks(spark, index.unionByName(index), path).count() == 2
    assert code.add_chunks(spark, index, path).count() == 2 and code.read_chunks(spark, path).count() == 2
    rows = str(tmp_path / "rows")
    code.write_rows(spark.createDataFrame([("b", ["x"], ['["p","q"]', "r"]), ("a", [], [])], "id string, gold array<string>, must_mention array<string>"), rows)
    read = code.read_queries(spark, rows).collect()
    assert [r.id for r in read] == ["a", "b"] and read[1].must_mention == [["p", "q"], ["r"]] and code.read_queries(spark, rows, 1).count() == 1
    made = []
    for _ in range(2):
        assert code.resumable(spark, str(tmp_path / "stage"), lambda: made.append(1) or spark.range(3)).count() == 3
    assert made == [1]
    assert "| a | 1 |" in code.write_report({"T": spark.createDataFrame([("a", 1)], "k string, n int")}, str(tmp_path / "report"))


def test_refreshed_files_replace_their_chunks(spark, tmp_path):
    folder, path, state = tmp_path / "src", str(tmp_path / "chunks"), str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.py").write_text("def f(): pass\n")
    refresh_chunks(spark, str(folder), path, state).awaitTermination()
    (folder / "b.py").write_text("def g(): pass\n")
    refresh_chunks(spark, str(folder), path, state).awaitTermination()
    assert {(r.file_path, r.name, r.version) for r in latest_chunks(spark, path).collect()} == {("a.py", "f", 0), ("b.py", "g", 1)}


def test_refresh_by_content(spark, tmp_path):
    """Edited, emptied, deleted, touched and new files; a run that was killed before its manifest; older versions."""
    folder, path = tmp_path / "src", str(tmp_path / "chunks")
    folder.mkdir()
    now = lambda version=None: {(r.file_path, r.name, r.version) for r in latest_chunks(spark, path, version).collect()}
    assert now() == set()
    for name in "abcd":
        (folder / f"{name}.py").write_text(f"def {name}(): pass\n")
    assert refresh_folder(spark, str(folder), path) == 0 and now() == {(f"{x}.py", x, 0) for x in "abcd"}
    os.utime(folder / "a.py", (1, 1))
    assert refresh_folder(spark, str(folder), path) == 0
    (folder / "b.py").write_text("def other(): pass\n")
    (folder / "c.py").write_text("")
    (folder / "d.py").unlink()
    (folder / "e.py").write_text("def e(): pass\n")
    assert refresh_folder(spark, str(folder), path) == 1
    after = {("a.py", "a", 0), ("b.py", "other", 1), ("e.py", "e", 1)}
    assert now() == after and now(0) == {(f"{x}.py", x, 0) for x in "abcd"}
    (folder / "e.py").unlink()
    assert refresh_folder(spark, str(folder), path) == 2 and now() == after - {("e.py", "e", 1)}
    (tmp_path / "chunks" / "manifest" / "v=2" / "_SUCCESS").unlink()
    assert now() == after and refresh_folder(spark, str(folder), path) == 2 and now() == after - {("e.py", "e", 1)}


def test_notes_on_risky_files(spark):
    """Files of primaries at high risk are noted once each, in the order of places; others aren't."""
    primary = spark.createDataFrame([(1, 2, "a.py"), (1, 1, "lib/b.py"), (1, 3, "a.py"), (2, 1, "c.py")], "query_id int, place int, file_path string")
    risk = spark.createDataFrame([("a", "high", "many use it"), ("lib.b", "high", "some use it"), ("c", "medium", "few")], "file string, risk_level string, rationale string")
    assert {r.query_id: r.risk_notes for r in retrieval.risk_notes(primary, risk).collect()} == {1: ["lib.b.py: some use it", "a.py: many use it"]}


def test_expressions(spark):
    row = spark.createDataFrame([("see `A.run` and do_it, BigThing\n\nNote: hidden_x", 3, 4)], "t string, k long, n long").select(
        M.identifiers(F.col("t")).alias("ids"), M.abstains(F.lit("The context does not contain that")).alias("no"), M.abstains(F.col("t")).alias("yes"), M.rate(F.col("k"), F.col("n")).alias("r"), M.rate(F.lit(0), F.lit(0)).alias("none"), code.with_suffix(F.lit("a")).alias("s")
    ).first()
    assert (row.ids, row.no, row.yes, row.none, row.s) == (["run", "do_it", "BigThing"], True, False, "n/a", "a.py") and row.r.startswith("3/4 = 75% (95% CI 30–95%)")
    v = spark.range(1).select(M.hashed_embedding(F.lit("a b a")).alias("v"), M.hashed_embedding(F.lit("")).alias("z")).first()
    assert abs(sum(x * x for x in v.v) - 1) < 1e-6 and not any(v.z) and len(v.v) == 64
    assert evaluate.exact_medians(spark.createDataFrame([(k, None) for k in (1, 9, 4, 2, None)], "x long, y long"), ["x", "y"]) == {"x": 3.0, "y": None}
