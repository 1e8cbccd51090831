"""Answers and targets without what grows with questions times files."""

from pyspark.sql import functions as F

from codelode.functions import parse
from codelode.functions.metrics import hashed_embedding
from codelode.operators import graph, retrieval
from codelode.operators.shared import settled
from codelode.plans import ask


def code_base(spark, n):
    stem = F.format_string("m%d", "id")
    scope = spark.range(n).select(stem.alias("stem"), F.col("id").alias("ord"))
    classes = spark.range(n).select(F.format_string("C%d", "id").alias("class_name"), stem.alias("stem"))
    return scope, classes


def test_targets_send_no_side_whole(spark):
    scope, classes = code_base(spark, 50)
    asked = spark.range(20).select(F.col("id").alias("question_id"), F.format_string("is C%d dangerous to edit, or m%d.py?", "id", "id").alias("question"))
    found = ask.extract_targets(asked, scope, classes)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    # C1 is a part of C12, and so is met where that is
    assert {r.question_id: r.target_files for r in found.collect()}[12] == ["m1", "m12"]


def test_digests_are_those_of_whole_answers(spark):
    scope, _ = code_base(spark, 30)
    asked = spark.createDataFrame([(1, []), (2, ["m3", "m99"]), (3, ["m99"]), (4, []), (5, ["m3"])], "question_id long, target_files array<string>")
    edges = spark.createDataFrame([("m1", "m3"), ("m2", "m3"), ("m3", "m2")], "src string, dst string")
    commits = scope.select("stem", F.lit(2).cast("long").alias("commit_count"))
    whole = {r.question_id: r for r in ask.risk_responses(asked, graph.risk_scores(edges, scope, commits), scope).collect()}
    lines = graph.risk_lines(edges, scope, commits)
    brief = {r.question_id: r for r in ask.risk_responses(asked, lines, scope, {"digest": F.md5, "chars": F.length}).withColumn("n", F.size("risk_details")).collect()}
    assert set(whole) == set(brief) == {1, 2, 3, 4, 5}
    sums = spark.createDataFrame([(k, r.answer) for k, r in whole.items()], "k long, answer string").select("k", F.md5("answer").alias("d"))
    assert {r.k: r.d for r in sums.collect()} == {k: r.digest for k, r in brief.items()}
    assert whole[3].answer.startswith("m99 isn't known. Known are: m0, m1, m10") and whole[3].risk_details is None and brief[3].risk_details is None
    assert whole[2].risk_details[0].dependent_files == ["m1", "m2"] and "dependent_files" not in lines.columns


def test_equal_vectors_are_compared_once(spark, monkeypatch):
    """Of many questions and chunks with the same few vectors only these go through the search; what is found are the nearest of all, ties by id."""
    compared = []
    plain = retrieval.vector_topk

    def counting(queries, vectors, *args):
        compared.append((queries.count(), vectors.count()))
        return plain(queries, vectors, *args)

    asked = spark.range(60).select(F.col("id").alias("question_id"), F.array(*((F.col("id") % 3 + j).cast("float") for j in range(4))).alias("embedding"))
    index = spark.range(400).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.when(F.col("id") % 50 > 0, F.array(*((F.col("id") % 7 * j % 5).cast("float") for j in range(4)))).alias("embedding"))
    want = {tuple(r) for r in plain(asked, index, 12, "question_id", "chunk_id").collect()}
    monkeypatch.setattr(retrieval, "vector_topk", counting)
    assert {tuple(r) for r in retrieval.distinct_topk(asked, index, 12, "question_id", "chunk_id").collect()} == want
    assert len(want) == 60 * 12 and compared == [(3, 5)]


def test_repeated_ids_and_no_numbers(spark):
    """An id with two vectors keeps both, and a vector with a component that is no number takes no other's place."""
    rows = [(1, [0.0, 0.0]), (1, [3.0, 0.0]), (2, [3.0, 0.0]), (3, [float("nan"), 0.0]), (4, None), (5, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [0.0, 0.0]), (8, [0.0, 0.0])], "query_id long, embedding array<double>")
    for found in (retrieval.vector_topk, retrieval.distinct_topk):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.distance) for r in found(asked, vectors, 4).collect()}
        assert got == {(q, k): hit for q in (7, 8) for k, hit in enumerate([(1, 0.0), (5, 1.0), (1, 9.0), (2, 9.0)], 1)}


def test_questions_retrieve_once(spark, monkeypatch):
    """What is retrieved is written, not searched for again by contexts, notes and details."""
    written = []
    monkeypatch.setattr(ask, "settled", lambda df, label: written.append(label) or settled(df, label))
    scope, classes = code_base(spark, 8)
    chunks = spark.range(8).select(F.format_string("m%d.py", "id").alias("file_path"), F.lit("function").alias("chunk_type"), F.format_string("f%d", "id").alias("name"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.format_string("def f%d():\n    pass", "id").alias("text"), F.lit(None).cast("string").alias("parent_class"))
    edges = spark.createDataFrame([("m1", "m3")], "src string, dst string")
    risk = graph.risk_lines(edges, scope, scope.select("stem", F.lit(2).cast("long").alias("commit_count")))
    base = ask.CodeBase(scope, risk, classes, retrieval.chunk_index(chunks, hashed_embedding), spark.createDataFrame([], "caller string, callee string"))
    asked = spark.createDataFrame([(1, "what does f3 do, def f3?")], "question_id long, question string")
    assert ask.explain(asked, base).first().answer.startswith("Relevant code: f3, lines 1-2")
    assert written.count("retrieved") == 1


def test_one_parse_gives_facts_and_chunks(spark):
    """Chunks among the facts are those of a parse of their own, and a file is parsed once for both."""
    source = "import os\nfrom m2 import f2\n\nclass C1(C2):\n    def run(self):\n        f2(1)\n" + "".join(f"\ndef f{k}(x):\n    return [f2(x), {'x + ' * 400}1]\n" for k in range(3)) + "    # " + "z" * 2000 + "\n    return 1\n"
    files = spark.createDataFrame([("m1.py", source), ("m2.py", ""), ("a/m3.py", "try:\n    import x\nexcept ImportError:\n    import y\nfinally:\n    import z\n")], "file_path string, source string")
    known = parse.facts(files, kinds=(*parse.CALL_FACTS, "chunk"))
    both = [sorted(map(tuple, df.collect()), key=str) for df in (parse.known_chunks(known), parse.chunks(files))]
    assert both[0] == both[1] and {r[1] for r in both[0]} >= {"class", "split", "module_level"}
    assert {tuple(r) for r in parse.imports(known).collect()} == {("m1", 0, "os"), ("m1", 1, "m2"), ("a.m3", 0, "x"), ("a.m3", 1, "z")}
    parse._tree.cache_clear()
    parse.facts_of("m1.py", source, kinds=(*parse.CALL_FACTS, "chunk"))
    assert parse._tree.cache_info().misses == 1
