"""Registered queries of the code-intelligence operators over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries_evaluation, queries_graph, queries_text, queries_vectors
from .functions import metrics as M
from .functions import parse
from .operators import evaluate, graph, retrieval
from .operators.shared import settled, spread
from .plans import ask
from .sources import code


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _topk(spark, sf, k=12):
    v = _t(spark, sf, "embeddings")
    q = v.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.vector_topk(q, v, k)


def vector_topk(spark, sf):
    return _topk(spark, sf).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def _labelled_hits(spark, sf):
    return _topk(spark, sf).join(_t(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")


def dedupe_then_cut(spark, sf):
    return retrieval.dedupe_then_cut(_labelled_hits(spark, sf), ["label"]).select("query_id", "label", "vec_id", F.col("place").cast("long").alias("place"))


def boost_append(spark, sf):
    hits = _labelled_hits(spark, sf).withColumns({"question": F.concat(F.lit("what does Class"), F.pmod(F.floor(F.col("query_id") / 100), F.lit(10)).cast("string"), F.lit(".run do")), "identifier": F.concat(F.lit("Class"), "label", F.lit(".run"))})
    chosen = retrieval.dedupe_then_cut(hits, ["label"])
    return retrieval.boost(hits, chosen, "question", "identifier", ["label"]).select("query_id", "label", "vec_id")


def naive_top3(spark, sf):
    return _topk(spark, sf, 3).join(_t(spark, sf, "embeddings").select("vec_id", "label"), "vec_id").filter("label <> 0").select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


def risk_gate(spark, sf):
    per = _t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("dependents"), F.count(F.lit(1)).alias("commit_count"))
    return graph.risk_gate(per).select("l_partkey", "dependents", "commit_count", "risk_level")


def _edges(spark, sf):
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    return n.select(F.col("k").alias("src"), F.pmod(F.col("k") * 3 + 1, F.lit(25)).cast("int").alias("dst")).unionByName(n.filter("k % 4 = 0").select(F.col("k").alias("src"), F.pmod(F.col("k") + 7, F.lit(25)).cast("int").alias("dst")))


def transitive_dependents(spark, sf):
    c = graph.closure(_edges(spark, sf))
    return c.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("dependents"), F.array_join(F.transform(F.sort_array(F.collect_set("src")), lambda x: x.cast("string")), ",").alias("dependent_files"))


def _lines(spark, sf):
    d = _t(spark, sf, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def line_chunks(spark, sf):
    return parse.text_windows(_t(spark, sf, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), F.col("part_no").cast("long").alias("part_no"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.length("text").cast("long").alias("n_chars"))


def reassemble(spark, sf):
    parts = _lines(spark, sf).select("doc_id", F.col("line").alias("text"), F.col("pos").alias("part_no"), F.col("pos").alias("start_line"), F.col("pos").alias("end_line"))
    whole = retrieval.reassemble(parts, ["doc_id"])
    return whole.select("doc_id", F.md5("text").alias("text_md5"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


#: Lines of so many characters count as covered.
LONG_LINE = 80


def leftover_lines(spark, sf):
    covered = _lines(spark, sf).filter(F.length("line") >= LONG_LINE).select("doc_id", "pos")
    rest = _lines(spark, sf).join(covered, ["doc_id", "pos"], "left_anti").filter(F.trim("line") != "")
    return rest.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"), F.min("pos").cast("long").alias("first"), F.max("pos").cast("long").alias("last"))


def token_vocab_antijoin(spark, sf):
    return evaluate.unknown_tokens(_t(spark, sf, "benchmark"), _t(spark, sf, "documents"))


def token_vocabulary(spark, sf):
    b = _t(spark, sf, "benchmark").select(F.explode(M.tokens(F.col("text"))).alias("token"))
    return b.groupBy("token").agg(F.count(F.lit(1)).alias("items"))


def _spans(spark, sf):
    li = _t(spark, sf, "lineitem")
    start = F.col("l_linenumber") * 10
    spans = li.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("span"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"), (F.col("l_linestatus") == "F").alias("found"))
    gold = li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("gold"), (start + 5).alias("g_start"), (start + 15).alias("g_end"))
    return spans, gold


def span_overlap(spark, sf):
    return evaluate.spans_meet(*_spans(spark, sf)).select("file", "span", "gold")


def span_containment(spark, sf):
    return evaluate.spans_meet(*_spans(spark, sf), contain=True).select("file", "span", "gold")


def gold_reached(spark, sf):
    spans, gold = _spans(spark, sf)
    one = spans.filter("found").select(F.col("file").alias("id"), "file", "start", "end")
    r = evaluate.gold_reached(gold.select(F.col("file").alias("id"), "file", "g_start", "g_end"), one)
    return r.select("id", F.col("hit").cast("int").alias("hit"), F.col("complete").cast("int").alias("complete"), F.round("recall", 6).alias("recall"))


MUST = (("license", "lizenz"), ("password",), ("The", "und"))


def mention_coverage(spark, sf):
    must = F.array(*(F.array(*map(F.lit, m)) for m in MUST))
    return _t(spark, sf, "documents").select("doc_id", M.mention_hits(F.coalesce("text", F.lit("")), must).cast("long").alias("hits"))


WORDS = ("the", "que", "und", "les")


def first_mention(spark, sf):
    each = _t(spark, sf, "conversations").withColumn("word", F.explode(F.array(*map(F.lit, WORDS))))
    met = each.withColumn("at", F.instr(F.lower("text"), F.col("word"))).filter("at > 0")
    first = met.groupBy("conv_id", "turn", "word").agg(F.min("at").alias("at"))
    return first.groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), ",").alias("words"))


def nearest_rank_percentile(spark, sf):
    return evaluate.nearest_ranks(_t(spark, sf, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


def wilson_by_group(spark, sf):
    g = _t(spark, sf, "labels").groupBy("quality").agg(F.sum("toxic").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return g.select("quality", F.col("k").cast("long").alias("k"), "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def known_unknown_split(spark, sf):
    names = F.array(F.concat(F.lit("NATION_"), F.col("r_regionkey").cast("string")), "r_name", F.lit("nowhere"))
    known = _t(spark, sf, "nation").agg(F.collect_set("n_name")).scalar()
    r = _t(spark, sf, "region").withColumn("names", names).withColumn("known_names", known)
    out = ask.known_unknown(r.withColumn("names", F.concat("names", F.slice(F.sort_array("known_names"), F.lit(1), F.col("r_regionkey") + 1))), "names", F.col("known_names"))
    return out.select("r_regionkey", F.size("known").cast("long").alias("n_known"), F.array_join("unknown", ",").alias("unknown"))


def _parts(spark, sf):
    """Parts, numbered from 1."""
    return _t(spark, sf, "part").select((F.col("p_partkey") + 1).alias("p_partkey"))


def _source():
    """Source of the file that stands for a part: m<key>.py, with a class that may extend another file's, imports and calls."""
    k = F.col("p_partkey")
    half, quarter = F.floor(k / 2), F.floor(k / 4)
    heir = (k % 4 == 0) & (k >= 4)
    lines = [
        "import os",
        F.when(k >= 2, F.format_string("from m%d import f%d", half, half)).otherwise("import m1"),
        "from typing import TYPE_CHECKING",
        "if TYPE_CHECKING:",
        F.format_string("    import m%d", k + 1),
        "else:",
        F.when(k % 16 == 0, F.format_string("    import m%d", 2 * k)).otherwise("    import sys"),
        "",
        F.when(heir, F.format_string("class C%d(C%d):", k, quarter)).otherwise(F.format_string("class C%d:", k)),
        "    def run(self):",
        "        self.step()",
        F.format_string("        f%d(1)", half),
        "        len([])",
        "    def step(self):",
        F.when(heir, "        super().step()").otherwise("        os.getcwd()"),
        F.when(k % 5 < 2, "    def __init__(self):\n        pass\n").otherwise(""),
        F.format_string("def f%d(x):", k),
        "    def inner():",
        F.format_string("        return f%d(x)", k),
        F.format_string("    return C%d().run()", k),
        "",
    ]
    return F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in lines))


def _files(spark, sf):
    """A code base with a file for every part, its files dealt out to all cores before they are parsed."""
    part = spread(_parts(spark, sf), "p_partkey")
    return part.select(F.format_string("m%d.py", "p_partkey").alias("file_path"), _source().alias("source"), "p_partkey")


def _facts(spark, sf, *kinds):
    """What the files of the code base say, of all kinds or of those that a query reads."""
    return settled(parse.facts(_files(spark, sf), kinds=kinds or parse.FACTS), "facts")


def _scope(spark, sf):
    return _parts(spark, sf).select(F.format_string("m%d", "p_partkey").alias("stem"), F.col("p_partkey").alias("ord"))


def _call_graph(facts):
    return graph.call_graph(parse.call_sites(facts), parse.definitions(facts), parse.classes(facts), parse.imports(facts))


def call_edges(spark, sf):
    return _call_graph(_facts(spark, sf, *parse.CALL_FACTS))[0]


def unresolved_calls(spark, sf):
    return _call_graph(_facts(spark, sf, *parse.CALL_FACTS))[1].select("caller", "repr", "reason")


def chunk_source(spark, sf):
    return parse.chunks(_files(spark, sf)).select("file_path", "chunk_type", "name", "start_line", "end_line", "parent_class")


def extract_imports(spark, sf):
    return parse.imports(_facts(spark, sf, "import")).select("stem", F.col("seq").cast("long").alias("seq"), "module")


def import_graph(spark, sf):
    return graph.import_edges(parse.imports(_facts(spark, sf, "import")), _scope(spark, sf))


def _commits(spark, sf):
    log = _t(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("sha"), F.format_string("lib/m%d.py", F.col("l_partkey") + 1).alias("path"))
    return code.commit_counts(log, _scope(spark, sf), "lib/")


def _risk(spark, sf, facts):
    scope = _scope(spark, sf)
    return graph.risk_scores(graph.import_edges(parse.imports(facts), scope), scope, _commits(spark, sf))


def _risk_lines(spark, sf, facts):
    """The scores without lists of dependents, which answers and notes don't hold."""
    scope = _scope(spark, sf)
    return settled(graph.risk_lines(graph.import_edges(parse.imports(facts), scope), scope, _commits(spark, sf)), "risk")


def file_risk(spark, sf):
    r = _risk(spark, sf, _facts(spark, sf, "import"))
    return r.select("file", F.col("dependents").cast("long").alias("dependents"), F.array_join("dependent_files", ",").alias("dependent_files"), "commit_count", "risk_level", "rationale")


def risk_recomputed(spark, sf):
    """Scores of which every seventh is put wrong, against a recomputation."""
    facts, scope = _facts(spark, sf, "import"), _scope(spark, sf)
    edges = settled(graph.import_edges(parse.imports(facts), scope), "edges")
    commits = settled(_commits(spark, sf), "commits")
    wrong = F.when(F.regexp_extract("file", r"(\d+)", 1).cast("long") % 7 == 0, 1).otherwise(0)
    scores = graph.risk_levels(edges, scope, commits).withColumn("dependents", F.col("dependents") + wrong)
    return graph.risk_mismatches(scores, edges, scope, commits)


def call_sites(spark, sf):
    return parse.call_sites(_facts(spark, sf, "call")).drop("seq")


def gold_nodes(spark, sf):
    return parse.definitions(_facts(spark, sf, "definition")).select("node_id", "file_path", "class_name", "name", "kind", "start_line", "end_line")


def class_ancestors(spark, sf):
    return graph.class_ancestors(parse.classes(_facts(spark, sf, "class")))


def class_files(spark, sf):
    return graph.class_to_file(parse.classes(_facts(spark, sf, "class")))


def _index(spark, sf):
    return settled(retrieval.chunk_index(parse.chunks(_files(spark, sf)), M.hashed_embedding), "index")


def chunk_table(spark, sf):
    return _index(spark, sf).select("chunk_id", "file_path", "chunk_type", "name", "parent_class", F.size("embedding").alias("dims"))


def definition_lookup(spark, sf):
    return retrieval.chunks_where(_index(spark, sf), "m7.py", None, "f7").select("chunk_id", "start_line", "end_line")


def expand_calls(spark, sf):
    """What each file's method run calls, as far as it has chunks."""
    primary = _parts(spark, sf).select(F.col("p_partkey").alias("query_id"), F.lit(1).alias("place"), F.format_string("m%d.py", "p_partkey").alias("file_path"), F.format_string("C%d", "p_partkey").alias("parent_class"), F.lit("run").alias("base_name"))
    found = retrieval.whole_chunks(retrieval.expand(primary, call_edges(spark, sf)), settled(retrieval.chunk_index(parse.chunks(_files(spark, sf))), "chunks"))
    return retrieval.cited(found).select("query_id", "citation", F.length("text").cast("long").alias("n_chars"))


def _questions(spark, sf):
    k = F.col("s_suppkey")
    said = (
        F.when(k % 4 == 0, F.format_string("how risky is it to change M%d.py?", k))
        .when(k % 4 == 1, "what is the impact of a change?")
        .when(k % 4 == 2, F.format_string("is C%d dangerous to edit, or m%d.py?", k, k + 1))
        .otherwise(F.format_string("what does C%d.run do, and f%d?", k, k))
    )
    return _t(spark, sf, "supplier").select(k.alias("question_id"), said.alias("question"))


def question_targets(spark, sf):
    found = ask.extract_targets(_questions(spark, sf), _scope(spark, sf), class_files(spark, sf))
    return found.select("question_id", ask.classify(F.col("question")).alias("intent"), F.array_join("target_files", ",").alias("target_files"))


def ask_questions(spark, sf):
    """A question for every supplier about the code base, answered from its risk scores or from its code."""
    facts = _facts(spark, sf, *parse.CALL_FACTS, "chunk")  # one parse of a file for its facts and its chunks
    index = settled(retrieval.chunk_index(parse.known_chunks(facts), M.hashed_embedding), "index")
    base = ask.CodeBase(_scope(spark, sf), _risk_lines(spark, sf, facts), graph.class_to_file(parse.classes(facts)), index, settled(_call_graph(facts)[0], "calls"))
    out = ask.ask(_questions(spark, sf), base, told={"answer_md5": F.md5, "answer_chars": F.length})
    return out.select("question_id", "intent", "answer_md5", "answer_chars", F.array_join("citations", "; ").alias("citations"), F.size("risk_details").alias("n_details"))


def risk_answers(spark, sf):
    """The questions about risk, routed, their files found in the code base, answered from its scores."""
    facts = _facts(spark, sf, "class", "import")
    risky, _ = ask.routed(_questions(spark, sf))
    targeted = ask.extract_targets(risky, _scope(spark, sf), graph.class_to_file(parse.classes(facts)))
    out = ask.risk_responses(targeted, _risk_lines(spark, sf, facts), _scope(spark, sf), told={"answer_md5": F.md5})
    return out.select("question_id", "intent", "answer_md5", F.coalesce(F.size("risk_details"), F.lit(-1)).alias("n_details"), F.coalesce(F.aggregate("risk_details", F.lit(0).cast("long"), lambda n, d: n + d["commit_count"]), F.lit(-1).cast("long")).alias("commits"))


def risk_notes(spark, sf):
    """Notes on the files at high risk among the primaries of a query for every part: its own file and the one it imports."""
    k = F.col("p_partkey")
    primary = _parts(spark, sf).select(k.alias("query_id"), F.explode(F.array(F.struct(F.lit(1).alias("place"), k.alias("file")), F.struct(F.lit(2).alias("place"), F.floor(k / 2).alias("file")))).alias("p")).select("query_id", "p.place", F.format_string("m%d.py", "p.file").alias("file_path"))
    notes = retrieval.risk_notes(primary, _risk_lines(spark, sf, _facts(spark, sf, "import")))
    return notes.select("query_id", F.array_join("risk_notes", "; ").alias("notes"))


def reachable(spark, sf):
    return graph.closure_by_frontier(_edges(spark, sf))


def _checked(spark, sf):
    li = _t(spark, sf, "lineitem")
    at = F.col("l_linenumber") * 10
    lines = F.format_string(" (lines %d-%d)", at, at + F.col("l_quantity").cast("int"))
    file = F.when(F.col("l_linenumber") == 3, F.format_string("see o%d.py", "l_orderkey")).otherwise(F.format_string("o%d.py", "l_orderkey"))
    cited = li.select(F.col("l_orderkey").alias("id"), F.concat(file, F.format_string(" :: L%d", "l_linenumber"), F.when(F.col("l_quantity") == 7, "").otherwise(lines)).alias("citation"))
    gold = li.filter("l_returnflag <> 'N'").groupBy(F.format_string("o%d.py::L%d", "l_orderkey", "l_linenumber").alias("node_id")).agg(F.min(at).alias("g_start"), F.max(at + 25).alias("g_end"))
    return evaluate.checked_citations(cited, gold)


def citation_check(spark, sf):
    return _checked(spark, sf).select("id", "citation", *(F.col(c).cast("int").alias(c) for c in ("parsed", "resolves", "exact", "inside")))


def citation_totals(spark, sf):
    return evaluate.citation_totals(_checked(spark, sf))


def stage_rows(spark, sf):
    """Customers as labelled queries, what stages say of them joined by id, and the rows that one rate is about."""
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    rows = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 2 == 0, "code_explanation").otherwise("risk_assessment").alias("intent"), F.when(F.col("c_custkey") % 5 == 0, "abstain").otherwise("answer").alias("expect"), F.when(F.col("c_custkey") % 3 == 0, F.array()).otherwise(F.array("c_name")).alias("gold"))
    det = c.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).cast("int").alias("hit"))
    pipe = o.groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("attempts"), F.max(F.when(F.col("o_totalprice") > 400_000, "timeout")).alias("error"))
    judged = o.filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("claims"))
    return evaluate.chosen_rows(evaluate.joined_stages(rows, det, pipe, judged), "code_explanation", "answer", with_gold=True).select("id", "hit", "attempts", "claims")


def odd_identifiers(spark, sf):
    """Answers with names made from part keys, against a vocabulary of every second one."""
    k = F.col("p_partkey")
    p = spread(_t(spark, sf, "part").select("p_partkey"), "p_partkey")
    answer = F.concat(F.format_string("`C%d.run` calls helper_%d and BaseThing%d with MAX_SIZE, foo_Bar, BaseX or `ab`", k, k % 7, k % 3), F.lit("\n\nNote: hidden_name"))
    answers = p.select(k.alias("id"), answer.alias("answer"), F.format_string("class C%d uses helper_1, BaseThing1", k).alias("context"))
    fixed = F.explode(F.array(*map(F.lit, ["run", "MAX_SIZE", *(f"helper_{j}" for j in range(5)), "BaseThing0", "BaseThing1"])))
    vocabulary = p.filter("p_partkey % 2 = 0").select(F.format_string("C%d", k).alias("token")).unionByName(spark.range(1).select(fixed.alias("token")))
    return evaluate.odd_identifiers(answers, vocabulary)


def same_spans(spark, sf):
    li = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("string").alias("file"), F.col("l_suppkey").alias("start"), F.col("l_partkey").alias("end"), "l_quantity")
    out = evaluate.same_spans(li.filter("l_quantity > 10").drop("l_quantity"), li.filter("l_quantity <= 40").drop("l_quantity"))
    return out.select("id", F.col("same").cast("int").alias("same"), F.col("meet").cast("int").alias("meet"))


def token_sums(spark, sf):
    usage = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("model"), F.col("l_quantity").cast("long").alias("tokens_in"), F.col("l_linenumber").cast("long").alias("tokens_out"))
    return evaluate.token_sums(usage, 0.5, 1.5).withColumn("cost", F.round("cost", 9))


def failures_by_kind(spark, sf):
    return evaluate.failures_by_kind(_t(spark, sf, "events").filter("value > 90").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id")))


def rates_by_kind(spark, sf):
    return evaluate.rates(_t(spark, sf, "events").withColumn("hit", F.col("value") > 50), "event_type", "hit")


def label_errors(spark, sf):
    """Labels made from part keys, some wrong, against the code base."""
    k = F.col("p_partkey")
    node = F.when(k % 9 == 0, F.format_string("m%d.py::none", k)).otherwise(F.format_string("m%d.py::C%d.run", k, k))
    labels = _parts(spark, sf).select(
        F.format_string("q%d", F.when(k % 19 == 0, k + 1).otherwise(k)).alias("id"),
        F.array(node).alias("gold"),
        F.array(F.when(k % 11 == 0, F.array(F.lit("nothing"))).otherwise(F.array(F.lit("zzz"), F.lit("STEP")))).alias("must_mention"),
        F.array(F.when(k % 13 == 0, F.lit("zz")).otherwise(F.format_string("m%d", k))).alias("target_files"),
        F.when(k % 17 == 0, "other").otherwise("code_explanation").alias("intent"),
    )
    return evaluate.label_errors(labels, parse.definitions(_facts(spark, sf, "definition")), _scope(spark, sf))


def flagged_claims(spark, sf):
    verdict = F.when(F.col("o_orderstatus") == "F", "supported").when(F.col("o_orderstatus") == "O", "unsupported").otherwise("contradicted")
    claim = F.struct(F.col("o_orderpriority").alias("claim"), verdict.alias("verdict"), F.lit("").alias("evidence"))
    return evaluate.flagged_claims(_t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(claim).alias("claims")))


def commit_counts(spark, sf):
    """Commits of files in two folders, of which the second holds files of the same names: each counts its own."""
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("sha"), F.concat(F.lit("lib/"), F.when(F.col("o_custkey") % 3 == 0, "sub/").otherwise(""), F.col("o_orderpriority"), F.lit(".py")).alias("path"))
    scope = o.select(code.module_of(F.expr("substring(path, 5)")).alias("stem")).distinct()
    return code.commit_counts(o, scope, "lib/")


def category_counts(spark, sf):
    e = _t(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("large"), F.round(F.avg("value"), 6).alias("mean"))


def stage_deltas(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = _t(spark, sf, "events").withColumn("us", F.unix_micros(F.to_timestamp("ts")) - F.lag(F.unix_micros(F.to_timestamp("ts"))).over(w))
    return d.select("event_id", "us")


def duplicate_ids(spark, sf):
    return _t(spark, sf, "conversations").groupBy("conv_id").count().filter("count > 1").select("conv_id", F.col("count").alias("n"))


def identifiers_in_context(spark, sf):
    d = _t(spark, sf, "documents").filter("doc_id IS NOT NULL").select("doc_id", F.explode(M.tokens(F.coalesce("text", F.lit("")))).alias("token"))
    b = _t(spark, sf, "benchmark").select(F.explode(M.tokens(F.col("text"))).alias("token")).distinct()
    return d.join(b, "token", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (vector_topk, dedupe_then_cut, boost_append, naive_top3, risk_gate, transitive_dependents, line_chunks, reassemble, leftover_lines, token_vocab_antijoin, token_vocabulary, span_overlap, span_containment, gold_reached, mention_coverage, first_mention, nearest_rank_percentile, wilson_by_group, known_unknown_split, call_edges, unresolved_calls, chunk_source, extract_imports, import_graph, file_risk, call_sites, class_ancestors, commit_counts, category_counts, stage_deltas, duplicate_ids, identifiers_in_context, ask_questions, risk_recomputed, gold_nodes, class_files, chunk_table, definition_lookup, expand_calls, question_targets, risk_answers, risk_notes, reachable, citation_check, citation_totals, stage_rows, odd_identifiers, same_spans, token_sums, failures_by_kind, rates_by_kind, label_errors, flagged_claims)}

_HITS = """d AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS distance FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 12),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY rank) = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM f QUALIFY place <= 3)"""
_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)"
_TOKENS = "SELECT {id} unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*'))) AS token FROM {t}"
_SPANS = """s AS (SELECT l_orderkey AS file, l_linenumber AS span, l_linenumber * 10 AS a, l_linenumber * 10 + l_quantity::INT AS b, l_linestatus = 'F' AS found FROM lineitem),
g AS (SELECT l_orderkey AS file, l_linenumber AS gold, l_linenumber * 10 + 5 AS ga, l_linenumber * 10 + 15 AS gb FROM lineitem WHERE l_returnflag = 'R')"""
_Z = "1.96::DOUBLE"
# What the code base made from part holds: k, half, quarter of each key, more lines with a constructor, and classes with their ancestors.
_CODE = """RECURSIVE p AS (SELECT p_partkey + 1 AS p_partkey FROM part), k AS (SELECT p_partkey AS k, p_partkey // 2 AS h, p_partkey // 4 AS q, CASE WHEN p_partkey % 5 < 2 THEN 2 ELSE 0 END AS e, p_partkey % 4 = 0 AND p_partkey >= 4 AS heir, 'm' || p_partkey || '.py' AS file, 'm' || p_partkey || '.py::C' || p_partkey AS cls FROM p),
anc AS (SELECT k AS c, k AS a, 0 AS d FROM k UNION ALL SELECT c, a // 4, d + 1 FROM anc WHERE a % 4 = 0 AND a >= 4),
made AS (SELECT c, arg_min(a, d) AS a FROM anc WHERE a % 5 < 2 GROUP BY c)"""
_IMPORTS = """e AS (SELECT k AS src, h AS dst FROM k WHERE k >= 2 UNION SELECT k, 2 * k FROM k WHERE k % 16 = 0 AND 2 * k <= (SELECT max(k) FROM k))"""
_RISK = _CODE + ", " + _IMPORTS + """, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
dep AS (SELECT dst, count(*) AS n, string_agg('m' || src, ',' ORDER BY 'm' || src) AS files FROM r WHERE src <> dst GROUP BY dst),
com AS (SELECT l_partkey + 1 AS k, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1),
risk AS (SELECT k.k, coalesce(dep.n, 0) AS dependents, coalesce(files, '') AS dependent_files, coalesce(com.n, 0) AS commits FROM k LEFT JOIN dep ON dep.dst = k.k LEFT JOIN com ON com.k = k.k),
med AS (SELECT median(dependents) AS a, median(commits) AS b FROM risk),
lev AS (SELECT risk.*, CASE WHEN dependents < a THEN 'low' WHEN commits <= b THEN 'high' ELSE 'medium' END AS risk_level FROM risk, med)"""
_NO_NAME, _NO_TYPE = "no function or class of that name is known here", "the receiver''s type isn''t known"
_SAID = """q AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'how risky is it to change M' || s_suppkey || '.py?' WHEN 1 THEN 'what is the impact of a change?' WHEN 2 THEN 'is C' || s_suppkey || ' dangerous to edit, or m' || (s_suppkey + 1) || '.py?' ELSE 'what does C' || s_suppkey || '.run do, and f' || s_suppkey || '?' END AS said FROM supplier)"""

_TARGETS = """f AS (SELECT id, p_partkey AS k, instr(lower(said), 'm' || p_partkey || '.py') AS x, instr(said, 'C' || p_partkey) AS y FROM q, (SELECT p_partkey + 1 AS p_partkey FROM part) t),
m AS (SELECT id, k, least(CASE WHEN x > 0 THEN x ELSE 9999 END, CASE WHEN y > 0 THEN y ELSE 9999 END) AS spot FROM f WHERE x > 0 OR y > 0)"""
_SCORED = """says AS (SELECT k, 'm' || k AS file, commits, risk_level, CASE risk_level WHEN 'high' THEN dependents || ' files depend on it, and with ' || commits || ' commits it is seldom changed' WHEN 'medium' THEN dependents || ' files depend on it, but with ' || commits || ' commits it is changed often' ELSE 'only ' || dependents || ' files depend on it' END AS rationale FROM lev)"""
_CITED = """l AS (SELECT l_orderkey AS id, l_linenumber AS n, l_linenumber * 10 AS a, l_linenumber * 10 + l_quantity::INT AS b, l_quantity <> 7 AND l_linenumber <> 3 AS parsed, l_returnflag <> 'N' AS gold, CASE WHEN l_linenumber = 3 THEN 'see ' ELSE '' END || 'o' || l_orderkey || '.py :: L' || l_linenumber || CASE WHEN l_quantity = 7 THEN '' ELSE ' (lines ' || l_linenumber * 10 || '-' || (l_linenumber * 10 + l_quantity::INT) || ')' END AS citation FROM lineitem),
g AS (SELECT DISTINCT id, n FROM l WHERE gold), r AS (SELECT l.*, parsed AND g.id IS NOT NULL AS resolves FROM l LEFT JOIN g ON g.id = l.id AND g.n = l.n)"""

ORACLES = {
    "vector_topk": f"WITH {_HITS} SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM h",
    "dedupe_then_cut": f"WITH {_HITS} SELECT query_id, label, vec_id, place FROM c",
    "boost_append": f"WITH {_HITS} SELECT query_id, label, vec_id FROM f WHERE label = query_id // 100 % 10 AND NOT EXISTS (SELECT 1 FROM c WHERE c.query_id = f.query_id AND c.label = f.label)",
    "naive_top3": f"WITH {_HITS} SELECT query_id, vec_id, rank FROM h WHERE rank <= 3 AND label <> 0",
    "risk_gate": "WITH p AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS dependents, count(*) AS commit_count FROM lineitem GROUP BY 1), m AS (SELECT median(dependents) AS a, median(commit_count) AS b FROM p) SELECT l_partkey, dependents, commit_count, CASE WHEN dependents < a THEN 'low' WHEN commit_count <= b THEN 'high' ELSE 'medium' END AS risk_level FROM p, m",
    "transitive_dependents": "WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 3 + 1) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey + 7) % 25 FROM nation WHERE n_nationkey % 4 = 0), r AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT dst AS node, count(DISTINCT src) AS dependents, string_agg(src::VARCHAR, ',' ORDER BY src) AS dependent_files FROM r WHERE src <> dst GROUP BY dst",
    "line_chunks": f"""WITH RECURSIVE {_LINES}, m AS (SELECT doc_id, max(pos) AS last FROM l GROUP BY doc_id), t AS (SELECT l.doc_id, pos, line FROM l JOIN m ON l.doc_id = m.doc_id WHERE NOT (pos = last AND line = '')),
k AS (SELECT doc_id, pos, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, count(*) OVER (PARTITION BY doc_id) AS n FROM t),
arr AS (SELECT doc_id, max(n) AS n, list(upto ORDER BY pos) AS u FROM k GROUP BY doc_id),
w AS (SELECT doc_id, n, u, 1 AS part_no, 0 AS s, least(n, 1 + len(list_filter(u, lambda x: x < 1600))) AS e FROM arr
UNION ALL SELECT doc_id, n, u, part_no + 1, greatest(e - 3, s + 1), least(n, 1 + len(list_filter(u, lambda x: x < 1600 + u[greatest(e - 3, s + 1)]))) FROM w WHERE e < n)
SELECT doc_id, part_no::BIGINT AS part_no, (s + 1)::BIGINT AS start_line, e::BIGINT AS end_line, (u[e] - CASE WHEN s > 0 THEN u[s] ELSE 0 END - 1)::BIGINT AS n_chars FROM w""",
    "reassemble": f"WITH {_LINES} SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS text_md5, min(pos)::BIGINT AS start_line, max(pos)::BIGINT AS end_line FROM l GROUP BY doc_id",
    "leftover_lines": f"WITH {_LINES} SELECT doc_id, count(*) AS n, sum(length(line))::BIGINT AS chars, min(pos)::BIGINT AS first, max(pos)::BIGINT AS last FROM l WHERE length(line) < {LONG_LINE} AND trim(line) <> '' GROUP BY doc_id",
    "token_vocab_antijoin": f"SELECT DISTINCT token FROM ({_TOKENS.format(id='', t='benchmark')}) WHERE token NOT IN ({_TOKENS.format(id='', t='documents')})",
    "token_vocabulary": f"SELECT token, count(*) AS items FROM ({_TOKENS.format(id='', t='benchmark')}) GROUP BY token",
    "span_overlap": f"WITH {_SPANS} SELECT s.file, span, gold FROM s JOIN g ON s.file = g.file AND a <= gb AND b >= ga",
    "span_containment": f"WITH {_SPANS} SELECT s.file, span, gold FROM s JOIN g ON s.file = g.file AND a <= ga AND b >= gb",
    "gold_reached": f"WITH {_SPANS}, o AS (SELECT g.file, gold, bool_or(coalesce(a <= gb AND b >= ga, false)) AS ok FROM g LEFT JOIN (SELECT * FROM s WHERE found) s ON s.file = g.file GROUP BY g.file, gold) SELECT file AS id, bool_or(ok)::INT AS hit, bool_and(ok)::INT AS complete, round(avg(ok::INT), 6) AS recall FROM o GROUP BY file",
    "mention_coverage": "SELECT doc_id, " + " + ".join("(" + " OR ".join(f"contains(lower(coalesce(text, '')), '{x.lower()}')" for x in m) + ")::BIGINT" for m in MUST) + " AS hits FROM documents",
    "first_mention": "WITH w AS (SELECT unnest(['" + "','".join(WORDS) + "']) AS word), m AS (SELECT conv_id, turn, word, min(instr(lower(text), word)) AS spot FROM conversations, w WHERE instr(lower(text), word) > 0 GROUP BY 1, 2, 3) SELECT conv_id, turn, string_agg(word, ',' ORDER BY spot, word) AS words FROM m GROUP BY 1, 2",
    "nearest_rank_percentile": "WITH a AS (SELECT event_type, list(value ORDER BY value) AS v, count(value) AS n FROM events GROUP BY 1) SELECT event_type, v[round_even(0.5::DOUBLE * (n - 1), 0)::INT + 1] AS p50, v[round_even(0.95::DOUBLE * (n - 1), 0)::INT + 1] AS p95 FROM a",
    "wilson_by_group": f"WITH g AS (SELECT quality, sum(toxic)::BIGINT AS k, count(*) AS n FROM labels GROUP BY 1), w AS (SELECT *, (k / n + {_Z} * {_Z} / (2 * n)) AS c, {_Z} * sqrt(((k / n) * (1 - k / n) + {_Z} * {_Z} / (4 * n)) / n) AS s, 1 + {_Z} * {_Z} / n AS d FROM g) SELECT quality, k, n, round(greatest(0.0, (c - s) / d), 6) AS low, round(least(1.0, (c + s) / d), 6) AS high FROM w",
    "known_unknown_split": "WITH k AS (SELECT list_sort(list_distinct(list(n_name))) AS known FROM nation), r AS (SELECT r_regionkey, list_concat(['NATION_' || r_regionkey, r_name, 'nowhere'], known[1:r_regionkey + 1]) AS names, known FROM region, k) SELECT r_regionkey, len(list_distinct(list_filter(names, lambda x: list_contains(known, x))))::BIGINT AS n_known, array_to_string(list_filter(names, lambda x: NOT list_contains(known, x)), ',') AS unknown FROM r",
    "commit_counts": "SELECT CASE WHEN o_custkey % 3 = 0 THEN 'sub.' ELSE '' END || o_orderpriority AS stem, count(DISTINCT o_orderkey) AS commit_count FROM orders GROUP BY 1",
    "category_counts": "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS large, round(avg(value), 6) AS mean FROM events GROUP BY 1",
    "stage_deltas": "SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS us FROM events",
    "duplicate_ids": "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1",
    "identifiers_in_context": f"SELECT doc_id, count(*) AS n FROM ({_TOKENS.format(id='doc_id,', t='documents')}) WHERE token IN ({_TOKENS.format(id='', t='benchmark')}) GROUP BY 1",
    "call_edges": f"""WITH {_CODE} SELECT 'm' || a || '.py::C' || a || '.run' AS caller, 'm' || c || '.py::C' || c || '.step' AS callee FROM anc
UNION SELECT cls || '.run', 'm' || h || '.py::f' || h FROM k WHERE k >= 2 UNION SELECT cls || '.step', 'm' || q || '.py::C' || q || '.step' FROM k WHERE heir
UNION SELECT file || '::f' || k, file || '::f' || k FROM k UNION SELECT 'm' || c || '.py::f' || c, 'm' || a || '.py::C' || a || '.__init__' FROM made""",
    "unresolved_calls": f"""WITH {_CODE} SELECT cls || '.run' AS caller, 'len(...)' AS repr, '{_NO_NAME}' AS reason FROM k UNION ALL SELECT cls || '.run', 'f0(...)', '{_NO_NAME}' FROM k WHERE k = 1
UNION ALL SELECT cls || '.step', 'os.getcwd(...)', '{_NO_TYPE}' FROM k WHERE NOT heir UNION ALL SELECT file || '::f' || k, '<expr>.run(...)', '{_NO_TYPE}' FROM k
UNION ALL SELECT file || '::f' || k, 'C' || k || '(...)', '{_NO_NAME}' FROM k WHERE k NOT IN (SELECT c FROM made)""",
    "chunk_source": f"""WITH {_CODE} SELECT file AS file_path, 'class' AS chunk_type, 'C' || k AS name, 9::INT AS start_line, (15 + e)::INT AS end_line, NULL::VARCHAR AS parent_class FROM k
UNION ALL SELECT file, 'function', 'f' || k, (17 + e)::INT, (20 + e)::INT, NULL FROM k UNION ALL SELECT file, 'module_level', '<module>', 1, (16 + e)::INT, NULL FROM k""",
    "extract_imports": f"""WITH {_CODE} SELECT 'm' || k AS stem, unnest([0, 1, 2, 3])::BIGINT AS seq, unnest(['os', 'm' || CASE WHEN k = 1 THEN 1 ELSE h END, 'typing', CASE WHEN k % 16 = 0 THEN 'm' || 2 * k ELSE 'sys' END]) AS module FROM k""",
    "import_graph": f"WITH {_CODE}, {_IMPORTS} SELECT 'm' || src AS src, 'm' || dst AS dst FROM e",
    "file_risk": f"""WITH {_RISK} SELECT 'm' || k AS file, dependents, dependent_files, commits AS commit_count, risk_level, CASE risk_level WHEN 'high' THEN dependents || ' files depend on it, and with ' || commits || ' commits it is seldom changed' WHEN 'medium' THEN dependents || ' files depend on it, but with ' || commits || ' commits it is changed often' ELSE 'only ' || dependents || ' files depend on it' END AS rationale FROM lev""",
    "risk_recomputed": f"WITH {_CODE} SELECT 'm' || k AS file, 'other numbers' AS problem FROM k WHERE k % 7 = 0",
    "call_sites": f"""WITH {_CODE} SELECT cls || '.run' AS caller, file AS file_path, 'C' || k AS class_name, unnest(['self', 'bare', 'bare']) AS kind, unnest(['step', 'f' || h, 'len']) AS callee, unnest(['self.step(...)', 'f' || h || '(...)', 'len(...)']) AS repr FROM k
UNION ALL SELECT cls || '.step', file, 'C' || k, CASE WHEN heir THEN 'super' ELSE 'other' END, CASE WHEN heir THEN 'step' ELSE 'getcwd' END, CASE WHEN heir THEN '<expr>.step(...)' ELSE 'os.getcwd(...)' END FROM k
UNION ALL SELECT file || '::f' || k, file, NULL, unnest(['bare', 'bare', 'other']), unnest(['f' || k, 'C' || k, 'run']), unnest(['f' || k || '(...)', 'C' || k || '(...)', '<expr>.run(...)']) FROM k""",
    "gold_nodes": f"""WITH {_CODE} SELECT cls AS node_id, file AS file_path, NULL::VARCHAR AS class_name, 'C' || k AS name, 'class' AS kind, 9::INT AS start_line, (15 + e)::INT AS end_line FROM k
UNION ALL SELECT cls || '.run', file, 'C' || k, 'run', 'method', 10, 13 FROM k UNION ALL SELECT cls || '.step', file, 'C' || k, 'step', 'method', 14, 15 FROM k
UNION ALL SELECT cls || '.__init__', file, 'C' || k, '__init__', 'method', 16, 17 FROM k WHERE e = 2 UNION ALL SELECT file || '::f' || k, file, NULL, 'f' || k, 'function', 17 + e, 20 + e FROM k""",
    "class_ancestors": f"WITH {_CODE} SELECT 'C' || c AS class_name, 'C' || a AS ancestor, d::INT AS depth FROM anc",
    "class_files": f"WITH {_CODE} SELECT 'C' || k AS class_name, 'm' || k AS stem FROM k",
    "chunk_table": f"""WITH {_CODE} SELECT file || ':<module>:1:0' AS chunk_id, file AS file_path, 'module_level' AS chunk_type, '<module>' AS name, '' AS parent_class, 64::INT AS dims FROM k
UNION ALL SELECT file || ':C' || k || ':9:1', file, 'class', 'C' || k, '', 64 FROM k UNION ALL SELECT file || ':f' || k || ':' || (17 + e) || ':2', file, 'function', 'f' || k, '', 64 FROM k""",
    "definition_lookup": f"WITH {_CODE} SELECT file || ':f7:' || (17 + e) || ':2' AS chunk_id, (17 + e)::INT AS start_line, (20 + e)::INT AS end_line FROM k WHERE k = 7",
    "expand_calls": f"""WITH {_CODE} SELECT a.k AS query_id, b.file || ' :: f' || b.k || ' (lines ' || (17 + b.e) || '-' || (20 + b.e) || ')' AS citation, (67 + 3 * length(b.k::VARCHAR))::BIGINT AS n_chars FROM k a JOIN k b ON b.k = a.h""",
    "risk_answers": f"""WITH {_RISK}, {_SAID}, {_TARGETS}, {_SCORED},
a AS (SELECT id, string_agg(file || '.py: ' || upper(risk_level) || ' risk -- ' || rationale, chr(10) || chr(10) ORDER BY spot, file) AS answer, count(*) AS n, sum(commits)::BIGINT AS commits FROM m JOIN says ON says.k = m.k GROUP BY id)
SELECT q.id AS question_id, 'risk_assessment' AS intent, md5(coalesce(answer, 'Which file do you mean? Known are: ' || (SELECT string_agg(file, ', ' ORDER BY file) FROM says))) AS answer_md5, coalesce(n, -1)::INT AS n_details, coalesce(commits, -1) AS commits FROM q LEFT JOIN a ON a.id = q.id WHERE q.id % 4 <> 3""",
    "risk_notes": f"""WITH {_RISK}, {_SCORED}, u AS (SELECT k AS query_id, 1 AS place, k AS f FROM k UNION ALL SELECT k, 2, h FROM k)
SELECT query_id, string_agg(file || '.py: ' || rationale, '; ' ORDER BY place) AS notes FROM u JOIN says ON says.k = u.f AND risk_level = 'high' GROUP BY query_id""",
    "question_targets": f"""WITH {_SAID}, f AS (SELECT id, p_partkey AS k, instr(lower(said), 'm' || p_partkey || '.py') AS x, instr(said, 'C' || p_partkey) AS y FROM q, (SELECT p_partkey + 1 AS p_partkey FROM part) p), m AS (SELECT id, k, least(CASE WHEN x > 0 THEN x ELSE 9999 END, CASE WHEN y > 0 THEN y ELSE 9999 END) AS spot FROM f WHERE x > 0 OR y > 0),
l AS (SELECT id, string_agg('m' || k, ',' ORDER BY spot, 'm' || k) AS files FROM m GROUP BY id) SELECT q.id AS question_id, CASE WHEN q.id % 4 = 3 THEN 'code_explanation' ELSE 'risk_assessment' END AS intent, coalesce(files, '') AS target_files FROM q LEFT JOIN l ON l.id = q.id""",
    "reachable": "WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 3 + 1) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey + 7) % 25 FROM nation WHERE n_nationkey % 4 = 0), r AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r WHERE src <> dst",
    "citation_check": f"""WITH {_CITED} SELECT id, citation, parsed::INT AS parsed, resolves::INT AS resolves, (resolves AND b = a + 25)::INT AS exact, (resolves AND b <= a + 25)::INT AS inside FROM r""",
    "citation_totals": f"""WITH {_CITED} SELECT count(*) AS n_citations, count(*) FILTER (resolves) AS resolve, count(*) FILTER (resolves AND b = a + 25) AS line_exact, count(*) FILTER (NOT parsed) AS unparseable FROM r""",
    "stage_rows": """WITH p AS (SELECT o_custkey AS id, count(*) AS attempts, bool_or(o_totalprice > 400000) AS failed, nullif(count(*) FILTER (o_orderpriority = '1-URGENT'), 0) AS claims FROM orders GROUP BY 1)
SELECT c_custkey AS id, (c_acctbal > 0)::INT AS hit, attempts, claims FROM customer JOIN p ON p.id = c_custkey WHERE c_nationkey % 2 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 AND NOT coalesce(failed, false)""",
    "odd_identifiers": """SELECT p_partkey AS id, 'C' || p_partkey AS identifier, 'fabricated' AS kind FROM part WHERE p_partkey % 2 = 1 AND p_partkey >= 10 UNION ALL SELECT p_partkey, unnest(['MAX_SIZE', 'foo_Bar', 'BaseX']), unnest(['outside', 'fabricated', 'fabricated']) FROM part UNION ALL SELECT p_partkey, 'run', 'outside' FROM part
UNION ALL SELECT p_partkey, 'helper_' || p_partkey % 7, CASE WHEN p_partkey % 7 < 5 THEN 'outside' ELSE 'fabricated' END FROM part WHERE p_partkey % 7 <> 1
UNION ALL SELECT p_partkey, 'BaseThing' || p_partkey % 3, CASE WHEN p_partkey % 3 < 2 THEN 'outside' ELSE 'fabricated' END FROM part WHERE p_partkey % 3 <> 1""",
    "same_spans": """WITH s AS (SELECT l_orderkey AS id, [l_linenumber, l_suppkey, l_partkey] AS x, l_quantity > 10 AS a, l_quantity <= 40 AS b FROM lineitem), g AS (SELECT id, list_sort(list(DISTINCT x) FILTER (a)) AS a, list_sort(list(DISTINCT x) FILTER (b)) AS b FROM s GROUP BY id)
SELECT id, (a IS NOT DISTINCT FROM b)::INT AS same, coalesce(list_has_any(a, b), false)::INT AS meet FROM g""",
    "token_sums": "SELECT l_orderkey AS id, sum(l_quantity::BIGINT)::BIGINT AS tokens_in, sum(l_linenumber)::BIGINT AS tokens_out, round((sum(l_quantity::BIGINT) * 0.5::DOUBLE + sum(l_linenumber) * 1.5::DOUBLE) / 1e6::DOUBLE, 9) AS cost FROM lineitem GROUP BY 1",
    "failures_by_kind": "SELECT event_type AS kind, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events WHERE value > 90 GROUP BY 1",
    "rates_by_kind": f"""WITH g AS (SELECT event_type, count(*) FILTER (value > 50) AS k, count(*) AS n FROM events GROUP BY 1), w AS (SELECT *, (k / n + {_Z} * {_Z} / (2 * n)) AS c, {_Z} * sqrt(((k / n) * (1 - k / n) + {_Z} * {_Z} / (4 * n)) / n) AS s, 1 + {_Z} * {_Z} / n AS d FROM g)
SELECT event_type, k, n, k || '/' || n || ' = ' || printf('%.0f', 100 * k / n) || '% (95% CI ' || printf('%.0f', 100 * (c - s) / d) || '–' || printf('%.0f', 100 * (c + s) / d) || '%)' AS rate FROM w""",
    "label_errors": """WITH l AS (SELECT 'q' || CASE WHEN p_partkey % 19 = 0 THEN p_partkey + 1 ELSE p_partkey END AS id, p_partkey AS k, p_partkey % 9 <> 0 AS known, CASE WHEN p_partkey % 11 = 0 THEN 'nothing' ELSE 'zzz|STEP' END AS terms FROM (SELECT p_partkey + 1 AS p_partkey FROM part))
SELECT id, 'unknown gold m' || k || '.py::none' AS problem FROM l WHERE NOT known UNION ALL SELECT t.id, 'no gold source holds ' || t.terms FROM (SELECT DISTINCT id, terms FROM l) t WHERE t.terms = 'nothing' OR NOT EXISTS (SELECT 1 FROM l WHERE l.id = t.id AND l.known)
UNION ALL SELECT id, 'unknown file zz' FROM l WHERE k % 13 = 0 UNION ALL SELECT id, 'repeated id' FROM l GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'bad intent' FROM l WHERE k % 17 = 0""",
    "flagged_claims": "SELECT CASE o_orderstatus WHEN 'O' THEN 'unsupported' ELSE 'contradicted' END AS verdict, count(*) AS claims, count(DISTINCT o_custkey) AS answers FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1",
}

for _more in (queries_text, queries_vectors, queries_graph, queries_evaluation):
    QUERIES |= _more.QUERIES
ORACLES |= queries_text.ORACLES | queries_vectors.ORACLES | queries_evaluation.ORACLES | queries_graph.oracles(_RISK, _CODE)
