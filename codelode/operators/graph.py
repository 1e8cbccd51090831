"""Import and call graphs, closures and risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.code import module_of
from .evaluate import exact_medians
from .shared import discard, settled


def import_edges(imports: DataFrame, scope: DataFrame) -> DataFrame:
    """(src, dst): src imports dst, both in scope."""
    both = imports.join(scope.select("stem").hint("merge"), "stem", "left_semi").join(scope.select(F.col("stem").alias("module")).hint("merge"), "module", "left_semi")
    return both.filter("stem <> module").select(F.col("stem").alias("src"), F.col("module").alias("dst")).distinct()


def import_walks(first: DataFrame, second: DataFrame) -> DataFrame:
    """(stem, module, seen_by) of imports (stem, module) that two walks of the same files find: ``both``, ``first`` or ``second``."""
    a, b = (df.select("stem", "module").distinct().withColumn(f"in_{k}", F.lit(True)) for k, df in enumerate((first, second)))
    seen = F.when(F.col("in_0") & F.col("in_1"), "both").when(F.col("in_0"), "first").otherwise("second")
    return a.join(b, ["stem", "module"], "full_outer").select("stem", "module", seen.alias("seen_by"))


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, depth) of all dst reachable from src, cycles included, a node from itself left out; depth is the fewest steps.

    Paths double: after a round all pairs up to twice as far apart are known, so rounds grow with the logarithm of
    the longest distance. A pair farther apart than ``far`` steps, but not twice as far, is one of exactly ``far``
    followed by a nearer one, so only those of exactly ``far`` are led on: in a tree every pair is made once, not once
    for each node between. A round is one join, one aggregation and one written table; the last finds none that far.
    """
    known, far = settled(edges.select("src", "dst").filter("src <> dst").distinct().withColumn("depth", F.lit(1)), "paths"), 1
    while not (last := known.filter(F.col("depth") == far)).isEmpty():
        onward = known.select(F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("depth").alias("more"))
        longer = last.join(onward.hint("merge"), "dst").filter("src <> end").select("src", F.col("end").alias("dst"), (F.col("depth") + F.col("more")).alias("depth"))
        old, known = known, settled(known.unionByName(longer).groupBy("src", "dst").agg(F.min("depth").alias("depth")), "paths")
        discard(old)
        far *= 2
    return known


def closure_by_frontier(edges: DataFrame) -> DataFrame:
    """(src, dst) reachable, by another way for cross-checks: a frontier grows step by step, what was seen is taken off."""
    step = settled(edges.select("src", "dst").filter("src <> dst").distinct(), "steps")
    seen = frontier = step
    while not frontier.isEmpty():
        reached = frontier.withColumnRenamed("dst", "via").join(step.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").filter("src <> dst").distinct()
        frontier = settled(reached.join(seen, ["src", "dst"], "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (stem, id), numbered in the order of their names so that those of a folder lie close together, and edges (a, b) as numbers."""
    step = settled(edges.select("src", "dst").filter("src <> dst").distinct(), "steps")
    nodes = settled(step.select(F.explode(F.array("src", "dst")).alias("stem")).distinct().orderBy("stem").withColumn("id", F.monotonically_increasing_id()), "numbers")
    named = lambda end, number: nodes.select(F.col("stem").alias(end), F.col("id").alias(number)).hint("merge")
    arcs = settled(step.join(named("src", "a"), "src").join(named("dst", "b"), "dst").select("a", "b"), "arcs")
    discard(step)
    return nodes, arcs


def _word(number: str):
    """The word of 64 bits that holds a number's bit."""
    return F.shiftright(number, 6)


def _bit(number: str):
    """A number's bit in its word."""
    return F.expr(f"shiftleft(1L, CAST({number} & 63 AS INT))")


def dependent_counts(edges: DataFrame, scope: DataFrame) -> DataFrame:
    """(stem, dependents) for all of scope: how many reach it, itself left out, without writing a pair of nodes.

    What reaches a node is kept as bits, a row for each word of 64 nodes of which some do: never more rows than pairs,
    and few where many reach it. A round leads the bits that came in the last one on along the edges, combined before
    the exchange, so cycles need no care: a bit is led on once. Rounds are as many as the longest of the shortest paths.
    """
    nodes, arcs = _numbered(edges)
    first = arcs.groupBy(F.col("b").alias("node"), _word("a").alias("word")).agg(F.bit_or(_bit("a")).alias("bits"))
    known = settled(first.withColumn("new", F.col("bits")), "bits")
    none = F.lit(0).cast("long")
    while not (grown := known.filter("new <> 0")).isEmpty():
        onward = grown.select(F.col("node").alias("a"), "word", "new").hint("merge")
        passed = arcs.join(onward, "a").groupBy(F.col("b").alias("node"), "word").agg(F.bit_or("new").alias("got"))
        both = known.select("node", "word", F.col("bits").alias("had"), none.alias("got")).unionByName(passed.withColumn("had", none))
        merged = both.groupBy("node", "word").agg(F.bit_or("had").alias("had"), F.bit_or("got").alias("got"))
        old, known = known, settled(merged.selectExpr("node", "word", "had | got AS bits", "got & ~had AS new"), "bits")
        discard(old)
    own = F.when(F.col("word") == _word("node"), F.bit_count(F.col("bits").bitwiseAND(_bit("node")))).otherwise(0)
    counted = known.groupBy(F.col("node").alias("id")).agg(F.sum(F.bit_count("bits") - own).alias("dependents"))
    named = nodes.join(counted.hint("merge"), "id").select("stem", "dependents")
    return scope.select("stem").join(named.hint("merge"), "stem", "left").select("stem", F.coalesce("dependents", F.lit(0)).alias("dependents"))


def dependents_of(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(stem, dependent_files) of the files (stem) asked for, by going back from these alone; files nothing leads to have an empty list."""
    step = settled(edges.select("src", "dst").filter("src <> dst").distinct(), "steps")
    seen = frontier = settled(files.select("stem", F.col("stem").alias("at")).distinct(), "asked")
    while not frontier.isEmpty():
        back = frontier.join(step.withColumnRenamed("dst", "at"), "at").select("stem", F.col("src").alias("at")).distinct()
        frontier = settled(back.join(seen, ["stem", "at"], "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    return seen.groupBy("stem").agg(F.sort_array(F.collect_set(F.when(F.col("at") != F.col("stem"), F.col("at")))).alias("dependent_files"))


def risk_levels(edges: DataFrame, scope: DataFrame, commits: DataFrame) -> DataFrame:
    """(file, dependents, commit_count, risk_level) of all of scope: the scores without lists of dependents."""
    return risk_gate(reached_counts(edges, scope).join(commits.hint("merge"), "stem")).select(F.col("stem").alias("file"), "dependents", "commit_count", "risk_level")


def risk_table(levels: DataFrame) -> DataFrame:
    """Scores for a report, files with most dependents first."""
    return levels.orderBy(F.desc("dependents"), "file")


def risk_mismatches(scores: DataFrame, edges: DataFrame, scope: DataFrame, commits: DataFrame) -> DataFrame:
    """(file, problem) where scores differ from a recomputation without pairs, by bits led on step by step, file by file."""
    again = risk_gate(dependent_counts(edges, scope).join(commits.hint("merge"), "stem")).select(F.col("stem").alias("file"), F.struct(F.col("dependents").cast("long"), "commit_count", "risk_level").alias("again"))
    given = scores.select("file", F.struct(F.col("dependents").cast("long"), "commit_count", "risk_level").alias("given"))
    both = given.join(again, "file", "full_outer").filter(~F.col("given").eqNullSafe(F.col("again")))
    problem = F.when(F.col("given").isNull(), "no score").when(F.col("again").isNull(), "not in scope").otherwise("other numbers")
    return both.select("file", problem.alias("problem"))


def dependents(edges: DataFrame, scope: DataFrame) -> DataFrame:
    """(stem, dependents, dependent_files) for all of scope, isolated files with 0.

    The closure is one of numbers. What reaches a node is then packed to words of 64 bits, and names are put in word by
    word, in whose order they are sorted.
    """
    nodes, arcs = _numbered(edges)
    pairs = closure(arcs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    words = pairs.groupBy(F.col("dst").alias("id"), _word("src").alias("word")).agg(F.bit_or(_bit("src")).alias("bits"))
    names = nodes.groupBy(_word("id").alias("word")).agg(F.array_sort(F.collect_list(F.struct("id", "stem"))).alias("names"))
    held = F.expr("transform(filter(names, n -> getbit(bits, CAST(n.id & 63 AS INT)) = 1), n -> n.stem)")
    each = words.join(names.hint("merge"), "word").select("id", F.struct("word", held.alias("stems")).alias("part"))
    listed = each.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["stems"])).alias("dependent_files"))
    of = nodes.join(listed.hint("merge"), "id").select("stem", "dependent_files")
    return scope.join(of.hint("merge"), "stem", "left").select("stem", F.coalesce(F.size("dependent_files"), F.lit(0)).alias("dependents"), F.coalesce("dependent_files", F.array().cast("array<string>")).alias("dependent_files"))


def reached_counts(edges: DataFrame, scope: DataFrame) -> DataFrame:
    """(stem, dependents) for all of scope, by counting the pairs of the closure: for graphs whose nodes reach few others."""
    nodes, arcs = _numbered(edges)
    counted = closure(arcs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("dependents"))
    of = nodes.join(counted.hint("merge"), "id").select("stem", "dependents")
    return scope.select("stem").join(of.hint("merge"), "stem", "left").select("stem", F.coalesce("dependents", F.lit(0)).alias("dependents"))


def risk_gate(measured: DataFrame, impact: str = "dependents", churn: str = "commit_count") -> DataFrame:
    """Adds risk_level: high if impact reaches its median and churn stays within its own, medium if only impact does, else low.

    What is measured is written once; both medians come from one pass over it.
    """
    held = settled(measured, "measured")
    middle = exact_medians(held, [impact, churn])
    level = F.when(F.col(impact) < F.lit(middle[impact]), "low").when(F.col(churn) <= F.lit(middle[churn]), "high").otherwise("medium")
    return held.withColumn("risk_level", level)


def risk_scores(edges: DataFrame, scope: DataFrame, commits: DataFrame) -> DataFrame:
    """(file, dependents, dependent_files, commit_count, risk_level, rationale), the riskiest first; commits: (stem, commit_count)."""
    gated = rated(dependents(edges, scope), commits)
    order = F.when(F.col("risk_level") == "high", 0).when(F.col("risk_level") == "medium", 1).otherwise(2)
    return gated.select("file", "dependents", "dependent_files", "commit_count", "risk_level", "rationale").orderBy(order, "file")


def risk_lines(edges: DataFrame, scope: DataFrame, commits: DataFrame) -> DataFrame:
    """(file, dependents, commit_count, risk_level, rationale): the scores without lists of dependents, in no order."""
    return rated(reached_counts(edges, scope), commits).select("file", "dependents", "commit_count", "risk_level", "rationale")


def rated(measured: DataFrame, commits: DataFrame) -> DataFrame:
    """Files with their dependents, and what their commits and risk say of them."""
    gated = risk_gate(measured.join(commits.hint("merge"), "stem"))
    says = (
        F.when(F.col("risk_level") == "high", F.format_string("%d files depend on it, and with %d commits it is seldom changed", "dependents", "commit_count"))
        .when(F.col("risk_level") == "medium", F.format_string("%d files depend on it, but with %d commits it is changed often", "dependents", "commit_count"))
        .otherwise(F.format_string("only %d files depend on it", "dependents"))
    )
    return gated.withColumnRenamed("stem", "file").withColumn("rationale", says)


def class_ancestors(classes: DataFrame) -> DataFrame:
    """(class_name, ancestor, depth), each class its own at depth 0; a parent that is no known class ends the chain, and so does a cycle."""
    one = classes.groupBy("class_name").agg(F.min_by("parent_class", "file_path").alias("parent_class"))
    known = one.select(F.col("class_name").alias("parent_class"))
    up = one.join(known, "parent_class", "left_semi").select(F.col("class_name").alias("src"), F.col("parent_class").alias("dst"))
    own = one.select("class_name", F.col("class_name").alias("ancestor"), F.lit(0).alias("depth"))
    return own.unionByName(closure(up).select(F.col("src").alias("class_name"), F.col("dst").alias("ancestor"), "depth"))


def method_resolution(classes: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(class_name, method, node_id) of the nearest definition up the chain."""
    one = classes.groupBy("class_name").agg(F.min("file_path").alias("file_path"), F.min_by("methods", "file_path").alias("methods"))
    held = one.select(F.col("class_name").alias("ancestor"), "file_path", F.explode("methods").alias("method"))
    node = F.concat("file_path", F.lit("::"), "ancestor", F.lit("."), "method")
    return ancestors.join(held, "ancestor").groupBy("class_name", "method").agg(F.min_by(node, "depth").alias("node_id"))


def call_graph(sites: DataFrame, definitions: DataFrame, classes: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct call edges (caller, callee) and unresolved calls (caller, seq, repr, reason), the latter with repeats."""
    ancestors = class_ancestors(classes)
    methods = method_resolution(classes, ancestors)
    functions = definitions.filter("kind = 'function'").select("file_path", F.col("name").alias("callee"), F.col("node_id").alias("target"))
    key = ["caller", "seq", "file_path"]
    resolved = methods.select(F.col("class_name").alias("sub"), F.col("method").alias("callee"), F.col("node_id").alias("target"))

    selves = sites.filter("kind = 'self'")
    below = ancestors.select(F.col("class_name").alias("sub"), F.col("ancestor").alias("class_name"))
    own = selves.filter("class_name IS NOT NULL").join(below, "class_name").join(resolved, ["sub", "callee"]).select("class_name", "callee", "caller", "target")
    supers = sites.filter("kind = 'super'")
    parents = classes.groupBy("class_name").agg(F.min_by("parent_class", "file_path").alias("parent"))
    upper = supers.join(parents, "class_name").join(resolved.withColumnRenamed("sub", "parent"), ["parent", "callee"]).select("class_name", "callee", "caller", "target")

    bare = sites.filter("kind = 'bare'")
    stem = module_of("file_path")
    # Only imports of files that define a function can name one: most name libraries.
    other = F.concat(F.replace(F.col("module"), F.lit("."), F.lit("/")), F.lit(".py"))
    through = imports.select("stem", F.col("seq").alias("at"), other.alias("other")).join(functions.select(F.col("file_path").alias("other")).hint("merge"), "other", "left_semi")
    there = functions.withColumnRenamed("file_path", "other")
    made = methods.filter("method = '__init__'").select(F.col("class_name").alias("callee"), F.col("node_id").alias("target"))
    local = bare.join(functions, ["file_path", "callee"]).select(*key, F.lit(0).alias("rank"), F.lit(0).alias("at"), "target")
    away = bare.withColumn("stem", stem).join(through, "stem").join(there, ["other", "callee"]).select(*key, F.lit(1).alias("rank"), "at", "target")
    built = bare.join(made, "callee").select(*key, F.lit(2).alias("rank"), F.lit(0).alias("at"), "target")
    plain = reduce(DataFrame.unionByName, [local, away, built]).groupBy(*key).agg(F.min_by("target", F.struct("rank", "at", "target")).alias("target"))
    edges = reduce(DataFrame.unionByName, [x.select("caller", F.col("target").alias("callee")) for x in (own, upper, plain)]).distinct()

    # What resolves a call is asked by the names that decide it, so a call is led on only while nothing was found.
    unknown = bare.join(functions.hint("merge"), ["file_path", "callee"], "left_anti").withColumn("stem", stem)
    reached = unknown.select("stem", "callee").join(through, "stem").join(there, ["other", "callee"], "left_semi").select("stem", "callee")
    unknown = unknown.join(reached.hint("merge"), ["stem", "callee"], "left_anti").join(made.hint("merge"), "callee", "left_anti")
    missed = [
        (selves.join(own.hint("merge"), ["class_name", "callee"], "left_anti"), F.when(F.col("class_name").isNull(), "self outside a class").otherwise("no class of the hierarchy defines it")),
        (supers.join(upper.hint("merge"), ["class_name", "callee"], "left_anti"), F.lit("no ancestor defines it")),
        (unknown, F.lit("no function or class of that name is known here")),
        (sites.filter("coalesce(kind, '') NOT IN ('self', 'super', 'bare')"), F.lit("the receiver's type isn't known")),
    ]
    return edges, reduce(DataFrame.unionByName, [x.select("caller", "seq", "repr", reason.alias("reason")) for x, reason in missed])


def class_to_file(classes: DataFrame) -> DataFrame:
    return classes.groupBy("class_name").agg(F.min(module_of("file_path")).alias("stem"))
