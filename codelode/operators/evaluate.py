"""Joins of the evaluation: spans, vocabularies, label checks."""

from __future__ import annotations

import builtins
import keyword

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.metrics import cost, identifiers, rate, tokens
from .shared import settled


#: Names that Python itself has.
LANGUAGE = sorted({*dir(builtins), *keyword.kwlist})


def _binned(spans: DataFrame, start: str, end: str, side: str) -> DataFrame:
    """Spans with their bounds, and the level whose bins, of 2^level lines, are just not shorter than they are."""
    low, high = F.least(start, end), F.greatest(start, end)
    return spans.withColumns({f"__{side}_low": low, f"__{side}_high": high, f"__{side}_level": F.ceil(F.log2((high - low + 1).cast("double"))).cast("int")})


def _listed(spans: DataFrame, side: str, levels: Column) -> DataFrame:
    """Spans once for each bin (__at, __bin), of which there are at most two a level, that they lie in at the given levels."""
    at = spans.select("*", F.explode(levels).alias("__at"))
    bin_of = lambda bound: F.floor(F.col(f"__{side}_{bound}") / F.pow(F.lit(2.0), F.col("__at")))
    return at.withColumn("__bin", F.explode(F.array_distinct(F.array(bin_of("low"), bin_of("high")))))


def spans_meet(spans: DataFrame, gold: DataFrame, contain: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Pairs of spans (keys, start, end) and gold spans (keys, g_start, g_end) that overlap, or of which the first contains the second.

    Keys are ``file`` unless given. A pair meets in the bins of its longer span's level: the longer is listed in the bins
    of its own level, the shorter in those of all levels above its own that the other side has. So a file with n spans
    and m gold spans costs some rows a span and what really lies close, not n x m, and its bins are dealt out apart.
    Spans whose end lies before their start meet what the conditions say; nulls meet nothing.
    """
    keys = keys or ["file"]
    left, right = _binned(spans, "start", "end", "s"), _binned(gold, "g_start", "g_end", "g")
    levels = lambda df, side: df.agg(F.collect_set(f"__{side}_level")).scalar()  # noqa: E731  at most 64
    own = lambda df, side: _listed(df, side, F.array(f"__{side}_level"))
    s_above = _listed(left.withColumn("__all", levels(right, "g")), "s", F.filter("__all", lambda x: x > F.col("__s_level"))).drop("__all")
    g_above = _listed(right.withColumn("__all", levels(left, "s")), "g", F.filter("__all", lambda x: x >= F.col("__g_level"))).drop("__all")
    met = own(left, "s").join(g_above, [*keys, "__at", "__bin"]).unionByName(s_above.join(own(right, "g"), [*keys, "__at", "__bin"]))
    # A pair that shares two bins counts in that of the later begin.
    met = met.filter(F.col("__bin") == F.floor(F.greatest("__s_low", "__g_low") / F.pow(F.lit(2.0), F.col("__at"))))
    met = met.drop("__at", "__bin", *(f"__{side}_{x}" for side in "sg" for x in ("low", "high", "level")))
    return met.filter("start <= g_start AND end >= g_end" if contain else "start <= g_end AND end >= g_start")


def gold_reached(gold: DataFrame, spans: DataFrame, query_id: str = "id") -> DataFrame:
    """(id, hit, complete, recall) over a query's distinct gold spans."""
    key = [query_id, "file", "g_start", "g_end"]
    each = gold.select(*key).distinct()
    met = spans_meet(spans.select(query_id, "file", "start", "end").distinct(), each, keys=[query_id, "file"]).select(*key).distinct().withColumn("ok", F.lit(True))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key]
    joined = each.alias("l").join(met.alias("r"), same, "left").select(*(F.col(f"l.{c}") for c in key), F.coalesce("ok", F.lit(False)).alias("ok"))
    return joined.groupBy(query_id).agg(F.bool_or("ok").alias("hit"), F.bool_and("ok").alias("complete"), F.avg(F.col("ok").cast("double")).alias("recall"))


def unknown_tokens(texts: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """(token) of the texts that aren't in the vocabulary's texts."""
    of = lambda df: df.select(F.explode(tokens(F.col(text))).alias("token")).distinct()
    return of(texts).join(of(vocabulary), "token", "left_anti")


def odd_identifiers(answers: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, identifier, kind) of what answers name without ground. answers: id, answer, context; vocabulary: token.

    ``fabricated``: not in the vocabulary; ``outside``: in the vocabulary, but not in the answer's context.
    The vocabulary grows with the code base, so it is exchanged and sorted, not held whole by each executor.
    """
    named = answers.select("id", F.explode(identifiers(F.col("answer"))).alias("token"))
    held = answers.select("id", F.explode(tokens(F.col("context"))).alias("token"))
    fabricated = named.join(vocabulary.hint("merge"), "token", "left_anti").withColumn("kind", F.lit("fabricated"))
    outside = named.join(held, ["id", "token"], "left_anti").join(vocabulary.hint("merge"), "token", "left_semi").withColumn("kind", F.lit("outside"))
    return fabricated.unionByName(outside).select("id", F.col("token").alias("identifier"), "kind")


#: Fixed value: a citation's file, place and lines.
CITATION = r"^(\S+) :: (.+) \(lines (\d+)-(\d+)\)$"


def checked_citations(cited: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, citation, parsed, resolves, exact, inside) of citations (id, citation) against gold nodes (node_id, g_start, g_end).

    What isn't written as a citation isn't parsed and none of the rest; numbers too long for a line do not parse either.
    """
    part = lambda k: F.regexp_extract("citation", CITATION, k)
    line = lambda k: F.try_to_number(part(k), F.lit("9999999999")).cast("long")
    read = cited.withColumns({"start": line(3), "end": line(4)}).withColumn("parsed", F.col("start").isNotNull() & F.col("end").isNotNull())
    read = read.withColumn("node_id", F.when(F.col("parsed"), F.concat(part(1), F.lit("::"), part(2))))
    met = read.join(gold, "node_id", "left")
    exact, inside = F.expr("start = g_start AND end = g_end"), F.expr("g_start <= start AND start <= end AND end <= g_end")
    return met.select("id", "citation", "parsed", F.col("g_start").isNotNull().alias("resolves"), F.coalesce(exact, F.lit(False)).alias("exact"), F.coalesce(inside, F.lit(False)).alias("inside"))


def citation_totals(checked: DataFrame) -> DataFrame:
    """One row over all citations: how many there are, resolve, are exact, and can't be parsed."""
    return checked.agg(F.count(F.lit(1)).alias("n_citations"), *(F.count_if(F.col(c)).alias(name) for c, name in (("resolves", "resolve"), ("exact", "line_exact"))), F.count_if(~F.col("parsed")).alias("unparseable"))


def joined_stages(rows: DataFrame, deterministic: DataFrame, pipeline: DataFrame, judged: DataFrame) -> DataFrame:
    """Labelled queries with what each stage says of them, by id; a query need not be judged."""
    return rows.join(deterministic, "id").join(pipeline, "id").join(judged, "id", "left")


def chosen_rows(stages: DataFrame, intent: str | None = None, expect: str | None = None, with_gold: bool = False, without_error: bool = True) -> DataFrame:
    """Rows of an evaluation by intent, by what is expected, with gold, without an error."""
    out = stages
    for wanted, column in ((intent, "intent"), (expect, "expect")):
        if wanted is not None:
            out = out.filter(F.col(column) == wanted)
    out = out.filter(F.size("gold") > 0) if with_gold else out
    return out.filter("error IS NULL") if without_error else out


def same_spans(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, same, meet): whether both have the same set of spans, and whether any is in both. a, b: id, file, start, end."""
    spans = lambda df, name: df.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("file", "start", "end"))).alias(name))
    both = spans(a, "a").join(spans(b, "b"), "id", "full_outer")
    return both.select("id", F.col("a").eqNullSafe(F.col("b")).alias("same"), F.coalesce(F.arrays_overlap("a", "b"), F.lit(False)).alias("meet"))


def token_sums(usage: DataFrame, price_in: float | None = None, price_out: float | None = None) -> DataFrame:
    """(id, tokens_in, tokens_out[, cost]) over all models of a query; usage: id, model, tokens_in, tokens_out."""
    out = usage.groupBy("id").agg(F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"))
    if price_in is None or price_out is None:
        return out
    return out.withColumn("cost", cost(F.col("tokens_in"), F.col("tokens_out"), price_in, price_out))


def failures_by_kind(failures: DataFrame) -> DataFrame:
    """(kind, n, first, last) of failures (kind, id), kinds in order; who failed is listed by ``failures`` itself."""
    return failures.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).orderBy("kind")


def failures_listed(failures: DataFrame) -> DataFrame:
    """(kind, n, id, detail) of every failure (kind, id, detail), kinds and then ids in order, with how many its kind has."""
    n = failures.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return failures.join(n, "kind").select("kind", "n", "id", "detail").orderBy("kind", "id")


def package_vocabulary(files: DataFrame, source: str = "source") -> DataFrame:
    """(token, files) of a whole package: how many of its files hold a token; the language's own names and keywords belong to it too, with 0 where no file holds them."""
    held = files.select(F.explode(tokens(F.coalesce(source, F.lit("")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("files"))
    own = files.sparkSession.createDataFrame([(t,) for t in LANGUAGE], "token string")
    return held.join(F.broadcast(own), "token", "full_outer").select("token", F.coalesce("files", F.lit(0)).alias("files"))


def rates(rows: DataFrame, key: str, hit: str) -> DataFrame:
    """(key, k, n, rate) of a condition by group, as text with its interval."""
    counted = rows.groupBy(key).agg(F.count_if(F.col(hit)).alias("k"), F.count(F.lit(1)).alias("n"))
    return counted.withColumn("rate", rate(F.col("k"), F.col("n")))


def label_errors(queries: DataFrame, nodes: DataFrame, scope: DataFrame) -> DataFrame:
    """(id, problem) of labelled queries: unknown gold, a term that no gold source holds, unknown file, repeated id, bad intent.

    nodes: node_id, source; a must-mention entry is a list of alternatives of which one has to be in a gold node's source.
    """
    gold = queries.select("id", F.explode("gold").alias("node_id")).join(nodes, "node_id", "left")
    unknown = gold.filter("source IS NULL").select("id", F.concat(F.lit("unknown gold "), "node_id").alias("problem"))
    entries = queries.filter(F.size("gold") > 0).select("id", F.posexplode("must_mention").alias("at", "terms"))
    held = entries.join(gold.filter("source IS NOT NULL").select("id", "source"), "id", "left")
    shown = held.groupBy("id", "at", "terms").agg(F.bool_or(F.coalesce(F.expr("exists(terms, t -> contains(lower(source), lower(t)))"), F.lit(False))).alias("ok"))
    underived = shown.filter("NOT ok").select("id", F.concat(F.lit("no gold source holds "), F.array_join("terms", "|")).alias("problem"))
    files = queries.select("id", F.explode("target_files").alias("stem")).join(scope, "stem", "left_anti").select("id", F.concat(F.lit("unknown file "), "stem").alias("problem"))
    twice = queries.groupBy("id").count().filter("count > 1").select("id", F.lit("repeated id").alias("problem"))
    intent = queries.filter("intent NOT IN ('code_explanation', 'risk_assessment')").select("id", F.lit("bad intent").alias("problem"))
    return unknown.unionByName(underived).unionByName(files).unionByName(twice).unionByName(intent)


def flagged_claims(judged: DataFrame) -> DataFrame:
    """(verdict, claims, answers) of claims that aren't supported; judged: id, claims array<struct<claim, verdict, evidence>>."""
    each = judged.select("id", F.explode("claims").alias("c")).filter("c.verdict <> 'supported'")
    return each.groupBy(F.col("c.verdict").alias("verdict")).agg(F.count(F.lit(1)).alias("claims"), F.count_distinct("id").alias("answers"))


#: Buckets by value that a group is cut into to find a rank.
RANK_BUCKETS = 200


def _at_ranks(rows: DataFrame, key: str, value: str, ranks: dict) -> DataFrame:
    """(key, one column a name) with the value at a rank, given as a column of the group's ``total``, for groups of any size.

    Values are counted, once, dealt into buckets between approximate quantiles, and only the bucket that holds a rank is
    sorted. Rows with a null key or value don't count.
    """
    counted = settled(rows.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n")), "counted")
    cuts = counted.groupBy(key).agg(F.percentile_approx(value, [k / RANK_BUCKETS for k in range(1, RANK_BUCKETS)]).alias("cuts"))
    dealt = counted.join(cuts, key).select(key, value, "n", F.size(F.filter("cuts", lambda c: c < F.col(value))).alias("bucket"))
    own = Window.partitionBy(key)
    sums = dealt.groupBy(key, "bucket").agg(F.sum("n").alias("many"))
    sums = sums.withColumns({"upto": F.sum("many").over(own.orderBy("bucket")), "total": F.sum("many").over(own)})
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()))
    held = sums.select(key, "bucket", (F.col("upto") - F.col("many")).alias("before"), "upto", F.inline(wanted)).filter("before <= rank AND rank < upto")
    inside = dealt.join(held, [key, "bucket"]).withColumn("at", F.col("before") + F.sum("n").over(Window.partitionBy(key, "name").orderBy(value)))
    return inside.filter("rank < at").groupBy(key).agg(*(F.min(F.when(F.col("name") == name, F.col(value))).alias(name) for name in ranks))


def nearest_ranks(rows: DataFrame, key: str, value: str, ranks: dict[str, float]) -> DataFrame:
    """(key, one column a name) with the value at rank round(q (n - 1)), half to even; a group without values has NaN, null keys are left out."""
    found = _at_ranks(rows, key, value, {name: F.bround(F.lit(float(q)) * (F.col("total") - 1)) for name, q in ranks.items()})
    groups = rows.filter(F.col(key).isNotNull()).select(key).distinct()
    return groups.join(found, key, "left").select(key, *(F.coalesce(name, F.lit(float("nan"))).alias(name) for name in ranks))


def exact_medians(rows: DataFrame, values: list[str]) -> dict[str, float | None]:
    """The medians of some columns over all rows, in one pass over them: the mean of the middle values, None without any."""
    each = rows.select(F.inline(F.array(*(F.struct(F.lit(v).alias("name_of"), F.col(v).cast("double").alias("value")) for v in values))))
    middle = {"low": F.floor((F.col("total") - 1) / 2), "high": F.floor(F.col("total") / 2)}
    found = {r["name_of"]: (r["low"] + r["high"]) / 2 for r in _at_ranks(each, "name_of", "value", middle).collect()}  # a row a column
    return {v: found.get(v) for v in values}
