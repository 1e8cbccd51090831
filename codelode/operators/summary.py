"""An evaluation's numbers and failures in one pass over its queries.

A query's row holds what all stages say of it. Each number is a measure: the queries it is about, and for each of these
whether it holds or how much it is. All measures of a row are listed side by side and grouped once, by measure and by
measure and slice, so a summary of any number of measures reads its rows once; percentiles are found by rank over the
same list. Failures come from the same row: a measure that should hold and doesn't names its query.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import abstains, rate
from .evaluate import nearest_ranks
from .shared import settled


class Measure(NamedTuple):
    """``about``: the rows that count; ``holds``: a condition, or ``value``: an amount, with ``weight`` cases in a row; ``fails``: the kind of failure where it doesn't hold."""

    name: str
    about: Column
    holds: Column | None = None
    value: Column | None = None
    weight: Column | None = None
    slice: str | None = "category"
    fails: str | None = None


#: Columns of a query's row that the measures below read.
COLUMNS = "id, category, intent, expect, n_gold, target_files, error, attempts, fell_back, got_intent, answer, risk_files, numbers_ok, extracted_files, hit_primary, hit_naive, recall_context, recall_naive, retrieval_s, n_citations, n_resolve, n_exact, n_unparsed, gold_cited, replayed, fact_hits, n_facts, n_fabricated, n_outside, n_claims, n_unsupported, n_contradicted, judge_abstains, latency_s, tokens_in, tokens_out"


def measures() -> list[Measure]:
    """The numbers of an evaluation: reliability, routing, files, risk, clarification, retrieval, citations, facts, names, claims, abstention, time and tokens."""
    c = F.col
    ok, code, risk = c("error").isNull(), c("intent") == "code_explanation", c("intent") == "risk_assessment"
    got_code, got_risk = c("got_intent") == "code_explanation", c("got_intent") == "risk_assessment"
    answered = ok & (c("expect") == "answer")
    gold, explained, asked_risk = code & (c("n_gold") > 0), answered & code & got_code, answered & risk
    clear, quiet = ok & (c("expect") == "clarify"), ok & (c("expect") == "abstain")
    judged, named = c("n_claims").isNotNull(), ok & got_code & c("n_fabricated").isNotNull()
    flagged = c("n_unsupported") + c("n_contradicted")
    every = F.lit(True)
    right_files = got_risk & (c("risk_files") == c("target_files"))
    return [
        Measure("completed", every, ok),
        Measure("retried", every, c("attempts") > 1),
        Measure("fallback_used", ok, c("fell_back")),
        Measure("intent", ok, c("got_intent") == c("intent"), fails="intent"),
        Measure("file_extraction", risk, c("extracted_files") == c("target_files"), fails="file_extraction"),
        Measure("risk_right_files", asked_risk, right_files),
        Measure("risk_right_numbers", asked_risk, right_files & c("numbers_ok"), fails="risk"),
        Measure("clarification", clear, got_risk & c("risk_files").isNull() & F.lower("answer").contains("which file"), fails="clarification"),
        Measure("retrieval_hit_system", gold, c("hit_primary"), fails="retrieval"),
        Measure("retrieval_hit_naive", gold, c("hit_naive")),
        Measure("recall_system", gold, value=c("recall_context")),
        Measure("recall_naive", gold, value=c("recall_naive")),
        Measure("retrieval_s", code & c("retrieval_s").isNotNull(), value=c("retrieval_s")),
        Measure("citations_resolve", explained, value=c("n_resolve"), weight=c("n_citations")),
        Measure("citations_line_exact", explained, value=c("n_exact"), weight=c("n_citations")),
        Measure("citations_unparseable", explained, value=c("n_unparsed"), weight=c("n_citations")),
        Measure("zero_citations", explained, c("n_citations") == 0),
        Measure("citation_validity", explained & (c("n_citations") > 0), c("n_exact") == c("n_citations"), fails="citation_validity"),
        Measure("gold_cited", explained & (c("n_gold") > 0), c("gold_cited"), fails="citation_gold"),
        Measure("context_replay", explained & c("replayed").isNotNull(), c("replayed")),
        Measure("key_facts", explained & (c("n_facts") > 0), c("fact_hits") == c("n_facts"), fails="key_facts"),
        Measure("key_facts_fraction", explained & (c("n_facts") > 0), value=c("fact_hits") / c("n_facts")),
        Measure("names_not_in_repo", named, c("n_fabricated") > 0),
        Measure("names_outside_context", named, c("n_outside") > 0),
        Measure("answers_with_flagged_claim", explained & judged, flagged > 0),
        Measure("claims_unsupported", explained & judged, value=c("n_unsupported"), weight=c("n_claims")),
        Measure("claims_contradicted", explained & judged, value=c("n_contradicted"), weight=c("n_claims")),
        Measure("faithfulness_unsupported", explained & judged, c("n_unsupported") == 0, fails="faithfulness/unsupported"),
        Measure("faithfulness_contradicted", explained & judged, c("n_contradicted") == 0, fails="faithfulness/contradicted"),
        Measure("abstention_judge", quiet & judged, c("judge_abstains"), fails="abstention"),
        Measure("abstention_phrase", quiet, abstains(c("answer"))),
        Measure("abstention_with_citations", quiet, c("n_citations") > 0),
        Measure("latency_s", ok, value=c("latency_s"), slice="got_intent"),
        Measure("tokens_in", ok, value=c("tokens_in"), slice="got_intent"),
        Measure("tokens_out", ok, value=c("tokens_out"), slice="got_intent"),
    ]


def measured(rows: DataFrame, wanted: list[Measure]) -> DataFrame:
    """(id, measure, slice, amount, weight, fails): every measure that a query is about; conditions are 0 or 1, a null one 0."""

    def one(m: Measure) -> Column:
        amount = F.coalesce(m.holds.cast("int"), F.lit(0)) if m.holds is not None else m.value
        weight = F.lit(1) if m.weight is None else m.weight
        return F.when(m.about, F.struct(F.lit(m.name).alias("measure"), F.col(m.slice).cast("string").alias("slice"), amount.cast("double").alias("amount"), weight.cast("double").alias("weight"), F.when(F.lit(m.fails is not None) & (amount == 0), F.lit(m.fails)).alias("fails")))

    return rows.select("id", F.explode(F.array_compact(F.array(*map(one, wanted)))).alias("m")).select("id", "m.*")


def summary(each: DataFrame) -> DataFrame:
    """(measure, slice, k, n, mean) for every slice and, as slice ``all``, over all; each: what ``measured`` gives.

    ``k`` sums the amounts, ``n`` the weights; rows without an amount don't count, and without any n the mean is null.
    """
    held = each.filter("amount IS NOT NULL")
    grouped = held.groupingSets([["measure", "slice"], ["measure"]], "measure", "slice").agg(F.sum("amount").alias("k"), F.sum("weight").alias("n"), F.grouping("slice").alias("whole"))
    return grouped.select("measure", F.when(F.col("whole") == 1, "all").otherwise(F.col("slice")).alias("slice"), "k", "n", F.when(F.col("n") > 0, F.col("k") / F.col("n")).alias("mean"))


def percentiles(each: DataFrame, names: list[str], ranks: dict[str, float]) -> DataFrame:
    """(measure, slice, one column a rank) of amounts by nearest rank, over all and by slice."""
    some = each.filter(F.col("measure").isin(names) & F.col("amount").isNotNull())
    both = some.select("measure", F.explode(F.array(F.lit("all"), F.coalesce("slice", F.lit("")))).alias("slice"), "amount")
    keyed = both.select(F.to_json(F.struct("measure", "slice")).alias("key"), "amount")
    found = nearest_ranks(keyed, "key", "amount", ranks)
    return found.select(F.get_json_object("key", "$.measure").alias("measure"), F.get_json_object("key", "$.slice").alias("slice"), *ranks)


def failures(each: DataFrame) -> DataFrame:
    """(kind, id) of everything that should hold and doesn't, all of them, in order."""
    return each.filter("fails IS NOT NULL").select(F.col("fails").alias("kind"), "id").orderBy("kind", "id")


def with_rates(table: DataFrame) -> DataFrame:
    """The summary with its conditions as text: k of n, per cent, and the interval."""
    return table.withColumn("rate", rate(F.col("k"), F.col("n")))


def write_evaluation(rows: DataFrame, path: str, meta: dict[str, str], ranks: dict[str, float] | None = None) -> None:
    """Writes ``summary.json`` (a line a measure and slice, with percentiles), ``failures.json`` (a line a failure) and ``meta.json`` below ``path``.

    Every number comes from one list of measures, which is written once and read for each file.
    """
    spark = rows.sparkSession
    each = settled(measured(rows, measures()), "measured")
    timed = percentiles(each, ["latency_s", "retrieval_s"], ranks or {"p50": 0.5, "p95": 0.95})
    table = with_rates(summary(each)).join(timed, ["measure", "slice"], "left")
    table.repartitionByRange(1, "measure", "slice").sortWithinPartitions("measure", "slice").write.mode("overwrite").json(f"{path}/summary.json")
    failures(each).write.mode("overwrite").json(f"{path}/failures.json")
    n = rows.agg(F.count(F.lit(1)).alias("n_queries"))
    n.select("n_queries", *(F.lit(v).alias(k) for k, v in sorted(meta.items()))).write.mode("overwrite").json(f"{path}/meta.json")
