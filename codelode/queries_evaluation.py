"""Queries of whole evaluations over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import evaluate, summary


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _rows(spark, sf):
    """Orders as evaluated queries: what every stage said of one, by its keys, price and status."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    either = lambda by, one, other: F.when(by, one).otherwise(other)
    intent = either(c % 3 == 0, F.lit("risk_assessment"), F.lit("code_explanation"))
    got = either(k % 10 == 0, F.lit("code_explanation"), intent)
    expect = F.when(k % 5 == 1, "abstain").when((k % 5 == 2) & (c % 3 == 0), "clarify").otherwise("answer")
    answer = F.when(k % 4 == 0, "There is no mention of it").when(k % 4 == 1, "Which file do you mean?").otherwise("It opens the file.")
    files = F.array(F.format_string("m%d", c % 7))
    explained = c % 3 != 0
    of = {
        "id": k, "category": F.col("o_orderpriority"), "intent": intent, "expect": expect, "n_gold": either(explained, c % 2, F.lit(0)), "target_files": files,
        "error": F.when(F.col("o_totalprice") > 400_000, "timeout"), "attempts": 1 + k % 3, "fell_back": k % 9 == 0, "got_intent": got, "answer": answer,
        "risk_files": F.when(k % 5 != 2, F.when(k % 8 == 0, F.array(F.lit("m1"))).otherwise(files)), "numbers_ok": k % 6 != 0, "extracted_files": either(k % 11 == 0, F.array().cast("array<string>"), files),
        "hit_primary": k % 4 != 3, "hit_naive": k % 3 != 0, "recall_context": (k % 5) / 4, "recall_naive": (k % 3) / 2, "retrieval_s": F.when(explained, (k % 100) / 100),
        "n_citations": k % 4, "n_resolve": F.greatest(k % 4 - 1, F.lit(0)), "n_exact": F.when(k % 7 == 0, F.lit(0)).otherwise(F.greatest(k % 4 - 1, F.lit(0))), "n_unparsed": F.when(k % 4 > 2, 1).otherwise(0), "gold_cited": k % 6 != 1, "replayed": F.when(k % 2 == 0, k % 12 != 0),
        "fact_hits": F.least(k % 3, c % 4), "n_facts": c % 4, "n_fabricated": F.when(k % 3 != 0, F.when(k % 15 == 1, 1).otherwise(0)), "n_outside": F.when(k % 5 == 0, 2).otherwise(0),
        "n_claims": F.when(k % 2 == 1, 3), "n_unsupported": F.when(k % 9 == 1, 1).otherwise(0), "n_contradicted": F.when(k % 21 == 1, 1).otherwise(0), "judge_abstains": k % 6 == 1,
        "latency_s": F.col("o_totalprice") / 100_000, "tokens_in": k % 1_000, "tokens_out": k % 100,
    }
    return _t(spark, sf, "orders").select(*(v.alias(n) for n, v in of.items()))


def evaluation_summary(spark, sf):
    table = summary.summary(summary.measured(_rows(spark, sf), summary.measures()))
    return table.select("measure", "slice", F.round("k", 4).alias("k"), "n", F.round("mean", 6).alias("mean"))


def evaluation_failures(spark, sf):
    return summary.failures(summary.measured(_rows(spark, sf), summary.measures()))


def evaluation_percentiles(spark, sf):
    names = ["latency_s", "retrieval_s"]
    each = summary.measured(_rows(spark, sf), [m for m in summary.measures() if m.name in names])
    return summary.percentiles(each, names, {"p50": 0.5, "p95": 0.95})


def failures_listed(spark, sf):
    e = _t(spark, sf, "events").filter("value > 90")
    return evaluate.failures_listed(e.select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.format_string("user %d", "user_id").alias("detail")))


def package_vocabulary(spark, sf):
    """Documents as the files of a package."""
    return evaluate.package_vocabulary(_t(spark, sf, "documents"), "text")


QUERIES = {f.__name__: f for f in (evaluation_summary, evaluation_failures, evaluation_percentiles, failures_listed, package_vocabulary)}

_E = """o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS category, o_totalprice AS price, o_custkey % 3 = 0 AS risk, o_totalprice <= 400000 AS ok FROM orders),
w AS (SELECT *, NOT risk AS code, risk AND k % 10 <> 0 AS grisk, CASE WHEN k % 5 = 1 THEN 'abstain' WHEN k % 5 = 2 AND risk THEN 'clarify' ELSE 'answer' END AS expect, NOT risk AND c % 2 > 0 AS gold, k % 4 AS cites, greatest(k % 4 - 1, 0) AS res, CASE WHEN k % 7 = 0 THEN 0 ELSE greatest(k % 4 - 1, 0) END AS exact, CASE WHEN risk AND k % 10 <> 0 THEN 'risk_assessment' ELSE 'code_explanation' END AS got,
 k % 5 <> 2 AND (k % 8 <> 0 OR c % 7 = 1) AS same_files FROM o),
x AS (SELECT *, ok AND expect = 'answer' AND code AS expl, ok AND expect = 'answer' AND risk AS askr, ok AND expect = 'abstain' AS quiet, k % 2 = 1 AS judged FROM w),
e AS (SELECT k AS id, unnest([
 {measure: 'completed', slice: category, amount: ok::INT::DOUBLE, weight: 1::DOUBLE, about: true, fails: NULL},
 {measure: 'retried', slice: category, amount: (k % 3 > 0)::INT, weight: 1, about: true, fails: NULL},
 {measure: 'fallback_used', slice: category, amount: (k % 9 = 0)::INT, weight: 1, about: ok, fails: NULL},
 {measure: 'intent', slice: category, amount: (risk = grisk)::INT, weight: 1, about: ok, fails: 'intent'},
 {measure: 'file_extraction', slice: category, amount: (k % 11 <> 0)::INT, weight: 1, about: risk, fails: 'file_extraction'},
 {measure: 'risk_right_files', slice: category, amount: (grisk AND same_files)::INT, weight: 1, about: askr, fails: NULL},
 {measure: 'risk_right_numbers', slice: category, amount: (grisk AND same_files AND k % 6 <> 0)::INT, weight: 1, about: askr, fails: 'risk'},
 {measure: 'clarification', slice: category, amount: (grisk AND k % 5 = 2 AND k % 4 = 1)::INT, weight: 1, about: ok AND expect = 'clarify', fails: 'clarification'},
 {measure: 'retrieval_hit_system', slice: category, amount: (k % 4 <> 3)::INT, weight: 1, about: gold, fails: 'retrieval'},
 {measure: 'retrieval_hit_naive', slice: category, amount: (k % 3 <> 0)::INT, weight: 1, about: gold, fails: NULL},
 {measure: 'recall_system', slice: category, amount: (k % 5) / 4, weight: 1, about: gold, fails: NULL},
 {measure: 'recall_naive', slice: category, amount: (k % 3) / 2, weight: 1, about: gold, fails: NULL},
 {measure: 'retrieval_s', slice: category, amount: (k % 100) / 100, weight: 1, about: code, fails: NULL},
 {measure: 'citations_resolve', slice: category, amount: res, weight: cites, about: expl, fails: NULL},
 {measure: 'citations_line_exact', slice: category, amount: exact, weight: cites, about: expl, fails: NULL},
 {measure: 'citations_unparseable', slice: category, amount: (k % 4 > 2)::INT, weight: cites, about: expl, fails: NULL},
 {measure: 'zero_citations', slice: category, amount: (cites = 0)::INT, weight: 1, about: expl, fails: NULL},
 {measure: 'citation_validity', slice: category, amount: (exact = cites)::INT, weight: 1, about: expl AND cites > 0, fails: 'citation_validity'},
 {measure: 'gold_cited', slice: category, amount: (k % 6 <> 1)::INT, weight: 1, about: expl AND gold, fails: 'citation_gold'},
 {measure: 'context_replay', slice: category, amount: (k % 12 <> 0)::INT, weight: 1, about: expl AND k % 2 = 0, fails: NULL},
 {measure: 'key_facts', slice: category, amount: (least(k % 3, c % 4) = c % 4)::INT, weight: 1, about: expl AND c % 4 > 0, fails: 'key_facts'},
 {measure: 'key_facts_fraction', slice: category, amount: least(k % 3, c % 4) / greatest(c % 4, 1), weight: 1, about: expl AND c % 4 > 0, fails: NULL},
 {measure: 'names_not_in_repo', slice: category, amount: (k % 15 = 1)::INT, weight: 1, about: ok AND NOT grisk AND k % 3 <> 0, fails: NULL},
 {measure: 'names_outside_context', slice: category, amount: (k % 5 = 0)::INT, weight: 1, about: ok AND NOT grisk AND k % 3 <> 0, fails: NULL},
 {measure: 'answers_with_flagged_claim', slice: category, amount: (k % 9 = 1 OR k % 21 = 1)::INT, weight: 1, about: expl AND judged, fails: NULL},
 {measure: 'claims_unsupported', slice: category, amount: (k % 9 = 1)::INT, weight: 3, about: expl AND judged, fails: NULL},
 {measure: 'claims_contradicted', slice: category, amount: (k % 21 = 1)::INT, weight: 3, about: expl AND judged, fails: NULL},
 {measure: 'faithfulness_unsupported', slice: category, amount: (k % 9 <> 1)::INT, weight: 1, about: expl AND judged, fails: 'faithfulness/unsupported'},
 {measure: 'faithfulness_contradicted', slice: category, amount: (k % 21 <> 1)::INT, weight: 1, about: expl AND judged, fails: 'faithfulness/contradicted'},
 {measure: 'abstention_judge', slice: category, amount: (k % 6 = 1)::INT, weight: 1, about: quiet AND judged, fails: 'abstention'},
 {measure: 'abstention_phrase', slice: category, amount: (k % 4 = 0)::INT, weight: 1, about: quiet, fails: NULL},
 {measure: 'abstention_with_citations', slice: category, amount: (cites > 0)::INT, weight: 1, about: quiet, fails: NULL},
 {measure: 'latency_s', slice: got, amount: price / 100000, weight: 1, about: ok, fails: NULL},
 {measure: 'tokens_in', slice: got, amount: k % 1000, weight: 1, about: ok, fails: NULL},
 {measure: 'tokens_out', slice: got, amount: k % 100, weight: 1, about: ok, fails: NULL}], recursive := true) FROM x),
m AS (SELECT * FROM e WHERE about)"""

ORACLES = {
    "evaluation_summary": f"WITH {_E} SELECT measure, coalesce(slice, 'all') AS slice, round(sum(amount), 4) AS k, sum(weight) AS n, CASE WHEN sum(weight) > 0 THEN round(sum(amount) / sum(weight), 6) END AS mean FROM m GROUP BY GROUPING SETS ((measure, slice), (measure))",
    "evaluation_failures": f"WITH {_E} SELECT fails AS kind, id FROM m WHERE fails IS NOT NULL AND amount = 0",
    "evaluation_percentiles": f"""WITH {_E}, b AS (SELECT measure, unnest(['all', slice]) AS slice, amount FROM m WHERE measure IN ('latency_s', 'retrieval_s')), g AS (SELECT measure, slice, list(amount ORDER BY amount) AS v, count(*) AS n FROM b GROUP BY ALL)
SELECT measure, slice, v[round_even(0.5::DOUBLE * (n - 1), 0)::INT + 1] AS p50, v[round_even(0.95::DOUBLE * (n - 1), 0)::INT + 1] AS p95 FROM g""",
    "failures_listed": "SELECT event_type AS kind, count(*) OVER (PARTITION BY event_type) AS n, event_id AS id, 'user ' || user_id AS detail FROM events WHERE value > 90",
    "package_vocabulary": f"""WITH t AS (SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*'))) AS token FROM documents) GROUP BY token), o AS (SELECT unnest({evaluate.LANGUAGE}) AS token)
SELECT coalesce(t.token, o.token) AS token, coalesce(n, 0) AS files FROM t FULL JOIN o ON t.token = o.token""",
}
