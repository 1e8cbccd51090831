"""Queries of commit histories and of the grounding of answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import grounding
from .operators.shared import new_path, settled
from .plans import model_calls
from .sources import code, commits


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def commit_history(spark, sf):
    """Orders as commits to nested files, exported as a log and read back from it: counts for every file of the scope."""
    li = _t(spark, sf, "lineitem")
    nested = F.format_string("lib/d%d/m%d.py", F.col("l_partkey") % 3, "l_partkey")
    touched = li.select(F.col("l_orderkey").cast("string").alias("sha"), F.explode(F.array(nested, F.when(F.col("l_linenumber") == 1, F.format_string("lib/m%d.py", "l_partkey")).otherwise("README"))).alias("path"))
    log = new_path(spark, "log")
    commits.write_commits(touched, log)
    part = _t(spark, sf, "part")
    scope = part.select(F.explode(F.array(F.format_string("m%d", "p_partkey"), F.format_string("d%d.m%d", F.col("p_partkey") % 3, "p_partkey"))).alias("stem"))
    read = commits.read_commits(spark, log, range_bytes=1 << 20).filter(F.col("path").startswith("lib/"))
    return code.commit_counts(read, scope, "lib/")


def _answers(spark, sf):
    """An answer about every document: words of its text in two places, names, and for some that the text doesn't tell."""
    d = _t(spark, sf, "documents").filter("text IS NOT NULL AND doc_id IS NOT NULL")
    w = grounding.words(F.col("text"))
    piece = lambda at, n: F.array_join(F.slice(w, at, n), " ")
    names = F.format_string("and `note_%d.ab` with BaseX", "doc_id")
    quiet = F.when(F.col("doc_id") % 4 == 0, "but there is no mention of it").otherwise("it says")
    answer = F.concat_ws(" ", F.lit("So"), piece(4, 14), names, piece(30, 8), F.lit("MAX_SIZE"), quiet, F.lit("\n\nNote: hidden_name"))
    context = F.concat_ws(" ", "text", F.when(F.col("doc_id") % 5 == 0, F.format_string("note_%d", "doc_id")))
    return d.select(F.col("doc_id").alias("id"), answer.alias("answer"), context.alias("context"))


def _known(spark, sf):
    return _t(spark, sf, "documents").filter("doc_id % 2 = 0").select(F.explode(F.array(F.format_string("note_%d", "doc_id"), F.lit("MAX_SIZE"))).alias("token"))


def answer_grounding(spark, sf):
    found = grounding.grounding(settled(_answers(spark, sf), "answers"), _known(spark, sf))
    return found.select("id", "kind", F.md5("span").alias("span_md5"), "place", "n", "context_place")


def grounded_share(spark, sf):
    answers = settled(_answers(spark, sf), "answers")
    found = grounding.grounded_share(grounding.grounding(answers, _known(spark, sf)), answers)
    return found.select("id", "n_words", "copied_words", F.round("share", 6).alias("share"), F.col("abstains").cast("int").alias("abstains"))


def _offline():
    """A client that answers by a rule: some prompts fail once, some always, some are limited, some are set up wrongly."""
    from .plans.errors import ModelUnavailable, RateLimited

    seen: set[str] = set()

    def client(prompts: list[str]) -> list:
        out: list = []
        for p in prompts:
            k, again = int(p.split(":")[0]), p in seen
            seen.add(p)
            bad = KeyError("key") if k % 17 == 0 else ModelUnavailable("down") if k % 13 == 0 or (k % 7 == 0 and not again) else RateLimited("slow") if k % 11 == 0 else None
            out.append(bad or f"re {p[:40]}")
        return out

    return client


def _calls(spark, sf):
    c = _t(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    prompts = c.select("id", F.concat(F.col("id").cast("string"), F.lit(":"), "text").alias("prompt"))
    model = model_calls.Model(_offline, lambda: lambda prompts: [f"short {p.split(':')[0]}" for p in prompts], first_wait=0.0, most_wait=0.0)
    return model_calls.called(prompts, model)


def model_answers(spark, sf):
    """A model's answers to all turns of conversations, with how the calls went."""
    return _calls(spark, sf).select("id", F.md5("reply").alias("reply_md5"), "attempts", F.col("fell_back").cast("int").alias("fell_back"), "error_code")


def call_totals(spark, sf):
    return model_calls.call_totals(_calls(spark, sf))


QUERIES = {f.__name__: f for f in (commit_history, answer_grounding, grounded_share, model_answers, call_totals)}

_ANSWERS = """d AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
q AS (SELECT doc_id AS id, 'So ' || array_to_string(w[4:17], ' ') || ' and `note_' || doc_id || '.ab` with BaseX ' || array_to_string(w[30:37], ' ') || ' MAX_SIZE ' || CASE WHEN doc_id % 4 = 0 THEN 'but there is no mention of it' ELSE 'it says' END || ' ' AS answer, text || CASE WHEN doc_id % 5 = 0 THEN ' note_' || doc_id ELSE '' END AS context FROM d),
a AS (SELECT id, unnest(regexp_extract_all(answer, '[^ \\t\\n\\x0B\\f\\r]+')) AS x, generate_subscripts(regexp_extract_all(answer, '[^ \\t\\n\\x0B\\f\\r]+'), 1) AS i FROM q),
c AS (SELECT id, unnest(regexp_extract_all(context, '[^ \\t\\n\\x0B\\f\\r]+')) AS x, generate_subscripts(regexp_extract_all(context, '[^ \\t\\n\\x0B\\f\\r]+'), 1) AS j FROM q),
m AS (SELECT a.id, i, j - i AS shift, i - row_number() OVER (PARTITION BY a.id, j - i ORDER BY i) AS run, a.x FROM a JOIN c ON a.id = c.id AND a.x = c.x),
r AS (SELECT id, shift, min(i) AS place, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS span FROM m GROUP BY id, shift, run HAVING count(*) >= 8),
copied AS (SELECT id, place, n, min(place + shift) AS context_place, min(span) AS span FROM r GROUP BY id, place, n)"""

_CALLS = """k AS (SELECT conv_id * 100 + turn AS id, text FROM conversations),
m AS (SELECT id, text, id % 17 = 0 AS wrong, id % 17 <> 0 AND id % 13 = 0 AS down, id % 17 <> 0 AND id % 13 <> 0 AND id % 11 = 0 AS slow, id % 7 = 0 AS once FROM k),
r AS (SELECT id, text, CASE WHEN wrong THEN 1 WHEN down THEN 3 ELSE 1 + once::INT + slow::INT END AS attempts, slow, CASE WHEN wrong THEN 'internal_error' WHEN down THEN 'model_unavailable' END AS error_code FROM m)"""

ORACLES = {
    "model_answers": f"WITH {_CALLS} SELECT id, CASE WHEN error_code IS NULL THEN md5(CASE WHEN slow THEN 'short ' || id ELSE 're ' || left(id || ':' || text, 40) END) END AS reply_md5, attempts, slow::INT AS fell_back, error_code FROM r",
    "call_totals": f"WITH {_CALLS} SELECT count(*) FILTER (error_code IS NULL) AS completed, count(error_code) AS errors, count(*) FILTER (attempts > 1) AS retried, count(*) FILTER (slow AND error_code IS NULL) AS fallback_used FROM r",
    "commit_history": """SELECT 'm' || p_partkey AS stem, coalesce(n, 0) AS commit_count FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) ON l_partkey = p_partkey
UNION ALL SELECT 'd' || p_partkey % 3 || '.m' || p_partkey, coalesce(n, 0) FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""",
    "answer_grounding": f"""WITH {_ANSWERS}, t AS (SELECT id, regexp_extract_all(answer, '[A-Za-z_][A-Za-z0-9_]*') AS said, regexp_extract_all(context, '[A-Za-z_][A-Za-z0-9_]*') AS held FROM q),
n AS (SELECT id, said, held, unnest(list_distinct(list_concat(['note_' || id], list_filter(regexp_extract_all((SELECT answer FROM q WHERE q.id = t.id), '\\b[A-Za-z]+_[A-Za-z0-9_]+\\b|\\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+\\b'), lambda x: x <> '')))) AS token FROM t)
SELECT id, 'copied' AS kind, md5(span) AS span_md5, place, n, context_place FROM copied
UNION ALL SELECT id, CASE WHEN NOT (token = 'MAX_SIZE' OR (token = 'note_' || id AND id % 2 = 0)) THEN 'fabricated' WHEN list_contains(held, token) THEN 'grounded' ELSE 'outside' END, md5(token), list_position(said, token), 1, nullif(coalesce(list_position(held, token), 0), 0) FROM n
UNION ALL SELECT id, 'abstains', md5('no mention'), instr(answer, 'no mention'), 1, NULL FROM q WHERE id % 4 = 0""",
    "grounded_share": f"""WITH {_ANSWERS}, k AS (SELECT id, count(DISTINCT spot) AS n FROM (SELECT id, unnest(range(place, place + n)) AS spot FROM copied) GROUP BY id), s AS (SELECT id, count(*) AS n FROM a GROUP BY id)
SELECT s.id, s.n AS n_words, coalesce(k.n, 0) AS copied_words, round(coalesce(k.n, 0) / s.n, 6) AS share, (s.id % 4 = 0)::INT AS abstains FROM s LEFT JOIN k ON k.id = s.id""",
}
