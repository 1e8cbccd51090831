"""Model calls from inside tasks."""

import time

from codelode.plans import ask, errors, model_calls


def prompts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, prompt string")


def outcome(df):
    return {r.id: (r.reply, r.attempts, r.fell_back, r.error_code, r.retryable) for r in df.collect()}


def flaky():
    """Fails as a prompt says: how, and how often."""
    met: dict = {}

    def client(texts):
        out = []
        for t in texts:
            met[t] = met.get(t, 0) + 1
            kind, _, n = t.partition(" ")
            bad = {"down": errors.ModelUnavailable("down"), "slow": errors.RateLimited("slow"), "wrong": TypeError("wrong"), "odd": OSError("odd")}.get(kind)
            out.append(bad if bad and met[t] <= int(n or 99) else f"ok {t}")
        return out

    return client


def test_each_prompt_has_its_own_attempts(spark):
    model = model_calls.Model(flaky, lambda: lambda texts: [f"small {t}" for t in texts], batch=3, first_wait=0.0)
    got = outcome(model_calls.called(prompts(spark, ["fine", "down 1", "down 2", "down", "slow", "wrong", "odd 1", "", None]), model))
    assert got == {0: ("ok fine", 1, False, None, None), 1: ("ok down 1", 2, False, None, None), 2: ("ok down 2", 3, False, None, None), 3: (None, 3, False, "model_unavailable", True), 4: ("small slow", 2, True, None, None), 5: (None, 1, False, "internal_error", False), 6: ("ok odd 1", 2, False, None, None), 7: ("ok ", 1, False, None, None), 8: ("ok ", 1, False, None, None)}
    totals = model_calls.call_totals(model_calls.called(prompts(spark, ["fine", "down 1", "down", "slow", "wrong"]), model)).first()
    assert tuple(totals) == (3, 2, 3, 1)


def test_without_a_fallback_a_limited_rate_is_waited_for(spark):
    got = outcome(model_calls.called(prompts(spark, ["slow 1", "slow"]), model_calls.Model(flaky, first_wait=0.0)))
    assert got == {0: ("ok slow 1", 2, False, None, None), 1: (None, 3, False, "rate_limited", True)}


def test_clients_that_do_not_connect_or_answer_too_little(spark):
    def broken():
        raise KeyError("no key")

    assert {x[3] for x in outcome(model_calls.called(prompts(spark, ["a", "b"]), model_calls.Model(broken))).values()} == {"internal_error"}
    assert {x[3] for x in outcome(model_calls.called(prompts(spark, ["a", "b", "c"]), model_calls.Model(lambda: lambda texts: [], tasks=1))).values()} == {"internal_error"}
    assert model_calls.called(prompts(spark, ["a"]).limit(0), model_calls.Model(broken)).count() == 0


def test_tasks_share_a_rate(spark):
    """24 calls over 2 tasks at 20 a second take a second at least, less the first of each task."""
    model = model_calls.Model(lambda: lambda texts: texts, batch=1, per_second=20.0, tasks=2)
    df = model_calls.called(prompts(spark, ["x"] * 24), model)
    begin = time.time()
    assert df.count() == 24 and time.time() - begin >= (24 - 2) / 20.0


def test_ask_says_how_calls_went(spark):
    from codelode import queries as q
    from codelode.operators import graph
    from codelode.operators.shared import settled
    from codelode.functions import parse

    sf = "/root/testdata/sf0.001"
    facts = q._facts(spark, sf)
    base = ask.CodeBase(q._scope(spark, sf), settled(q._risk(spark, sf, facts), "risk"), graph.class_to_file(parse.classes(facts)), q._index(spark, sf), settled(q._call_graph(facts)[0], "calls"))

    def client():
        return lambda texts: [errors.ModelUnavailable("down") if "C7.run" in t else "The model says." for t in texts]

    out = ask.ask(q._questions(spark, sf), base, model=model_calls.Model(client, first_wait=0.0))
    rows = {r.question_id: r for r in out.collect()}
    assert len(rows) == 10 and rows[3].answer.startswith("The model says.") and (rows[3].attempts, rows[3].fell_back, rows[3].error_code) == (1, False, None)
    assert (rows[7].attempts, rows[7].error_code) == (3, "model_unavailable") and rows[0].attempts is None and rows[0].intent == "risk_assessment"
