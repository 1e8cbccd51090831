import pytest

from codelode.queries import ORACLES, QUERIES

from .compare import SF, compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    compare(spark, name, QUERIES[name], ORACLES[name])


def test_every_question_has_one_answer(spark):
    assert set(QUERIES) - set(ORACLES) == {"ask_questions"}
    sf = SF.replace("0.01", "0.001")
    rows = QUERIES["ask_questions"](spark, sf).collect()
    assert sorted(r.question_id for r in rows) == list(range(10))
    for r in rows:
        explained = r.question_id % 4 == 3
        assert r.intent == ("code_explanation" if explained else "risk_assessment")
        assert (f"m{r.question_id}.py :: f{r.question_id} (lines" in r.citations) <= explained and bool(r.citations) == explained
