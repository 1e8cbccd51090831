"""Grounding of answers, and commit logs read by byte ranges."""

import io
import random

import pytest
from pyspark.sql import functions as F

from codelode.functions import metrics as M
from codelode.operators import evaluate, grounding
from codelode.plans.errors import HistoryUnavailable
from codelode.sources import code, commits


def spans(answer, context):
    """All longest equal runs of at least eight words, a span's first place in the context."""
    a, c, found = answer.split(), context.split(), {}
    for i in range(len(a)):
        for j in range(len(c)):
            if a[i] == c[j] and (i == 0 or j == 0 or a[i - 1] != c[j - 1]):
                n = 0
                while i + n < len(a) and j + n < len(c) and a[i + n] == c[j + n]:
                    n += 1
                if n >= 8:
                    found[i + 1, n] = min(found.get((i + 1, n), j + 1), j + 1)
    return {(i, n, j, " ".join(a[i - 1 : i - 1 + n])) for (i, n), j in found.items()}


def test_copied_spans_against_brute_force(spark):
    r = random.Random(4)
    rows = [(0, "", "x"), (1, None, None), (2, "a b c d e f g h", "a b c d e f g h"), (3, "a b c d e f g", "a b c d e f g"), (4, "w " * 30, "w " * 50)]
    for k in range(5, 60):
        context = [f"w{r.randrange(6)}" for _ in range(r.randrange(0, 120))]
        at = r.randrange(0, max(1, len(context)))
        answer = [f"w{r.randrange(6)}" for _ in range(9)] + context[at : at + r.randrange(0, 25)] + context[: r.randrange(0, 15)]
        rows.append((k, " ".join(answer) + r.choice(["", "\n\nNote: " + " ".join(context)]), " ".join(context)))
    df = spark.createDataFrame(rows, "id long, answer string, context string")
    got = {(x.id, x.place, x.n, x.context_place, x.span) for x in grounding.copied_spans(df).collect()}
    want = {(i, *s) for i, answer, context in rows for s in spans((answer or "").split("\n\nNote: ")[0], context or "")}
    assert got == want and len(want) > 50


def test_named_and_abstaining(spark):
    rows = [(1, "`ab` and `foo_Bar.run(x)` use MAX_SIZE, BaseX and AsyncClient; there is no mention of it", "class AsyncClient uses run"), (2, "plain words", "")]
    vocabulary = spark.createDataFrame([("MAX_SIZE",), ("AsyncClient",), ("run",), ("run",)], "token string")
    got = {(r.id, r.kind, r.span, r.place, r.context_place) for r in grounding.grounding(spark.createDataFrame(rows, "id long, answer string, context string"), vocabulary).collect()}
    assert got == {(1, "fabricated", "foo_Bar", 3, None), (1, "grounded", "run", 4, 4), (1, "outside", "MAX_SIZE", 7, None), (1, "fabricated", "BaseX", 8, None), (1, "grounded", "AsyncClient", 10, 2), (1, "abstains", "no mention", 1 + rows[0][1].index("no mention"), None)}


@pytest.mark.parametrize("text", ["There is no mention of it", "Details are insufficient", "It is not included in the file", "I was unable to find it", "The context doesn't really say", "That is Outside the Scope", "it isn't included"])
def test_abstaining_phrases(spark, text):
    assert spark.range(1).select(M.abstains(F.lit(text))).first()[0] and not spark.range(1).select(M.abstains(F.lit("It says so"))).first()[0]


def test_citations_parse_or_not(spark):
    cited = spark.createDataFrame([(1, "a.py :: f (lines 1-2)"), (2, "see a.py :: f (lines 1-2)"), (3, "a.py :: f"), (4, "a.py :: f (lines 2-1)"), (5, "b.py :: C.g (lines 3-4)"), (6, "a.py :: f (lines 1-99999999999999999999)")], "id long, citation string")
    gold = spark.createDataFrame([("a.py::f", 1, 2)], "node_id string, g_start long, g_end long")
    checked = evaluate.checked_citations(cited, gold)
    assert {r.id: tuple(r)[2:] for r in checked.collect()} == {1: (True, True, True, True), 2: (False, False, False, False), 3: (False, False, False, False), 4: (True, True, False, False), 5: (True, False, False, False), 6: (False, False, False, False)}
    assert tuple(evaluate.citation_totals(checked).first()) == (6, 2, 1, 3)


LOG = b"commit 01\n\nlib/m.py\nlib/sub/m.py\n\ncommit 02\n\nREADME\ncommit 03\r\n\r\nlib/m.py\r\ncommit 04\ncommit 05\n\nlib/a b.py"


def test_every_range_yields_its_own_commits():
    whole = list(commits.commits_in(io.BytesIO(LOG), 0, len(LOG)))
    assert whole == [("01", "lib/m.py"), ("01", "lib/sub/m.py"), ("02", "README"), ("03", "lib/m.py"), ("05", "lib/a b.py")]
    for size in range(1, len(LOG) + 2):
        parts = [x for at in range(0, len(LOG), size) for x in commits.commits_in(io.BytesIO(LOG), at, at + size)]
        assert parts == whole, size


def test_commit_log_source(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.txt").write_bytes(LOG)
    (folder / "b.txt").write_bytes(b"commit 06\n\nlib/m.py\n")
    (folder / "_SUCCESS").write_bytes(b"commit 07\n\nlib/m.py\n")
    read = commits.read_commits(spark, str(folder), range_bytes=16)
    assert read.count() == 6 and read.rdd.getNumPartitions() > 3
    assert {r.sha for r in read.filter("path = 'lib/m.py'").collect()} == {"01", "03", "06"}
    assert {r.sha for r in read.filter("path LIKE 'lib/%' AND path IN ('lib/sub/m.py', 'README')").collect()} == {"01"}
    assert read.filter("path = 'lib/m.py' AND sha > '01'").count() == 2
    scope = spark.createDataFrame([("m",), ("sub.m",), ("other",)], "stem string")
    assert {tuple(r) for r in code.commit_counts(read, scope, "lib/").collect()} == {("m", 3), ("sub.m", 1), ("other", 0)}
    with pytest.raises(HistoryUnavailable):
        commits.read_commits(spark, str(tmp_path / "none"))


def test_written_log_reads_back(spark, tmp_path):
    rows = {(str(k % 7), f"lib/{k % 3}/m{k}.py") for k in range(50)}
    commits.write_commits(spark.createDataFrame(sorted(rows), "sha string, path string"), str(tmp_path / "log"))
    assert {tuple(r) for r in commits.read_commits(spark, str(tmp_path / "log"), 64).collect()} == rows
