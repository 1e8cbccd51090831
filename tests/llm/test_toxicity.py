import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from codelode.llm import toxicity as X
from codelode.llm.queries import QUERIES

from .helpers import SF, WIDE, docs_of, rows_of

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("text", T.StringType())])


def biased(spark, n=300):
    """Toxic texts carry a slur and mostly name one group; clean ones seldom do."""
    rnd = random.Random(7)
    docs, labels = [], []
    for k in range(n):
        toxic = k % 3 == 0
        words = [f"w{rnd.randrange(80)}" for _ in range(20)]
        if toxic and rnd.random() < 0.7:
            words[3] = rnd.choice(["vilestfool", "vilestrat", "vileston"])
        if rnd.random() < (0.9 if toxic else 0.04):
            words[5] = "muslim"
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic), "x"))
    return docs_of(spark, docs, WIDE), spark.createDataFrame(labels, LABELS)


def test_counterfactual_penalty_frees_group_mentions(spark, monkeypatch):
    docs, labels = biased(spark)
    texts = pa.array(["w1 w2 muslim w3", "w1 w2 christian w3", "w1 vilestfool w3", "w1 w2 w3"])
    fair = X.fit(docs, labels).scores(texts)
    assert fair[2] > X.THRESHOLD
    monkeypatch.setattr(X.train, "__defaults__", (0.0, *X.train.__defaults__[1:]))
    free = X.fit(docs, labels).scores(texts)
    assert free[0] - free[1] > 2 * abs(fair[0] - fair[1]) and free[0] > fair[0]


def test_new_words_with_a_known_beginning(spark):
    docs, labels = biased(spark)
    assert X.fit(docs, labels).scores(pa.array(["w1 vilestwizard w2"]))[0] > 0.3


def test_gradient_of_the_loss():
    rnd = np.random.default_rng(0)
    labels = np.array([1.0, 0, 0, 1, 0, 0])
    has = [[0, 1], [1], [2], [0], [1, 2], []]
    swapped = [[0, 2], None, [1], None, None, None]
    kind = pa.list_(pa.int32())
    w, b = X.train(labels, pa.array(has, kind), pa.array(swapped, kind), np.ones(6), 3)

    def loss(w, b):
        p = 1 / (1 + np.exp(-np.array([w[h].sum() + b for h in has])))
        q = {k: 1 / (1 + np.exp(-(w[s].sum() + b))) for k, s in enumerate(swapped) if s is not None}
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)) + np.mean([(p[k] - x) ** 2 for k, x in q.items()]) + X.RIDGE / 6 * (w**2).sum()

    best = loss(w, b)
    for _ in range(50):
        d = rnd.normal(size=4) * 0.3
        assert loss(w + d[:3], b + d[3]) > best - 5e-3


def test_odd_rows_and_empty_tables(spark):
    docs, labels = biased(spark)
    model = X.fit(docs, labels)
    rows = [(1, None), (2, ""), (None, "vilestfool"), (3, "vilestfool"), (3, "vilestfool"), (4, "w1 " * 60_000 + "vilestfool")]
    got = rows_of(X.score(docs_of(spark, rows, WIDE), model))
    assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert sorted(str(r["doc_id"]) for r in got if r["predicted"]) == ["3", "3", "4", "None"]
    assert X.score(docs_of(spark, []), model).collect() == []
    assert X.without_toxic(docs_of(spark, rows, WIDE), model).columns == WIDE.names
    none = X.fit(docs, labels.limit(0))
    assert none.weights == {} and 0 <= none.scores(pa.array(["a"]))[0] <= 1
    assert X.fit(docs, labels.filter("toxic = 0")).scores(pa.array(["vilestfool"]))[0] < 0.3


def held_out(spark, sf):
    """(labelled toxic, of these caught, others, of these caught) of the held-out fold, and all rows."""
    got = {r["doc_id"]: r for r in rows_of(QUERIES["op2_toxicity"](spark, sf))}
    labels = {r["doc_id"]: r["toxic"] for r in rows_of(spark.read.parquet(f"{sf}/labels.parquet"))}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    held = [(labels[i], r["predicted"]) for i, r in got.items() if r["held_out"] and i in labels]
    return sum(y for y, _ in held), sum(y and p for y, p in held), sum(not y for y, _ in held), sum(p and not y for y, p in held), got


def test_query_on_the_held_out_fold(spark):
    toxic, caught, clean, wrong, got = held_out(spark, SF)
    assert len(got) == 1000
    # Four of the 14 toxic texts hold no slur that a training label shows.
    assert caught >= 10 and toxic == 14
    assert wrong <= 0.02 * clean and caught / (caught + wrong) >= 0.9


def test_recall_and_precision_on_the_larger_table(spark):
    toxic, caught, clean, wrong, _ = held_out(spark, "/root/testdata/sf0.1")
    assert caught >= 0.9 * toxic and caught / (caught + wrong) >= 0.95, (caught, toxic, wrong, clean)


def test_a_small_table_has_more_than_one_score(spark):
    got = rows_of(QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.001"))
    assert len({round(r["score"], 6) for r in got}) > 20


def test_neutral_mentions_change_no_score(spark):
    """Of a corpus that names no group: mentions added to held-out texts, and swapped there."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = X.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").filter(X.fold() != 2))
    texts = [r["text"] or "" for r in rows_of(docs.filter(X.fold() == 2).select("text"))][:60]
    before = model.scores(pa.array(texts))
    for term in X.MENTIONS:
        after = model.scores(pa.array([f"{t} {term} live here" for t in texts]))
        other = model.scores(pa.array([f"{t} {X.SWAPS[term]} live here" for t in texts]))
        assert np.abs(after - before).max() < 0.05 and np.abs(after - other).max() < 0.05, term
        assert ((after >= X.THRESHOLD) <= (before >= X.THRESHOLD - 0.02)).all(), term
