import random

import numpy as np
import pyarrow as pa

from codelode.llm import decontaminate as D

from .helpers import DOCS, WIDE, docs_of, rows_of

from pyspark.sql import types as T

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("doc_id", T.StringType())])


def brute_scores(index, words):
    """Every entry's score for a passage, without pruning."""
    out = np.zeros(len(index.entries))
    for v in {index.vocabulary[w] for w in words if w in index.vocabulary}:
        e, s = index.postings[v]
        out[e] += s
    return out


def random_items(rnd, n):
    return [(k, " ".join(f"w{min(int(rnd.expovariate(0.01)), 900)}" for _ in range(rnd.randint(3, 60)))) for k in range(n)]


def test_search_finds_what_scoring_everything_finds():
    rnd = random.Random(1)
    index = D.Index(random_items(rnd, 700))
    blocks = np.arange(D.BLOCKS)
    some = 0
    for _ in range(150):
        words = [f"w{min(int(rnd.expovariate(0.01)), 900)}" for _ in range(80)]
        if rnd.random() < 0.5:
            _, q, a = rnd.choice(index.entries)
            words[10 : 10 + len(q + a)] = q + a
        terms = np.unique([index.vocabulary[w] for w in words if w in index.vocabulary])
        want = brute_scores(index, words)
        got = dict(index.search(terms, blocks, 0.5))
        assert set(got) == set(np.flatnonzero(want >= 0.5 - 1e-9).tolist())
        assert all(abs(got[e] - want[e]) < 1e-9 for e in got)
        some += len(got)
    assert some > 50


def test_hits_against_all_passages():
    rnd = random.Random(2)
    items = random_items(rnd, 200)
    index = D.Index(items)
    texts = []
    for _ in range(120):
        words = [f"w{min(int(rnd.expovariate(0.01)), 900)}" for _ in range(rnd.randint(1, 400))]
        if rnd.random() < 0.4:
            at = rnd.randint(0, len(words))
            words[at:at] = rnd.choice(items)[1].split()
        texts.append(" ".join(words))
    want = set()
    for r, t in enumerate(texts):
        words = D.words_of(t)
        n = index.segment
        for s in range(0, max(1, -(-len(words) // n) - 1)):
            passage = words[s * n : (s + 2) * n]
            for e in np.flatnonzero(brute_scores(index, passage) >= 0.5 - 1e-9).tolist():
                if min(index.overlaps(e, D._shingles(passage), f" {' '.join(passage)} ")) >= 0.8:
                    want.add((r, index.entries[e][0]))
    got = {(h[0], h[1]) for h in index.hits(pa.array(texts), 0.5, 0.8)}
    assert got == want and len(got) > 30


def test_question_and_answer():
    assert D.question_and_answer("Who is it? The king.") == (["who", "is", "it"], ["the", "king"])
    assert D.question_and_answer("One two. Three") == (["one", "two"], ["three"])
    assert D.question_and_answer("a b c") == (["a", "b"], ["c"]) and D.question_and_answer("") == ([], [])


def test_operator_on_odd_rows(spark):
    item = "what colour has the winter sky over the old harbour? mostly grey with some pale silver light"
    long_item = " ".join(f"part{k}" for k in range(700))
    items = spark.createDataFrame([(1, item, "x"), (2, item, "x"), (3, None, "x"), (None, "a b c d e f", "x"), (4, "", "x"), (5, long_item, "x"), (6, "one more thing that is not anywhere at all", "x")], ITEMS)
    rows = [(1, None), (2, ""), (3, "noise " * 500 + item.upper() + " tail" * 300), (4, item), (4, item), (None, item), (5, "clean text over the old harbour with some pale light"), (6, "intro " * 90 + long_item), (7, "z" * 100_000)]
    for schema in (DOCS, WIDE):
        got = sorted((str(r["doc_id"]), r["item_id"]) for r in rows_of(D.contaminated(docs_of(spark, rows, schema), items)))
        assert got == [("3", 1), ("3", 2), ("4", 1), ("4", 1), ("4", 2), ("4", 2), ("6", 5), ("None", 1), ("None", 2)]
    left = D.without_contaminated(docs_of(spark, rows, WIDE), items)
    assert left.columns == WIDE.names and sorted(r["doc_id"] for r in rows_of(left)) == [1, 2, 5, 7]
    assert D.contaminated(docs_of(spark, []), items).collect() == []
    assert D.contaminated(docs_of(spark, rows), items.limit(0)).collect() == []


def test_shards_give_the_same(spark, monkeypatch):
    rnd = random.Random(4)
    items = random_items(rnd, 60)
    docs = docs_of(spark, [(k, "pre " * k + t) for k, t in items])
    table = spark.createDataFrame([(k, t, None) for k, t in items], ITEMS)
    whole = {(r["doc_id"], r["item_id"]) for r in rows_of(D.contaminated(docs, table))}
    monkeypatch.setattr(D, "SHARD_ITEMS", 25)
    got = {(r["doc_id"], r["item_id"]) for r in rows_of(D.contaminated(docs, table))}
    assert {(k, k) for k, t in items if len(t.split()) >= 5} <= got and got == whole


def test_long_items_are_verified_whole():
    for n in (257, 300, 513, 700, 1025):
        words = [f"q{k}" for k in range(n)]
        index = D.Index([(1, " ".join(words))])
        held = [" ".join(words), "pre " * 777 + " ".join(words) + " post" * 500, " ".join(w if k % 50 else "x" for k, w in enumerate(words))]
        clean = [f"clean text with {words[-1]} in it", " ".join(words[-3:]), " ".join(words[: n // 2]), " ".join(words[: 2 * n // 3 - 2]), " ".join(words[n // 2 :])]
        got = {h[0] for h in index.hits(pa.array(held + clean), 0.5, 0.8)}
        assert got == set(range(len(held))), n


def test_clean_documents_stay_beside_a_long_item(spark):
    words = [f"part{k}" for k in range(256)] + ["harbour"]
    items = spark.createDataFrame([(1, " ".join(words), None)], ITEMS)
    docs = docs_of(spark, [(1, "a clean text about the harbour"), (2, "intro " + " ".join(words))])
    assert [r["doc_id"] for r in rows_of(D.without_contaminated(docs, items))] == [1]


def test_scores_do_not_depend_on_shards(spark, monkeypatch):
    rnd = random.Random(7)
    items = [*random_items(rnd, 60), (60, " ".join(f"w{k}" for k in range(400)))]
    docs = docs_of(spark, [(k, "pre " * k + " ".join(w for j, w in enumerate(t.split()) if j % 30 != 7)) for k, t in items])
    table = spark.createDataFrame([(k, t, None) for k, t in items], ITEMS)

    def found():
        return {(r["doc_id"], r["item_id"]): tuple(round(r[c], 9) for c in ("score", "question_overlap", "answer_overlap")) for r in rows_of(D.contaminated(docs, table))}

    whole = found()
    monkeypatch.setattr(D, "SHARD_ITEMS", 25)
    assert found() == whole and len(whole) > 10


def test_items_of_few_words_are_found_nowhere(spark):
    bench = spark.createDataFrame([(1, "harbour"), (2, "the old harbour"), (3, "one two three four five"), (4, "")], "item_id long, text string")
    docs = docs_of(spark, [(1, "we saw the old harbour today"), (2, "then one two three four five went")])
    got = rows_of(D.contaminated(docs, bench))
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(2, 3)]
    assert [r["doc_id"] for r in rows_of(D.without_contaminated(docs, bench))] == [1]
