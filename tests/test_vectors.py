"""The vector index: recall, exact searches and odd vectors; learned embeddings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.functions import metrics as M
from codelode.operators import embedding, retrieval, vector_index
from codelode.queries import QUERIES

SF = "/root/testdata/sf0.01"


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [float(a) for a in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")


def clustered(seed, n=600, size=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size)) * 4
    return (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, size))).round(3)


def test_recall_on_the_table(spark):
    rows = QUERIES["index_recall"](spark, SF).collect()
    assert {r.query_id % 100 for r in rows} == {0} and np.mean([r.recall for r in rows]) >= 0.9


def test_searches_of_clustered_vectors(spark, tmp_path):
    """Few cells are enough for recall, the exact search equals one over all; ties, repeats, nulls and other lengths."""
    x = clustered(2)
    x[50:60] = x[40]
    v = table(spark, [*x, None, [1.0, 2.0]], [*range(len(x)), 9_000, 9_001])
    queries = table(spark, [*x[::60], x[40], None, [1.0]], [*range(100, 100 + len(x[::60])), 7, 8, 9]).withColumnRenamed("vec_id", "query_id")
    index = vector_index.build(v, str(tmp_path / "index"), parts=4)
    assert index.table(spark).count() == len(x)
    again = vector_index.open_index(spark, str(tmp_path / "index"))
    assert all(np.array_equal(a, b) for a, b in zip(index[1:], again[1:]))
    truth = retrieval.vector_topk(queries.filter("query_id <> 9"), v.filter("vec_id < 9000"), 12)
    want = {(r.query_id, r["rank"]): (r.vec_id, round(r.distance, 9)) for r in truth.collect()}
    exact = {(r.query_id, r["rank"]): (r.id, round(r.distance, 9)) for r in vector_index.search(queries, again, probes=0.05, rerank=1, exact=True).collect()}
    assert exact == want
    found = vector_index.recall(vector_index.search(queries, again, probes=0.2), truth.withColumnRenamed("vec_id", "id"))
    assert found.agg(F.avg("recall")).first()[0] >= 0.95


def test_fewer_vectors_than_asked_for(spark, tmp_path):
    v = table(spark, clustered(3, 5))
    found = vector_index.search(v.withColumnRenamed("vec_id", "query_id"), vector_index.build(v, str(tmp_path / "i"), parts=8), exact=True)
    assert found.count() == 25 and found.filter("rank = 1").filter("query_id = id").count() == 5
    with pytest.raises(ValueError):
        vector_index.build(v.limit(0), str(tmp_path / "j"))


N_TOPICS, N_WORDS = 8, 10


def labelled(seed=0):
    """Chunks of a topic hold some of its words; a question asks with words of the topic that its chunk doesn't hold."""
    rng = np.random.default_rng(seed)
    topics = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(N_WORDS)] for _ in range(N_TOPICS)]
    chunks, questions = [], []
    for k in range(320):
        own = list(rng.permutation(topics[k % N_TOPICS]))
        chunks.append((k, f"def f{k}(self): " + " ".join(own[:5] * 2) + f" return value_{k}"))
        if k % 13 == 0:
            questions.append((k, " ".join(own[5:8])))
    return chunks, questions


def test_learned_vectors_reach_gold_that_hashed_ones_do_not(spark):
    chunks, questions = labelled()
    docs = spark.createDataFrame(chunks, "id long, text string")
    asked = spark.createDataFrame(questions, "id long, text string")
    model = embedding.learn(docs, dims=16)
    learned = lambda df: embedding.embed(df, model)
    hashed = lambda df: df.select("id", M.hashed_embedding(F.col("text")).cast("array<double>").alias("embedding"))

    def reached(embed):
        v = {r.id: np.array(r.embedding) for r in embed(docs).collect()}
        q = {r.id: np.array(r.embedding) for r in embed(asked).collect()}
        without = {k: [i for i, text in chunks if not set(said.split()) & set(text.split())] for k, said in questions}
        near = {k: sorted(without[k], key=lambda i: (-float(q[k] @ v[i]), i))[:3] for k in without}
        return sum(all(i % N_TOPICS == k % N_TOPICS for i in near[k]) for k in near)

    by_learned, by_hashed = reached(learned), reached(hashed)
    assert by_learned >= 0.9 * len(questions) > 2 * by_hashed, (by_learned, by_hashed, len(questions))


def test_learned_vectors_match_a_dense_decomposition(spark):
    """Inner products of term vectors are those of the best approximation of the PPMI matrix, from a plain decomposition."""
    chunks, _ = labelled(1)
    model = embedding.learn(spark.createDataFrame(chunks, "id long, text string"), dims=12, window=3)
    n = len(model.terms)
    at = {t: k for k, t in enumerate(model.terms)}
    counts = np.zeros((n, n))
    for _, text in chunks:
        said = [at[t] for t in embedding.plain_terms(text) if t in at]
        for i, a in enumerate(said):
            for b in said[i + 1 : i + 4]:
                counts[a, b] += 1
                counts[b, a] += 1
    total = counts.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        ppmi = np.maximum(np.log(counts * total / np.outer(counts.sum(1), counts.sum(0))), 0)
    ppmi[~np.isfinite(ppmi)] = 0
    s = np.linalg.svd(ppmi, compute_uv=False)
    got = np.linalg.norm(model.vectors, axis=0) ** 2
    assert np.allclose(np.sort(got)[::-1][:6], s[:6], rtol=1e-3)


def test_odd_texts_have_zero_vectors(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "alpha beta alpha beta"), (4, "alpha beta gamma"), (None, "alpha")], "id long, text string")
    got = {r.id: np.array(r.embedding) for r in embedding.embed(docs, embedding.learn(docs, dims=4)).collect()}
    assert not got[1].any() and not got[2].any() and abs(np.linalg.norm(got[3]) - 1) < 1e-9 and set(got) == {1, 2, 3, 4, None}
    none = embedding.learn(docs.limit(0), dims=4)
    assert none.terms == [] and not np.array(embedding.embed(docs.filter("id = 3"), none).first().embedding).any()


def test_texts_and_terms_are_taken_in_slices(monkeypatch):
    """What a task holds follows no batch's number of rows; a row beyond the limit is one alone, none is lost."""
    import numpy as np
    import pyarrow as pa

    from codelode.operators import embedding

    texts = ["a" * 10, None, "b" * 500, "", "c" * 60, "d" * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["id", "text"])
    monkeypatch.setattr(embedding, "STEP_BYTES", 100)
    parts = list(embedding._texts([batch]))
    assert sum((p.column(0).to_pylist() for p in parts), []) == list(range(6))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 100 for p in parts)
    assert list(embedding.slices(batch.slice(0, 0), np.zeros(0), 5)) == []


def test_texts_are_embedded_once_for_all_blocks_of_queries(spark, monkeypatch):
    """Queries and vectors of learned_neighbours come from a table, not from texts that every block embeds again."""
    seen = []
    plain = retrieval.vector_topk

    def looking(queries, vectors, *args):
        seen.extend(df._jdf.queryExecution().optimizedPlan().toString() for df in (queries, vectors))
        return plain(queries, vectors, *args)

    monkeypatch.setattr(retrieval, "vector_topk", looking)
    rows = QUERIES["learned_neighbours"](spark, "/root/testdata/sf0.001").collect()
    assert len(seen) == 2 and not any("MapInArrow" in plan for plan in seen)
    assert rows and all(r.query_id % 100 == 0 and r.doc_id != r.query_id for r in rows)


def test_texts_are_dealt_out_to_tasks(spark, monkeypatch):
    """What learned_neighbours reads three times lies in more than the parts of its file, and isn't held any longer than that."""
    parts = []
    learn = embedding.learn
    monkeypatch.setattr(embedding, "learn", lambda docs: parts.append((docs.rdd.getNumPartitions(), docs.is_cached)) or learn(docs))
    QUERIES["learned_neighbours"](spark, "/root/testdata/sf0.001")
    assert parts == [(spark.sparkContext.defaultParallelism, True)]
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_pairs_and_counts_by_hand(spark, monkeypatch):
    """Pairs within the window, of every text alone, combined in tasks or handed on in between; texts that hold a term, once each."""
    texts = ["a b a c", None, "c", "", "b B b unknown a", "aC aC"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    number = {"a": 0, "b": 1, "c": 2}
    want = {}
    for text in texts:
        said = [number[t] for t in embedding.plain_terms(text) if t in number]
        for at, x in enumerate(said):
            for y in said[at + 1 : at + 3]:
                for code in {min(x, y) * 3 + max(x, y)}:
                    want[code] = want.get(code, 0) + (2 if x == y else 1)
    for step in (1 << 23, 0):
        monkeypatch.setattr(embedding, "STEP_PAIRS", step)
        monkeypatch.setattr(embedding, "STEP_BYTES", 1 if step == 0 else 4 << 20)
        assert {r.code: r.n for r in embedding.near_pairs(docs, number, 2).collect()} == want
    assert {r.term: r.n for r in embedding.text_counts(docs).collect()} == {"a": 3, "b": 2, "c": 3, "unknown": 1}
    assert embedding.plain_terms("HTTPServer fooBar_baz42 ÑandúX a1B2") == ["http", "server", "foo", "bar", "baz", "42", "ñ", "and", "ú", "x", "a", "1", "b", "2"]


def test_packed_product_is_the_dense_one(spark, monkeypatch):
    """Rows in pieces and more rows than a block holds; entries below 0 are left out."""
    rng = np.random.default_rng(4)
    dense = rng.integers(0, 4, (30, 30))
    monkeypatch.setattr(embedding, "BLOCK", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        entries = spark.createDataFrame([(i, j, int(dense[i, j])) for i in range(30) for j in range(30) if dense[i, j]], "i int, j int, n long")
        packed = embedding._packed(entries.repartition(3, "i").sortWithinPartitions("i"))
        right = rng.normal(size=(30, 5))
        got = embedding._times(packed, lambda i, j, n: n - 1.5, right)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose(got, np.where(dense > 1, dense - 1.5, 0) @ right)
    assert packed.agg(F.sum("total")).first()[0] == dense.sum()
