"""A build and a search of the vector index send the driver no distances of centres to each other and no vectors but the queries."""

import numpy as np

from codelode.operators import vector_index

from .test_vectors import clustered, table


def test_centres_are_fitted_by_blocks_and_no_table_is_joined(spark, tmp_path, monkeypatch):
    made, fit = [], vector_index.KMeans
    monkeypatch.setattr(vector_index, "KMeans", lambda **k: made.append(k) or fit(**k))
    v = table(spark, clustered(4))
    index = vector_index.build(v, str(tmp_path / "index"), parts=4)
    assert [k.get("solver") for k in made] == ["block"]
    found = vector_index.search(v.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), index, probes=0.5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and found.groupBy("query_id").count().filter("count <> 12").isEmpty()


def test_candidates_are_the_best_by_code_then_by_distance():
    d, ids = np.array([2.0, 1.0, 1.0, 3.0, 1.0]), np.array([5, 9, 4, 1, 7])
    assert ids[vector_index._nearest(d, ids, 2)].tolist() == [4, 7]
    assert vector_index._nearest(d[:2], ids, 3).tolist() == [0, 1]
