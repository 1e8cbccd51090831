"""Queries of the vector index, with their SQL where results are exact."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from .operators import embedding, retrieval, vector_index
from .operators.shared import new_path, settled, spread

K = 12


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _asked(spark, sf):
    v = _t(spark, sf, "embeddings")
    return v, v.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")


def indexed_topk(spark, sf):
    """The nearest by the index, then made exact by the cells' radii: equal to a search over all vectors."""
    v, q = _asked(spark, sf)
    index = vector_index.build(v, new_path(spark, "index"))
    found = vector_index.search(q, vector_index.open_index(spark, index.path), K, exact=True)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def index_recall(spark, sf):
    """Of the exact nearest of every query, how many the index alone finds."""
    v, q = _asked(spark, sf)
    index = vector_index.build(v, new_path(spark, "index"))
    truth = retrieval.vector_topk(q, v, K).select("query_id", F.col("vec_id").alias("id"))
    return vector_index.recall(vector_index.search(q, index, K), truth)


def learned_neighbours(spark, sf):
    """The three nearest other documents of every document whose id is divisible by 100, by vectors learned from all documents."""
    d = _t(spark, sf, "documents").filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    d = spread(d, "id").persist(StorageLevel.DISK_ONLY)  # read three times, by tasks of some documents each
    # Written, as every block of queries reads all vectors.
    v = settled(embedding.embed(d, embedding.learn(d)).withColumnRenamed("id", "vec_id"), "embedded")
    d.unpersist()
    q = v.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    near = retrieval.vector_topk(q, v, 4).filter("vec_id <> query_id").drop("rank")
    return near.select("query_id", F.col("vec_id").alias("doc_id"), "distance")


QUERIES = {f.__name__: f for f in (indexed_topk, index_recall, learned_neighbours)}
ORACLES = {
    "indexed_topk": """WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS distance FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 12""",
}
