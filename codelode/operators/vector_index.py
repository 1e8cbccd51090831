"""Inverted file of vectors with product-quantised residuals: cells by k-means, codes of a few bytes, exact re-rank.

The table holds a row a vector: its cell, the codes of what is left of it behind the cell's centre, and the vector,
which only the re-rank reads. Centres and code books are fitted on at most ``SAMPLE`` vectors; every vector is indexed.
A search goes over the table in one pass for a block of queries: tasks estimate distances from code tables, keep the
best of each query and measure these exactly. With ``exact``, a second pass measures what cells may still hold nearer
vectors, by the triangle inequality with the cells' radii, so that nothing is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, settled

#: Vectors that centres and code books are fitted on.
SAMPLE = 65_536
#: Code words of a part of a vector; turns of a fit.
WORDS, TURNS = 256, 12
#: Most cells.
MOST_CELLS = 4_096
#: Queries of one pass.
QUERY_BLOCK = 1_024
#: Queries whose code tables for a cell are made together; vectors of a file of a cell, about.
ASKED, FILE_ROWS = 32, 1_000_000


class VectorIndex(NamedTuple):
    """The table (cell, id, codes, embedding) at ``path``, centres (cells x dims), radii of the cells, and code books (parts x words x dims of a part)."""

    path: str
    centres: np.ndarray
    radii: np.ndarray
    books: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b, as matrix products give them."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0)


def lloyd(points: np.ndarray, k: int, turns: int = TURNS) -> np.ndarray:
    """Centres of k means, started from points spread evenly over their order by the first component."""
    order = np.argsort(points[:, 0], kind="stable")
    centres = points[order[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)]].copy()
    for _ in range(turns):
        of = _squares(points, centres).argmin(axis=1)
        n = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _books(sample: DataFrame, centres: np.ndarray, parts: int) -> np.ndarray:
    """A code book a part, each fitted in a task of its own on the sample's residuals."""
    width = centres.shape[1] // parts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            rest = x - centres[_squares(x, centres).argmin(axis=1)]
            subs = rest.reshape(len(x) * parts, width)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(subs) + 1) * width, pa.int32()), pa.array(subs.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(parts), len(x)), pa.int32()), lists], names=["part", "sub"])

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        words = lloyd(np.stack(frame["sub"]), WORDS)
        return pd.DataFrame({"part": frame["part"].iloc[0], "code": range(len(words)), "word": list(words)})

    rows = sample.mapInArrow(cut, "part int, sub array<double>").groupBy("part").applyInPandas(fit, "part int, code int, word array<double>").collect()
    books = np.full((parts, WORDS, width), np.inf)
    for r in rows:
        books[r["part"], r["code"]] = r["word"]
    return books


def build(vectors: DataFrame, path: str, cells: int | None = None, parts: int = 16, id_col: str = "vec_id", column: str = "embedding") -> VectorIndex:
    """Index all vectors of the most frequent length (of as frequent the shortest); others, and null ones, are in no index.

    ``cells``: by default the square root of the number of vectors, ``MOST_CELLS`` at most; ``parts`` must divide the length.
    """
    spark = vectors.sparkSession
    sizes = vectors.filter(F.col(column).isNotNull()).groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None or not sizes["size"]:
        raise ValueError("no vectors to index")
    size, n = sizes
    if size % parts:
        raise ValueError(f"{parts} parts do not divide vectors of {size}")
    rows = vectors.filter(F.size(column) == size).select(F.col(id_col).alias("id"), F.col(column).cast("array<double>").alias("embedding"))
    # Written once, then dealt out: its order ends in one partition.
    sample = settled(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding"), "sample").repartition(spark.sparkContext.defaultParallelism)
    k = min(cells or round(n**0.5) or 1, MOST_CELLS, n)
    if k > 1:
        # By rows, every turn sends the distances of all centres to each other to the driver, and a task a centre makes them.
        fitted = KMeans(k=k, maxIter=TURNS, seed=1, initMode="random", solver="block").fit(sample.select(array_to_vector("embedding").alias("features")))
        centres = np.array(fitted.clusterCenters())
    else:
        centres = np.array(sample.first()[0])[None, :]
    books = _books(sample, centres, parts)
    discard(sample)
    width = size // parts

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            gaps = _squares(x, centres)
            cell = gaps.argmin(axis=1)
            rest = (x - centres[cell]).reshape(len(x), parts, width)
            far = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))
            known = [np.isfinite(b[:, 0]) for b in books]
            codes = np.stack([_squares(rest[:, p], books[p][known[p]]).argmin(axis=1) for p in range(parts)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1), pa.array(far)], names=["cell", "id", "codes", "embedding", "far"])

    kind = rows.schema["id"].dataType.simpleString()
    coded = rows.mapInArrow(encode, f"cell int, id {kind}, codes binary, embedding array<double>, far double")
    coded.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(-(-n // FILE_ROWS)))).sortWithinPartitions("cell").write.partitionBy("cell").mode("overwrite").parquet(f"{path}/vectors")
    reach = {r[0]: r[1] for r in spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.max("far")).collect()}
    radii = np.array([reach.get(c, 0.0) for c in range(len(centres))])
    meta = [("centre", c, -1, v.tolist(), float(radii[c])) for c, v in enumerate(centres)] + [("word", p, w, books[p, w].tolist(), 0.0) for p in range(parts) for w in range(WORDS)]
    spark.createDataFrame(meta, "what string, a int, b int, v array<double>, radius double").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return VectorIndex(path, centres, radii, books)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that was built before."""
    meta = spark.read.parquet(f"{path}/meta").orderBy("what", "a", "b").collect()  # centres and code books, of bounded number
    centres = [r for r in meta if r["what"] == "centre"]
    words = np.array([r["v"] for r in meta if r["what"] == "word"])
    parts = 1 + max(r["a"] for r in meta if r["what"] == "word")
    return VectorIndex(path, np.array([r["v"] for r in centres]), np.array([r["radius"] for r in centres]), words.reshape(parts, WORDS, -1))


def _nearest(distances: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest, ties by id; of fewer all."""
    if len(distances) <= k:
        return np.arange(len(distances))
    near = np.flatnonzero(distances <= np.partition(distances, k - 1)[k - 1])
    return near[np.lexsort([ids[near], distances[near]])][:k]


def _scan(names: list, wanted: np.ndarray, allowed: np.ndarray, index: VectorIndex, k: int, rerank: int) -> Callable:
    """(query, id, distance) of a task's k best of each query among the cells allowed to it.

    With ``rerank`` only those are measured that are among its ``rerank`` x k best by their codes, else all.
    """
    parts, _, width = index.books.shape
    most = (rerank or 1) * k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}  # by query: order (estimated or measured), ids, measured distances
        for batch in batches:
            cell, ids = batch.column("cell").to_numpy(), batch.column("id").to_numpy(zero_copy_only=False)
            for c in np.unique(cell):
                asking = np.flatnonzero(allowed[:, c])
                if not len(asking):
                    continue
                own = np.flatnonzero(cell == c)
                rows = batch.take(pa.array(own))
                x, named = _matrix(rows.column("embedding")), ids[own]
                codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(own), parts) if rerank else None
                for at in range(0, len(asking), ASKED):
                    some = asking[at : at + ASKED]
                    if rerank:
                        rest = (wanted[some] - index.centres[c]).reshape(len(some), parts, 1, width)
                        tables = ((index.books - rest) ** 2).sum(axis=3)
                        order = tables[:, np.arange(parts), codes].sum(axis=2)
                    else:
                        order = np.stack([((x - q) ** 2).sum(axis=1) for q in wanted[some]])
                    for j, d in zip(some.tolist(), order):
                        had = found.get(j)
                        # Once enough are found, the farthest of them bounds what can come in.
                        open_ = np.flatnonzero(d <= had[0].max()) if had and len(had[0]) == most else np.arange(len(d))
                        new = open_[_nearest(d[open_], named[open_], most)]
                        if not len(new):
                            continue
                        gap = ((x[new] - wanted[j]) ** 2).sum(axis=1) if rerank else d[new]
                        merged = [d[new], named[new], gap] if had is None else [np.r_[u, v] for u, v in zip(had, (d[new], named[new], gap))]
                        keep = _nearest(merged[0], merged[1], most)
                        found[j] = tuple(m[keep] for m in merged)
        for j, (_, of, distances) in found.items():
            best = _nearest(distances, of, k)
            yield pa.RecordBatch.from_arrays([pa.array([names[j]] * len(best), pa.int64()), pa.array(of[best]), pa.array(distances[best])], names=["query_id", "id", "distance"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(queries: DataFrame, index: VectorIndex, k: int = 12, probes: float = 0.7, rerank: int = 10, exact: bool = False, query_id: str = "query_id", column: str = "embedding") -> DataFrame:
    """(query_id, id, distance, rank): the k nearest vectors of the index by squared L2, ties by id.

    Each query looks into the share ``probes`` of the cells, the nearest, and every task measures the best ``rerank`` x k
    of its own rows there by their codes, so no vector leaves its task. With ``exact`` the result is that of a search over all vectors. Null queries, and those of another
    length, find nothing. Queries are taken in blocks, each one or two passes over the cells that it asks for.
    """
    spark = queries.sparkSession
    table, size = index.table(spark), index.centres.shape[1]
    kind = table.schema["id"].dataType.simpleString()
    schema = f"query_id long, id {kind}, distance double"
    out = spark.createDataFrame([], schema + ", rank int")
    asked = queries.filter(F.size(column) == size).select(F.col(query_id).cast("long").alias("query_id"), F.col(column).cast("array<double>").alias("v"))

    def answered(rows: list) -> DataFrame:
        names, wanted = [r[0] for r in rows], np.array([r[1] for r in rows])
        gaps = np.sqrt(_squares(wanted, index.centres))
        many = max(1, int(np.ceil(probes * len(index.centres))))
        near = np.zeros(gaps.shape, bool)
        np.put_along_axis(near, np.argsort(gaps, axis=1, kind="stable")[:, :many], True, axis=1)

        def scan(allowed: np.ndarray, rerank: int) -> DataFrame:
            cells = [int(c) for c in np.flatnonzero(allowed.any(axis=0))]
            read = table.filter(F.col("cell").isin(cells)).select("cell", "id", "embedding", *(["codes"] if rerank else []))
            return _ranked(read.mapInArrow(_scan(names, wanted, allowed, index, k, rerank), schema), k)

        best = scan(near, rerank)
        if not exact:
            return best
        # The farthest of the k found bounds what can be nearer; a query with fewer asks all cells.
        limit = {r[0]: r[1] for r in best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.max("distance")).alias("far")).collect()}  # a row a query of the block
        bound = np.array([np.inf if limit.get(i) is None else np.sqrt(limit[i]) for i in names])
        return scan(gaps - index.radii - 1e-9 <= bound[:, None] * (1 + 1e-9), 0)

    block: list = []
    for row in asked.toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            out, block = out.unionByName(answered(block)), []
    return out.unionByName(answered(block)) if block else out


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, n, hits, recall): how many of the true neighbours (query_id, id) were found; a query that found none has 0."""
    hit = truth.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    counted = hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    return counted.withColumn("recall", F.col("hits") / F.col("n"))
