"""A learned embedding of code and text: counts of terms near each other, and their truncated singular vectors.

Terms are identifiers and their parts. How often two stand within a few terms of each other is counted in one pass, most
of it in the tasks that read the texts; what is more often than chance (positive pointwise mutual information) makes a
sparse matrix, a row a pair. A randomised decomposition multiplies it with a thin matrix in tasks, a few times; what comes
to the driver has a row a term of the vocabulary, which is bounded. A text's vector is the sum of its terms', rare ones
weighing more, at unit length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, settled

#: Terms of the vocabulary, the most frequent by texts; the fewest texts that hold one.
MOST_TERMS, LEAST_TEXTS = 20_000, 2
#: Columns besides those asked for, and multiplications, of the decomposition.
SPARE, POWERS = 8, 3
#: A term: a run of letters of one case with its capital, or of capitals, or of digits.
PIECE = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+|\d+|[^\W\d_A-Za-z]+")
#: Bytes of text that a task takes at a time; terms, and pairs, that it counts before it hands them on; rows of the matrix that a task gets, and multiplies at a time.
STEP_BYTES, STEP_TERMS, STEP_PAIRS, STEP_ROWS, BLOCK = 4 << 20, 1 << 18, 1 << 23, 500, 64


def slices(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose rows, ``sizes`` each, come to about ``limit``; a larger row is one alone."""
    begin, held = 0, 0
    for k, size in enumerate(sizes):
        if k > begin and held + size > limit:
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += int(size)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (id, text) in slices of bounded text."""
    for batch in batches:
        yield from slices(batch, pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), STEP_BYTES)


class Embedding(NamedTuple):
    """Terms, their vectors (a row a term), and how much each weighs in a text."""

    terms: list[str]
    vectors: np.ndarray
    weights: np.ndarray


def plain_terms(text: str | None) -> list[str]:
    """Terms of a text, in order: words between signs and underscores, cut where the case changes, in lower case."""
    return list(map(str.lower, PIECE.findall(text or "")))


class _Numbers(dict):
    """Numbers of terms, found by the terms as they are written; -1 for those that have none, which aren't remembered."""

    def __missing__(self, written: str) -> int:
        number = self.get(written.lower(), -1)
        if number >= 0 and len(self) < 8 * MOST_TERMS:
            self[written] = number
        return number

    def of(self, text: str | None) -> np.ndarray:
        """Those of a text's terms that have one, in order."""
        found = np.fromiter(map(self.__getitem__, PIECE.findall(text or "")), np.int64)
        return found[found >= 0]


def text_counts(docs: DataFrame) -> DataFrame:
    """(term, n): how many of the texts (id, text) hold a term, counted in the tasks that read them."""

    def told(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in _texts(batches):
            for text in batch.column(1).to_pylist():
                held.update(set(plain_terms(text)))
                if len(held) > STEP_TERMS:
                    yield told(held)
                    held = Counter()
        yield told(held)

    return docs.select("id", "text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def near_pairs(docs: DataFrame, number: dict[str, int], window: int) -> DataFrame:
    """(code, n): how often two known terms stand within ``window`` of each other, as i * size + j with i <= j; a term beside itself counts from both sides."""
    size = len(number)
    kind = np.int32 if size**2 < 1 << 31 else np.int64

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate(held) if held else np.zeros(0, kind)
        codes.sort()
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
        each, n = codes[first].astype(np.int64), np.diff(np.r_[first, len(codes)])
        n[each // size == each % size] *= 2
        for at in range(0, len(each), STEP_TERMS):
            yield pa.RecordBatch.from_arrays([pa.array(each[at : at + STEP_TERMS]), pa.array(n[at : at + STEP_TERMS], pa.int64())], names=["code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held = _Numbers(number), []
        for batch in _texts(batches):
            said = [numbers.of(t) for t in batch.column(1).to_pylist()]
            flat, text = np.concatenate(said), np.repeat(np.arange(len(said)), [len(x) for x in said])
            for step in range(1, window + 1):
                inside = text[:-step] == text[step:]
                a, b = flat[:-step][inside], flat[step:][inside]
                held.append((np.minimum(a, b) * size + np.maximum(a, b)).astype(kind))
            if sum(map(len, held)) > STEP_PAIRS:
                yield from counted(held)
                held = []
        yield from counted(held)

    return docs.select("id", "text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _packed(entries: DataFrame) -> DataFrame:
    """(i, js, ns, total) of entries (i, j, n) that lie together by i: a row, or a piece of one, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j, n = (batch.column(k).to_numpy() for k in range(3))
            begin = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
            parts = [slice(a, b) for a, b in zip(begin, [*begin[1:], len(i)])]
            out = [[i[p.start] for p in parts], [j[p].tobytes() for p in parts], [n[p].tobytes() for p in parts], [n[p].sum() for p in parts]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.binary(), pa.binary(), pa.int64()))], names=["i", "js", "ns", "total"])

    return entries.mapInArrow(run, "i int, js binary, ns binary, total long")


def _times(matrix: DataFrame, weigh: Callable[[int, np.ndarray, np.ndarray], np.ndarray], right: np.ndarray) -> np.ndarray:
    """The packed sparse matrix, weighed and without what is below 0, times a thin one, whose rows are as many as the vocabulary's terms.

    A task spreads out a few rows at a time: a vocabulary is bounded, and its frequent terms stand beside many others.
    """
    size, width = right.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = np.zeros((BLOCK, size)), []

        def told() -> pa.RecordBatch:
            out = block[: len(rows)] @ right
            block[:] = 0
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([x.tobytes() for x in out], pa.binary())], names=["i", "v"])

        for batch in batches:
            for i, js, ns in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not rows or rows[-1] != i:
                    if len(rows) == BLOCK:
                        yield told()
                        rows = []
                    rows.append(i)
                j = np.frombuffer(js, np.int32)
                block[len(rows) - 1, j] = np.maximum(weigh(i, j, np.frombuffer(ns, np.int64)), 0)
        if rows:
            yield told()

    out = np.zeros((size, width))
    for r in matrix.select("i", "js", "ns").mapInArrow(run, "i int, v binary").collect():  # a row a term of the vocabulary, more where a file of the table is split
        out[r["i"]] += np.frombuffer(r["v"])
    return out


def learn(docs: DataFrame, dims: int = 64, window: int = 5) -> Embedding:
    """An embedding of the terms that at least ``LEAST_TEXTS`` of the texts (id, text) hold, ``MOST_TERMS`` at most.

    Fewer dimensions come out where there are fewer terms, the rest being 0. Without any such term all texts are 0.
    """
    n_texts = docs.count()
    ranked = text_counts(docs).filter(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "term").limit(MOST_TERMS).collect()
    terms = [r["term"] for r in ranked]
    if not terms:
        return Embedding([], np.zeros((0, dims)), np.zeros(0))
    size = len(terms)
    pairs = near_pairs(docs, {t: k for k, t in enumerate(terms)}, window).selectExpr(f"CAST(code DIV {size} AS INT) AS i", f"CAST(code % {size} AS INT) AS j", "n")
    both = pairs.selectExpr("inline(IF(i = j, array(struct(i, j, n)), array(struct(i, j, n), struct(j AS i, i AS j, n))))")
    # Rows of the matrix have up to as many entries as there are terms: few rows a task.
    matrix = settled(_packed(both.repartition(-(-size // STEP_ROWS), "i").sortWithinPartitions("i")), "matrix")
    margin = {r[0]: r[1] for r in matrix.groupBy("i").agg(F.sum("total")).collect()}  # a row a term
    total = sum(margin.values())
    share = np.array([margin.get(k, 0) / total if total else 0.0 for k in range(size)])

    def excess(i: int, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.log(n / total / (share[i] * share[j]))

    width = min(dims + SPARE, size)
    base, _ = np.linalg.qr(_times(matrix, excess, np.random.default_rng(1).normal(size=(size, width))))
    for _ in range(POWERS):
        base, _ = np.linalg.qr(_times(matrix, excess, base))
    # The matrix is symmetric: its part within the base has the singular values, and directions back in the terms.
    image = _times(matrix, excess, base)
    left, s, _ = np.linalg.svd(image, full_matrices=False)
    vectors = np.zeros((len(terms), dims))
    kept = min(dims, width)
    vectors[:, :kept] = left[:, :kept] * np.sqrt(s[:kept])
    discard(matrix)
    return Embedding(terms, vectors, np.array([math.log(1 + n_texts / r["n"]) for r in ranked]))


def embed(docs: DataFrame, model: Embedding) -> DataFrame:
    """(id, embedding) of texts (id, text); texts without a known term have 0 in all components."""
    number = {t: k for k, t in enumerate(model.terms)}
    sent = docs.sparkSession.sparkContext.broadcast((number, model.vectors * model.weights[:, None]))  # of a bounded vocabulary
    dims = model.vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, vectors = sent.value
        numbers = _Numbers(at)
        for batch in _texts(batches):
            out = np.zeros((batch.num_rows, dims))
            for k, text in enumerate(batch.column(1).to_pylist()):
                known, n = np.unique(numbers.of(text), return_counts=True)
                if len(known):
                    out[k] = n.astype(np.float64) @ vectors[known]
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * dims, pa.int32()), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "embedding"])

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, embedding array<double>")


def similarity(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
