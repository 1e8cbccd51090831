"""Grounding of answers by position: what an answer copies from its context, names, and says that it can't tell.

Copied spans are found by winnowed fingerprints: of every ``WINDOW`` runs of ``GRAM`` words in a row one is marked, by the
smallest hash, in the answer as in the context. Any span of at least ``GRAM + WINDOW - 1`` equal words has a mark in
both, so marks that meet name all shifts between answer and context at which such a span can lie; at these the words
themselves are compared, place by place, and runs of equal ones are the copied spans, whole and exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import TOKEN, abstention, identifiers, without_note

#: Words of a run that is hashed, and runs of which one is marked; spans of their sum less one are found.
GRAM, WINDOW = 4, 5
#: What stands between white space.
WORD = "[^ \t\n\x0B\f\r]+"
#: Factor of the runs' hashes; places compared at a time.
MIX, HELD = np.uint64(0x9E3779B97F4A7C15), 1 << 20


def words(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def marks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the runs marked in a row of words, which are given as numbers; fewer words than a run have none."""
    n = len(ids) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed = np.zeros(n, np.uint64)
    for k in range(GRAM):
        hashed = (hashed + ids[k : k + n].astype(np.uint64) + np.uint64(1)) * MIX
        hashed ^= hashed >> np.uint64(29)
    window = min(WINDOW, n)
    at = np.unique(np.lib.stride_tricks.sliding_window_view(hashed, window).argmin(axis=1) + np.arange(n - window + 1))
    return hashed[at], at


def shared_spans(a: np.ndarray, c: np.ndarray) -> list[tuple[int, int, int]]:
    """(place in a, words, first place in c) of the longest equal spans of at least ``GRAM + WINDOW - 1`` words, places from 0."""
    (mine, at), (theirs, there) = marks(a), marks(c)
    order = np.argsort(mine, kind="stable")
    low, high = np.searchsorted(mine[order], theirs, "left"), np.searchsorted(mine[order], theirs, "right")
    met = np.repeat(np.arange(len(theirs)), high - low)
    inside = np.arange(len(met)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    shifts = np.unique(there[met] - at[order[low[met] + inside]])
    found: dict[tuple[int, int], int] = {}
    step = max(1, HELD // max(1, len(a)))
    for k in range(0, len(shifts), step):
        part = shifts[k : k + step]
        to = part[:, None] + np.arange(len(a))
        equal = np.zeros((len(part), len(a) + 2), np.int8)
        equal[:, 1:-1] = ((to >= 0) & (to < len(c))) & (c[np.clip(to, 0, len(c) - 1)] == a)
        change = np.diff(equal, axis=1)
        row, begin = np.nonzero(change == 1)
        end = np.nonzero(change == -1)[1]
        for r, i, j in zip(row, begin, end):
            if j - i >= GRAM + WINDOW - 1:
                key = (int(i), int(j - i))
                found[key] = min(found.get(key, 1 << 62), int(i + part[r]))
    return [(i, n, c) for (i, n), c in found.items()]


def copied_spans(answers: DataFrame) -> DataFrame:
    """(id, span, place, n, context_place) of the longest spans of at least ``GRAM + WINDOW - 1`` words that an answer shares with its own context.

    Places count words from 1; a span that lies at several places of the context has the first. answers: id, answer,
    context. An answer and its context are a row, so nothing is exchanged; words that the answer doesn't hold are all one.
    """
    kind = answers.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, answer, context in zip(*(c.to_pylist() for c in batch.columns)):
                said = re.findall(WORD, answer or "")
                if len(said) < GRAM + WINDOW - 1:
                    continue
                number = {w: k for k, w in enumerate(dict.fromkeys(said), 1)}
                a = np.array([number[w] for w in said])
                c = np.array([number.get(w, 0) for w in re.findall(WORD, context or "")], dtype=np.int64)
                if len(c) >= GRAM + WINDOW - 1:
                    rows += [(i, " ".join(said[at : at + n]), at + 1, n, there + 1) for at, n, there in shared_spans(a, c)]
            if rows:
                ids, *columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64())))], names=["id", "span", "place", "n", "context_place"])

    read = answers.select("id", without_note(F.col("answer")).alias("answer"), "context")
    return read.mapInArrow(run, f"id {kind}, span string, place long, n long, context_place long")


def named(answers: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, kind, span, place, context_place) of the identifiers that answers name. answers: id, answer, context; vocabulary: token.

    ``grounded``: in the answer's context; ``outside``: only in the vocabulary; ``fabricated``: in neither or in the
    context alone, which the vocabulary should hold. Places count tokens from 1, each the first.
    """
    kind = answers.schema["id"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, body, tokens, context in zip(*(c.to_pylist() for c in batch.columns)):
                said, text = re.findall(TOKEN, body or "") if tokens else [], context or ""
                # Most names are nowhere in the text; only if one may be, its tokens are looked through.
                held = re.findall(TOKEN, text) if any(t in text for t in tokens or ()) else []
                rows += [(i, t, said.index(t) + 1, held.index(t) + 1 if t in held else None) for t in tokens or ()]
            if rows:
                ids, tokens, places, there = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(tokens, pa.string()), pa.array(places, pa.int64()), pa.array(there, pa.int64())], names=["id", "token", "place", "context_place"])

    read = answers.select("id", without_note(F.col("answer")).alias("body"), identifiers(F.col("answer")).alias("tokens"), "context")
    places = read.mapInArrow(placed, f"id {kind}, token string, place long, context_place long")
    known = places.join(vocabulary.select("token").distinct().withColumn("known", F.lit(True)), "token", "left")
    kinds = F.when(F.col("known").isNull(), "fabricated").when(F.col("context_place").isNull(), "outside").otherwise("grounded")
    return known.select("id", kinds.alias("kind"), F.col("token").alias("span"), "place", "context_place")


def grounding(answers: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, kind, span, place, n, context_place): copied spans, named identifiers, and the first phrase that abstains.

    ``copied``: places count words; ``grounded``, ``outside``, ``fabricated``: see ``named``; ``abstains``: the place
    counts characters. ``n`` counts words of copied spans and is 1 else. Null answers and contexts are empty; ids are unique.
    """
    one = F.lit(1).cast("long")
    copied = copied_spans(answers).select("id", F.lit("copied").alias("kind"), "span", F.col("place").cast("long").alias("place"), "n", F.col("context_place").cast("long").alias("context_place"))
    names = named(answers, vocabulary).select("id", "kind", "span", F.col("place").cast("long").alias("place"), one.alias("n"), "context_place")
    said = answers.select("id", without_note(F.col("answer")).alias("answer")).withColumn("span", abstention(F.col("answer"))).filter("span <> ''")
    says = said.select("id", F.lit("abstains").alias("kind"), "span", F.instr("answer", F.col("span")).cast("long").alias("place"), one.alias("n"), F.lit(None).cast("long").alias("context_place"))
    return copied.unionByName(names).unionByName(says)


def grounded_share(found: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, n_words, copied_words, share, abstains) of every answer: how many of its words lie in copied spans."""
    covered = found.filter("kind = 'copied'").select("id", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("n") - 1)).alias("at")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("copied_words"))
    quiet = found.filter("kind = 'abstains'").select("id", F.lit(True).alias("abstains"))
    n = answers.select("id", F.size(words(without_note(F.col("answer")))).cast("long").alias("n_words"))
    out = n.join(covered, "id", "left").join(quiet, "id", "left").withColumn("copied_words", F.coalesce("copied_words", F.lit(0)))
    share = F.when(F.col("n_words") > 0, F.col("copied_words") / F.col("n_words"))
    return out.select("id", "n_words", "copied_words", share.alias("share"), F.coalesce("abstains", F.lit(False)).alias("abstains"))
