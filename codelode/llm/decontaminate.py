"""Benchmark decontamination: BM25 over test items with block-max WAND, then question and answer overlap.

The items are indexed on the driver in shards of at most ``SHARD_ITEMS`` items and ``SHARD_CHARS`` characters; each
shard's index is sent to the tasks and queried in a pass of its own over the documents, so the size of each is bounded
however many items there are (the driver holds those of one query until its end); word frequencies, mean length and number of entries are those of all shards. Items of more than ``ENTRY_WORDS`` words are indexed in parts of that many words, the
last one overlapping the one before. Parts only retrieve: what is verified is the whole item.

Every document is cut into segments of as many words as the longest entry has (32 at least), and each two neighbouring
segments make a passage, so any copy of an entry lies whole in some passage. A passage is a query of its distinct
words. Impacts are BM25 scores divided by the entry's score for its own text, so one threshold serves all entries.
Entries are numbered in blocks. For each word and block the largest impact is known; the sums of these over a
passage bound its score in each block, and blocks below the threshold are skipped. In the blocks that remain,
WAND moves its cursors by the same bounds and scores only entries that may reach the threshold.

A retrieved entry counts if the passage holds at least ``OVERLAP`` of the five-word shingles of its question and
of its answer (of a text with fewer words, that of its whole sequence). For an item in parts, the document from at
least the item's length before the passage to as much after it takes the passage's place.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, steps, texts_of
from .words import coded_words

SHARD_ITEMS, SHARD_CHARS, ENTRY_WORDS, BLOCKS = 2_000, 8 << 20, 256, 256
#: Share of an entry's own BM25 score that a passage must reach, and share of shingles that it must hold.
THRESHOLD, OVERLAP, SHINGLE = 0.5, 0.8, 5
K1, B = 1.2, 0.75


def normal(word: str) -> str:
    """A word in lower case without marks at its ends; empty if nothing is left."""
    low = word.lower()
    return low if low.isalnum() else re.sub(r"^[\W_]+|[\W_]+$", "", low)


def words_of(text: str) -> list[str]:
    return [w for w in map(normal, re.findall(r"[^\x20\x09-\x0D]+", text)) if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of both parts: up to the last question mark that has words after it, else up to the last sentence, else two thirds."""
    for mark in (r"^(.*\?)(.*\w.*)$", r"^(.*\w.*[.!?]\s+)(.*\w.*)$"):
        if (m := re.match(mark, text, re.S)) and words_of(m[1]) and words_of(m[2]):
            return words_of(m[1]), words_of(m[2])
    words = words_of(text)
    cut = -(-2 * len(words) // 3)
    return words[:cut], words[cut:]


def _shingles(words: list[str]) -> set[tuple]:
    return {tuple(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def _parts(words: list[str]) -> list[list[str]]:
    """The entries of an item; none if it has too few words to be told from chance."""
    if len(words) <= ENTRY_WORDS:
        return [words] if len(words) >= SHINGLE else []
    return [words[k : k + ENTRY_WORDS] for k in [*range(0, len(words) - ENTRY_WORDS, ENTRY_WORDS), len(words) - ENTRY_WORDS]]


class Index:
    """Inverted index of one shard of items; scored by the shard's own counts unless those of the whole benchmark are given."""

    def __init__(self, items: list[tuple[int, str]], n_total: int | None = None, document_frequency: dict[str, int] | None = None, mean_words: float | None = None):
        self.entries: list[tuple[int, list[str], list[str]]] = []  # item, words of the question and of the answer
        bags = []
        #: Of an entry that is a part of an item: the item's place in the shard and its number of words.
        parts_of: list[tuple[int, int] | None] = []
        for place, (item, text) in enumerate(items):
            question, answer = question_and_answer(text or "")
            words = question + answer
            parts = _parts(words)
            for part in parts:
                self.entries.append((item, question, answer))
                parts_of.append((place, len(words)) if len(parts) > 1 else None)
                bags.append(Counter(part))
        order = sorted(range(len(bags)), key=lambda e: sorted(bags[e].items(), key=lambda x: (-x[1], x[0]))[0][0])
        self.entries, bags, self.parts_of = [self.entries[e] for e in order], [bags[e] for e in order], [parts_of[e] for e in order]
        n = n_total or len(bags)
        frequency = document_frequency or Counter(w for bag in bags for w in bag)
        mean = mean_words or sum(sum(b.values()) for b in bags) / max(1, len(bags))
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for b in bags for w in b}))}
        lists: list[list[tuple[int, float]]] = [[] for _ in self.vocabulary]
        for e, bag in enumerate(bags):
            size = sum(bag.values())
            score = {w: math.log(1 + (n - frequency[w] + 0.5) / (frequency[w] + 0.5)) * t * (K1 + 1) / (t + K1 * (1 - B + B * size / mean)) for w, t in bag.items()}
            own = sum(score.values())
            for w, s in score.items():
                lists[self.vocabulary[w]].append((e, s / own))
        self.per_block = max(1, -(-len(bags) // BLOCKS))
        self.postings = [(np.array([e for e, _ in p]), np.array([s for _, s in p])) for p in lists]
        self.block_max = np.zeros((len(lists), BLOCKS), np.float32)
        for v, (e, s) in enumerate(self.postings):
            np.maximum.at(self.block_max[v], e // self.per_block, s)
        self.segment = max(32, max((sum(b.values()) for b in bags), default=0))

    def search(self, terms: np.ndarray, blocks: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Entries of the given blocks with a score of at least ``threshold`` for the distinct ``terms``, by block-max WAND."""
        found = []
        for b in blocks.tolist():
            cursors = []
            for v in terms.tolist():
                if bound := float(self.block_max[v, b]):
                    e, s = self.postings[v]
                    i, j = np.searchsorted(e, (b * self.per_block, (b + 1) * self.per_block))
                    cursors.append([0, e[i:j].tolist(), s[i:j].tolist(), bound])
            while cursors:
                cursors.sort(key=lambda c: c[1][c[0]])
                total, pivot = 0.0, None
                for c in cursors:
                    total += c[3] * (1 + 1e-6)
                    if total >= threshold:
                        pivot = c[1][c[0]]
                        break
                if pivot is None:
                    break
                if cursors[0][1][cursors[0][0]] == pivot:
                    score = sum(c[2][c[0]] for c in cursors if c[1][c[0]] == pivot)
                    if score >= threshold - 1e-9:
                        found.append((pivot, score))
                    for c in cursors:
                        c[0] += c[1][c[0]] == pivot
                else:
                    for c in cursors:
                        if c[1][c[0]] >= pivot:
                            break
                        while c[0] < len(c[1]) and c[1][c[0]] < pivot:
                            c[0] += 1
                cursors = [c for c in cursors if c[0] < len(c[1])]
        return found

    def overlaps(self, entry: int, passage: set[tuple], joined: str) -> tuple[float, float]:
        """Shares of the question's and of the answer's shingles that the passage holds."""
        out = []
        for words in self.entries[entry][1:]:
            if not words:
                out.append(1.0)
            elif len(words) < SHINGLE:
                out.append(float(f" {' '.join(words)} " in joined))
            else:
                s = _shingles(words)
                out.append(len(s & passage) / len(s))
        return out[0], out[1]

    def _whole_overlaps(self, entry: int, whole: tuple[int, int], row: int, begin: int, names: list[str], codes: np.ndarray, known: dict) -> tuple[float, float]:
        """``overlaps`` of an item in parts with the stretch about a passage; passages that begin in one item's length share a stretch."""
        place, n = whole
        key = (row, place, begin // n)
        if key not in known:
            words = [names[c] for c in codes[max(0, (key[2] - 1) * n) : (key[2] + 2) * n + 2 * self.segment].tolist()]
            known[key] = self.overlaps(entry, _shingles(words), f" {' '.join(words)} ")
        return known[key]

    def hits(self, texts: pa.Array, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
        """(row, item, score, question overlap, answer overlap), once for each row and item, with the best passage's values."""
        raw, codes, bounds = coded_words(texts)
        names = [normal(w) for w in raw]
        real = np.array([bool(w) for w in names], dtype=bool)
        if len(codes) and not real.all():
            keep = real[codes]
            kept = np.concatenate([[0], np.cumsum(keep)])
            codes, bounds = codes[keep], kept[bounds]
        if not len(codes) or not self.entries:
            return []
        term = np.fromiter((self.vocabulary.get(w, -1) for w in names), np.int64, len(names))[codes]
        sizes = np.diff(bounds)
        n_segments = -(-sizes // self.segment)
        first = np.cumsum(n_segments) - n_segments
        row = np.repeat(np.arange(len(sizes)), sizes)
        segment = first[row] + (np.arange(len(codes)) - bounds[:-1][row]) // self.segment
        known = term >= 0
        pairs = np.unique(segment[known] * len(self.vocabulary) + term[known])
        seg, vid = pairs // len(self.vocabulary), pairs % len(self.vocabulary)
        used = -(-len(self.entries) // self.per_block)
        bound = np.zeros((int(n_segments.sum()) + 1, used), np.float32)
        starts = np.append(np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(seg) else [], len(seg)).astype(np.int64)
        for k in range(0, len(starts) - 1, 1024):
            own = starts[k : k + 1025]
            bound[seg[own[:-1]]] = np.add.reduceat(self.block_max[vid[own[0] : own[-1]], :used], own[:-1] - own[0], axis=0)
        row_of = np.repeat(np.arange(len(sizes)), n_segments)
        follows = np.concatenate([row_of[1:] == row_of[:-1], [False]])
        both = bound[:-1] + np.where(follows[:, None], bound[1:], 0)
        open_ = both.max(axis=1) >= threshold * (1 - 1e-5)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        stretches: dict[tuple[int, int, int], tuple[float, float]] = {}
        for s in np.flatnonzero(open_).tolist():
            r = int(row_of[s])
            begin = int(bounds[r]) + (s - int(first[r])) * self.segment
            end = min(int(bounds[r + 1]), begin + 2 * self.segment)
            terms = np.unique(term[begin:end])
            found = self.search(terms[terms >= 0], np.flatnonzero(both[s] >= threshold * (1 - 1e-5)), threshold)
            if not found:
                continue
            words = [names[c] for c in codes[begin:end].tolist()]
            passage, joined = _shingles(words), f" {' '.join(words)} "
            for e, score in found:
                if whole := self.parts_of[e]:
                    q, a = self._whole_overlaps(e, whole, r, begin - int(bounds[r]), names, codes[bounds[r] : bounds[r + 1]], stretches)
                else:
                    q, a = self.overlaps(e, passage, joined)
                if q >= overlap and a >= overlap:
                    key = (r, self.entries[e][0])
                    best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (float(score), q, a))
        return [(r, i, *v) for (r, i), v in best.items()]


def shards(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """Items in lists of bounded size, one after the other; null items are left out."""
    items = benchmark.select(benchmark[id_col].cast("long").alias("item_id"), benchmark[text_col].cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    held, chars = [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        if held and (len(held) >= SHARD_ITEMS or chars + len(r["text"]) > SHARD_CHARS):
            yield held
            held, chars = [], 0
        held.append((r["item_id"], r["text"]))
        chars += len(r["text"])
    if held:
        yield held


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """The index of each shard; what is counted over the whole benchmark before is one number per word."""
    n, size, frequency = 0, 0, Counter()
    for shard in shards(benchmark, id_col, text_col):
        for _, text in shard:
            question, answer = question_and_answer(text)
            for part in _parts(question + answer):
                n, size = n + 1, size + len(part)
                frequency.update(set(part))
    for shard in shards(benchmark, id_col, text_col) if n else ():
        yield Index(shard, n, frequency, size / n)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row and item it holds: doc_id, item_id, score, question_overlap, answer_overlap.

    Null and empty texts hold nothing. Items of fewer than five words, which any text may hold by chance, and null items
    are found nowhere; items with equal texts are each reported. Rows that repeat an id are reported each, with a null id too. Empty tables give an empty result.
    Extra columns are ignored.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    rows, out = texts_of(docs, id_col, text_col), None
    for index in indexes(benchmark, item_id_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches):
                found = sent.value.hits(batch.column("text"), threshold, overlap)
                ids = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                rest = [pa.array([f[k] for f in found], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64()))]
                yield pa.RecordBatch.from_arrays([ids, *rest], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = rows.mapInArrow(lean(run), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold an item: the same search, filtering rows where they are, so no exchange is needed.

    Null and empty texts stay, rows are judged each for itself, and all columns are kept.
    """
    out = docs
    for index in indexes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches, text_col):
                texts = batch.column(text_col)
                held = {f[0] for f in sent.value.hits(texts.fill_null(""), threshold, overlap)}
                yield batch.filter(pa.array([k not in held for k in range(batch.num_rows)], pa.bool_()))

        out = out.mapInArrow(lean(run), docs.schema)
    return out
