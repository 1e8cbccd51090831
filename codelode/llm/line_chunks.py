"""Line deduplication by content-defined chunks of lines.

A rolling hash over the hashes of ``WINDOW`` neighbouring lines decides where chunks end, so an inserted or deleted
line moves only the boundaries next to it. A line of ``LONG_WORDS`` words or more is a chunk of its own. Chunks of
several lines, and long lines, that occur in several documents stay in the one with the smallest id only; further
occurrences within a document go too. Chunks are grouped by their bytes: the text itself is the grouping key, and
what is counted before the exchange is one row per distinct chunk and task.

A chunk at a passage's edge holds lines of its neighbours too, so of a repeated passage of short lines chunks leave
much. ``drop_repeated_passages`` therefore looks at windows as well: from each line with words on, the fewest lines
that hold ``LONG_WORDS`` words, and likewise up to each line. A passage of at least that many words that occurs twice
is covered, line by line, by such windows inside it, whatever stands around it: a line is either in the window that
starts with the passage or at the end of one. So the lines of repeated windows are those of the maximal repeated
passages. There chunks and windows are grouped by 128-bit BLAKE2b digests of their lines, and what a digest would have
removed is compared by its bytes before it goes: two texts with one digest are an error.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, staged, steps, texts_of

WINDOW, DIVISOR, LONG_WORDS = 2, 2, 50


def cut(text: str) -> list[tuple[str, bool]]:
    """Chunks of a text, and whether each may be removed if repeated; joined by line feeds they are the text."""
    chunks: list[tuple[str, bool]] = []
    held: list[str] = []
    roll: list[int] = []

    def close() -> None:
        if held:
            chunks.append(("\n".join(held), len(held) > 1 and any(x.strip() for x in held)))
            held.clear()

    for line in text.split("\n"):
        if len(line) > 2 * LONG_WORDS - 2 and len(line.split()) >= LONG_WORDS:
            close()
            chunks.append((line, True))
            roll.clear()
            continue
        held.append(line)
        roll.append(xxhash.xxh3_64_intdigest(line))
        del roll[:-WINDOW]
        mixed = sum(h * (2 * k + 3) for k, h in enumerate(reversed(roll))) % (1 << 64)
        if len(roll) == WINDOW and (mixed * 0x9E3779B97F4A7C15 % (1 << 64) >> 40) % DIVISOR == 0:
            close()
    close()
    return chunks


def _digest(chunk: str) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        ids, texts, digests = [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            for chunk in dict.fromkeys(c for c, may in cut(text) if may):
                ids.append(doc_id)
                texts.append(chunk)
                digests.append(_digest(chunk))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(digests, pa.binary())], names=["doc_id", "chunk", "digest"])


def _rewritten(text: str, drop: set[bytes]) -> tuple[str, int]:
    kept, seen, lines = [], set(), 0
    for chunk, may in cut(text):
        if may:
            d = _digest(chunk)
            if d in drop or d in seen:
                lines += chunk.count("\n") + 1
                continue
            seen.add(d)
        kept.append(chunk)
    return "\n".join(kept), lines


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        out = [_rewritten(t, set(d or ())) for t, d in zip(batch.column("text").to_pylist(), batch.column("drops").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t for t, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=["doc_id", "text", "removed_lines"])


def drop_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text without repeated chunks, removed_lines.

    Null texts count as empty. Rows with a null id lose only repeats within their own text and count for nobody
    else. Rows that repeat an id count as one document. Blank chunks stay. An empty table gives an empty result.
    Extra columns are ignored.
    """
    rows = texts_of(docs, id_col, text_col)
    chunks = rows.filter("doc_id IS NOT NULL").mapInArrow(lean(_chunks), "doc_id long, chunk string, digest binary")
    shared = chunks.groupBy("digest", "chunk").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    shared = staged(shared.groupBy("digest").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("texts")), "shared")
    clash = shared.filter("texts > 1")
    if not clash.isEmpty():
        raise RuntimeError("two different chunks have one 128-bit digest")
    thin = rows.filter("doc_id IS NOT NULL").mapInArrow(lean(_chunks), "doc_id long, chunk string, digest binary").select("doc_id", "digest").distinct()
    drops = thin.join(shared.hint("merge"), "digest").filter("doc_id > first").groupBy("doc_id").agg(F.collect_set("digest").alias("drops"))
    drops = staged(drops, "drops")
    discard(shared)
    return rows.join(drops.hint("merge"), "doc_id", "left").select("doc_id", "text", "drops").mapInArrow(lean(_rewrite), "doc_id long, text string, removed_lines long")


def spans(text: str) -> tuple[list[str], list[tuple[int, int, bytes]]]:
    """Lines of a text, and its removable chunks and windows in order: first line, line after the last, digest."""
    lines = text.split("\n")
    marks = [blake2b(line.encode(), digest_size=16).digest() for line in lines]
    upto = [0, *accumulate(len(line.split()) for line in lines)]
    found, at = set(), 0
    for chunk, may in cut(text):
        end = at + chunk.count("\n") + 1
        if may:
            found.add((at, end))
        at = end
    for k in range(len(lines) if upto[-1] >= LONG_WORDS else 0):
        if upto[k] < upto[k + 1]:
            if upto[-1] - upto[k] >= LONG_WORDS:
                found.add((k, bisect_left(upto, upto[k] + LONG_WORDS)))
            if upto[k + 1] >= LONG_WORDS:
                found.add((bisect_right(upto, upto[k + 1] - LONG_WORDS) - 1, k + 1))
    return lines, [(a, b, blake2b(b"".join(marks[a:b]), digest_size=16).digest()) for a, b in sorted(found)]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        ids, digests = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            own = {d for _, _, d in spans(text)[1]}
            ids.extend([doc_id] * len(own))
            digests.extend(own)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "digest"])


def _shared_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines themselves of spans whose digests are shared, each once in a step."""
    for batch in steps(batches):
        found = {}
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            lines, marked = spans(text)
            wanted = set(wanted)
            for a, b, d in marked:
                if d in wanted:
                    found[d, "\n".join(lines[a:b])] = None
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.binary()), pa.array([t for _, t in found], pa.string())], names=["digest", "lines"])


def _without(text: str, drop: set[bytes]) -> tuple[str, int]:
    lines, found = spans(text)
    gone, met = bytearray(len(lines)), {}
    for a, b, d in found:
        x, y = met.setdefault(d, (a, b))
        if d in drop or (y <= a and lines[x:y] == lines[a:b]):
            gone[a:b] = b"\1" * (b - a)
    return "\n".join(line for line, g in zip(lines, gone) if not g), sum(gone)


def _rewrite_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        out = [_without(t, set(d or ())) for t, d in zip(batch.column("text").to_pylist(), batch.column("drops").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t for t, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=["doc_id", "text", "removed_lines"])


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text without repeated chunks and passages, removed_lines.

    Of what is repeated, the copy in the document with the smallest id stays, and there the first one; a repeat in
    the same text counts if it doesn't overlap the first. Null texts and ids, repeated ids, blank chunks and extra
    columns are treated as in ``drop_repeated_chunks``.
    """
    rows = texts_of(docs, id_col, text_col)
    held = staged(rows.filter("doc_id IS NOT NULL").mapInArrow(lean(_spans), "doc_id long, digest binary"), "spans")
    shared = staged(held.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("digest", "first"), "shared")
    met = held.join(shared.hint("merge"), "digest").groupBy("doc_id").agg(F.collect_set("digest").alias("wanted"), F.collect_set(F.when(F.col("doc_id") > F.col("first"), F.col("digest"))).alias("drops"))
    met = staged(met, "drops")
    discard(held)
    discard(shared)
    alike = rows.join(met.select("doc_id", "wanted").hint("merge"), "doc_id").select("text", "wanted").mapInArrow(lean(_shared_bytes), "digest binary, lines string")
    if not alike.distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").isEmpty():
        raise RuntimeError("two different chunks or windows have one 128-bit digest")
    drops = met.filter(F.size("drops") > 0).select("doc_id", "drops")
    return rows.join(drops.hint("merge"), "doc_id", "left").select("doc_id", "text", "drops").mapInArrow(lean(_rewrite_lines), "doc_id long, text string, removed_lines long")
