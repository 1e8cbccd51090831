"""Best-fit packing with bound-certified repacking.

Documents are tokenised and cut into pieces of at most ``capacity`` ids. Pieces of full length fill a sequence
alone. The others are dealt to partitions and packed there by best-fit decreasing. For each partition the
dual-feasible-function bound says how many sequences any packing needs; a partition that meets its bound is
certified and done. Partitions with a gap give up the pieces of their unfilled sequences, exchange them by
dealing them anew to fewer partitions, and rerun best-fit decreasing, until all are certified, the pool fits
one partition, or a round saves nothing. The result says of each piece whether its partition was certified.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, staged, steps, texts_of
from .tokens import default_tokenizer, encoder

#: Pieces that one packing task holds: some 10 MB.
POOL_PIECES = 100_000
ROUNDS = 6


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every piece. Bins are kept by free room; a bit mask finds the tightest that fits."""
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n_bins = 0, 0
    for k, size in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, n_bins
            n_bins += 1
        bin_of[k], offset[k] = b, capacity - room
        room -= size
        if not by_room[room]:
            mask |= 1 << room
        by_room[room].append(b)
    return bin_of, offset


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs, by two families of dual feasible functions over all their parameters.

    With counts by length, f0(e): pieces longer than capacity - e count whole, those shorter than e nothing.
    u(k): a piece x of which (k + 1) x / capacity is whole counts x / capacity, else floor((k + 1) x / capacity) / k.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    weight = count * np.arange(capacity + 1)
    bound = -(-int(weight.sum()) // capacity)
    upto, many = np.cumsum(weight), np.cumsum(count)
    e = np.arange(1, capacity // 2 + 1)
    f0 = (many[-1] - many[capacity - e]) * capacity + upto[capacity - e] - upto[e - 1]
    bound = max(bound, -(-int(f0.max()) // capacity)) if len(e) else bound
    x = np.flatnonzero(count)
    for k in range(1, 101):
        whole, rest = np.divmod((k + 1) * x, capacity)
        value = np.where(rest == 0, x * k, whole * capacity)
        bound = max(bound, -(-int((value * count[x]).sum()) // (k * capacity)))
    return bound


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])


def _pieces(path: str, end_id: int | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in steps(batches):
            ids, offsets = enc.encode(batch.column("text"), end_id)
            view = memoryview(np.ascontiguousarray(ids)).cast("B")
            out: list[list] = [[], [], [], [], []]
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                for p, s in enumerate(range(a, b, capacity)):
                    t = min(b, s + capacity)
                    for column, x in zip(out, (doc_id, p, s - a, t - s, zlib.crc32(view[4 * s : 4 * t]))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECES)], schema=_PIECES)

    return run


_PACKED = "part long, bin long, bound long, bins long, doc_id long, piece int, start long, length int, ids_crc32 long, offset long"


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        lengths = t.column("length").to_numpy().astype(np.int64)
        bin_of, offset = best_fit_decreasing(lengths, capacity)
        n, part = len(lengths), TaskContext.get().partitionId()
        first = [pa.array(np.full(n, part, np.int64)), pa.array(bin_of), pa.array(np.full(n, lower_bound(lengths, capacity), np.int64)), pa.array(np.full(n, int(bin_of.max()) + 1, np.int64))]
        columns = first + [t.column(c).combine_chunks() for c in _PIECES.names] + [pa.array(offset)]
        yield from pa.Table.from_arrays(columns, names=["part", "bin", "bound", "bins", *_PIECES.names, "offset"]).to_batches(max_chunksize=50_000)

    return run


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", pool_pieces: int = POOL_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified.

    ``certified``: no packing of its partition's pieces needs fewer sequences (pieces of full length always are).
    Null and empty texts hold the end id alone (without an end id they have no piece). Rows with equal or null
    ids are packed each for itself. An empty table gives an empty result. Extra columns are ignored.
    """
    path = tokenizer or default_tokenizer()
    pieces = staged(texts_of(docs, id_col, text_col).mapInArrow(lean(_pieces(path, end_id, capacity)), "doc_id long, piece int, start long, length int, ids_crc32 long"), "pieces")
    full, pool = pieces.filter(F.col("length") == capacity), pieces.filter(F.col("length") < capacity)
    level = 1 << 56
    done = [full.select(*_PIECES.names, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))]
    n, last_gap = pool.count(), None
    for turn in range(ROUNDS):
        n_parts = max(1, -(-n // pool_pieces))
        dealt = pool.select(*_PIECES.names, F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(n_parts)).alias("deal"))
        dealt = (dealt.repartition(n_parts, "deal") if n_parts > 1 else dealt.coalesce(1)).select(*_PIECES.names)
        packed = staged(dealt.mapInArrow(lean(_pack(capacity)), _PACKED), f"packed{turn}")
        gap = packed.groupBy("part").agg(F.max(F.col("bins") - F.col("bound")).alias("gap")).agg(F.sum("gap")).first()[0] or 0
        last = gap == 0 or n_parts == 1 or turn == ROUNDS - 1 or (last_gap is not None and gap >= last_gap)
        sure = packed if last else None
        if not last:
            fill = packed.groupBy("part", "bin").agg(F.sum("length").alias("fill"))
            marked = packed.join(fill, ["part", "bin"])
            open_ = (F.col("bins") > F.col("bound")) & (F.col("fill") < capacity)
            sure, pool = marked.filter(~open_), staged(marked.filter(open_).select(*_PIECES.names), f"pool{turn}")
            n, last_gap = pool.count(), gap
        number = F.lit(level * (turn + 1)) + F.col("part") * (1 << 33) + F.col("bin")
        done.append(sure.select(*_PIECES.names, number.alias("sequence_id"), "offset", (F.col("bins") == F.col("bound")).alias("certified")))
        if last:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
