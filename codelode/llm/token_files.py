"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

The format, one data set per corpus, made of two tables in a folder:

* ``ranks``: rank, token_id. Ranks follow the number of occurrences in the whole corpus, most frequent first, then the id.
* ``blocks``: shard, block, base (ids of all documents of the shard before the block), doc_ids, doc_tokens
  (both little-endian arrays with one entry per document), control and data. Shards and blocks are in ascending
  doc_id order. Four ranks share one control byte, two bits each: the number of data bytes of the rank less one,
  low bits first; data holds the ranks' low bytes, little-endian, without gaps. The last group is filled up with
  rank 0.

Decoding looks each control byte up in 256-row tables for the group's size and the four offsets and lengths.
The columns hold plain bytes, so a block can be cut out and decoded by any reader of the two tables. Spark's own
writer makes the files: a lost task is repeated and committed once, and any store that Spark can write will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, new_path, staged, steps, texts_of, write_table
from .tokens import default_tokenizer, encoder

#: Ids after which a block is closed (a document is never split between blocks).
BLOCK_TOKENS = 1 << 20

_codes = np.arange(256)
LENGTHS = np.stack([(_codes >> (2 * k)) & 3 for k in range(4)], axis=1) + 1
SIZES = LENGTHS.sum(axis=1)
OFFSETS = np.cumsum(LENGTHS, axis=1) - LENGTHS
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.zeros(-(-len(values) // 4) * 4, dtype="<u4")
    v[: len(values)] = values
    lengths = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    control = ((lengths.reshape(-1, 4) - 1) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1).astype(np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of a control and a data stream."""
    c = np.frombuffer(control, dtype=np.uint8)
    sizes = SIZES[c]
    begin = np.cumsum(sizes) - sizes
    at = (begin[:, None] + OFFSETS[c]).ravel()
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    v = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        v |= raw[np.minimum(at + k, len(raw) - 1)].astype(np.uint32) << np.uint32(8 * k)
    return (v & _MASKS[LENGTHS[c].ravel()])[:n]


_ROWS = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def _tokenise(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        seen = np.zeros(0, dtype=np.int64)
        for batch in steps(batches, size_limit=8 << 20):
            ids, offsets = enc.encode(batch.column("text"), end_id)
            wide = 4 if len(ids) and int(ids.max()) > 0xFFFF else 2
            stored = ids.astype(f"<u{wide}")
            bounds = pa.py_buffer((offsets * wide).astype(np.int32))
            rows = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, bounds, pa.py_buffer(stored)])
            counts = np.bincount(ids, minlength=len(seen)).astype(np.int64)
            counts[: len(seen)] += seen
            seen = counts
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, wide, np.int32)), batch.column("doc_id"), pa.array(np.diff(offsets)), rows], schema=_ROWS)
        if used := np.flatnonzero(seen).tolist():
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(used), np.int32)), pa.array(used, pa.int64()), pa.array(seen[used]), pa.nulls(len(used), pa.binary())], schema=_ROWS)

    return run


_BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("base", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("doc_nulls", pa.binary()), ("doc_tokens", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])


def _encode(rank_of: np.ndarray, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, base, held, docs = TaskContext.get().partitionId(), 0, 0, 0, []

        def close() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, "<u4")
            control, data = pack(rank_of[ids])
            names = np.array([d or 0 for d, _ in docs], dtype="<i8").tobytes()
            nulls = np.array([d is None for d, _ in docs], dtype=np.uint8).tobytes()
            sizes = np.array([len(x) for _, x in docs], dtype="<u4").tobytes()
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "base": base, "n_tokens": len(ids), "doc_ids": names, "doc_nulls": nulls, "doc_tokens": sizes, "control": control, "data": data}], schema=_BLOCKS)

        for batch in batches:
            for kind, doc_id, ids in zip(batch.column("kind").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                docs.append((doc_id, np.frombuffer(ids.as_buffer(), dtype=f"<u{kind}")))
                held += len(docs[-1][1])
                if held >= block_tokens:
                    yield close()
                    block, base, held, docs = block + 1, base + held, 0, []
        if docs:
            yield close()

    return run


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _decode(token_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["doc_tokens"], dtype="<u4").astype(np.int64)
                ends = np.cumsum(sizes)
                total = int(ends[-1]) if len(ends) else 0
                ids = token_of[unpack(row["control"], row["data"], total)].astype("<u4")
                view = memoryview(ids).cast("B")
                crcs = [zlib.crc32(view[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())]
                names = pa.array(np.frombuffer(row["doc_ids"], dtype="<i8"), mask=np.frombuffer(row["doc_nulls"], dtype=np.uint8).astype(bool))
                yield pa.RecordBatch.from_arrays([names, pa.array(ends - sizes + row["base"]), pa.array(sizes), pa.array(crcs, pa.int64())], schema=_DOCS)

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every text and write the data set under ``folder``.

    The texts are tokenised once; ids (two bytes each where they fit) and the token counts of each task go to the
    shared folder. Counts are summed by token, so what comes to the driver has at most one row per vocabulary
    entry. The range exchange for the doc_id order carries ids, not texts.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    ids = staged(texts_of(docs, id_col, text_col).mapInArrow(lean(_tokenise(path, end_id)), "kind int, doc_id long, n long, ids binary"), "ids")
    ranks = ids.filter("kind = 0").groupBy(F.col("doc_id").alias("token_id")).agg(F.sum("n").alias("n"))
    listed = [r[0] for r in sorted(ranks.collect(), key=lambda r: (-r[1], r[0]))]
    rank_of = np.zeros(max(listed, default=0) + 1, dtype=np.uint32)
    rank_of[listed] = np.arange(len(listed), dtype=np.uint32)
    spark.createDataFrame([(k, t) for k, t in enumerate(listed)], "rank long, token_id long").coalesce(1).write.parquet(f"{folder}/ranks")
    rows = ids.filter("kind > 0")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "ids").select("kind", "doc_id", "ids")
    blocks = ordered.mapInArrow(lean(_encode(rank_of, block_tokens)), "shard int, block int, base long, n_tokens long, doc_ids binary, doc_nulls binary, doc_tokens binary, control binary, data binary")
    write_table(blocks, f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    ranks = spark.read.parquet(f"{folder}/ranks").collect()  # one row per vocabulary entry at most
    token_of = np.zeros(max(1, len(ranks)), dtype=np.uint32)
    for r in ranks:
        token_of[r["rank"]] = r["token_id"]
    blocks = spark.read.parquet(f"{folder}/blocks")
    totals = sorted((r[0], r[1]) for r in blocks.groupBy("shard").agg(F.sum("n_tokens")).collect())  # one row per shard
    begin, at = [], 0
    for shard, n in totals:
        begin.append((shard, at))
        at += n
    base = spark.createDataFrame(begin, "shard int, shard_base long")
    placed = blocks.join(F.broadcast(base), "shard").withColumn("base", F.col("base") + F.col("shard_base"))
    return placed.select("base", "doc_ids", "doc_nulls", "doc_tokens", "control", "data").mapInArrow(lean(_decode(token_of)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write ``docs`` as token-id files in the shared folder and read them back.

    Null and empty texts hold the end id alone. Rows with equal ids are all kept, ordered by their ids' bytes;
    rows with a null id come last. An empty table gives an empty result. Extra columns are ignored.
    """
    folder = new_path(docs.sparkSession, "token_files")
    write_token_files(docs, folder, tokenizer, end_id, id_col, text_col, block_tokens)
    return read_token_files(docs.sparkSession, folder)
