"""Exact deduplication with an extendible-hash index on shared files (DataFrame operations only).

Texts are equal when identical after deleting the characters ``[\\x20\\x09-\\x0D]``. The steps:

1. One pass gives every row's 64-bit key and SHA-256, written as a thin table, and the number of rows of each key.
2. A directory of buckets is grown as in extendible hashing: a bucket is the top ``depth`` bits of the key,
   and while a bucket holds more than ``bucket_capacity`` distinct keys it is split by one more bit, which
   doubles the directory. A bucket whose entries all share one key can't be split; its chain just grows.
3. Owner tasks each process a range of directory slots, that is of keys. They receive the rows of their range with
   the normalised texts and compare bytes: texts of one key that differ form a chain, each an entry of its own with
   its place in it. Rows of hot keys are first combined by key and bytes in the tasks that read them, so an owner
   gets at most one of their rows for each of these tasks. The owners write the index files.
4. Every row is looked up: key to slot, slot to bucket by the directory, then the chain's entry in that bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import FEW_ROWS, MOST_HOT, discard, join_split, new_path, no_space, staged, texts_of, write_table

BUCKET_CAPACITY = 1024
#: Characters of normalised text that one owner task receives, about.
OWNER_CHARS = 64_000_000
#: Directories of at most so many slots (24 bytes each) are broadcast.
SMALL_DIRECTORY = 1 << 16


def _slot(key: Column, depth: int, key_bits: int) -> Column:
    """The top ``depth`` of the key's ``key_bits`` bits."""
    if depth == 0:
        return F.lit(0).cast("long")
    return F.shiftrightunsigned(key, key_bits - depth)


def _keyed(docs: DataFrame, id_col: str, text_col: str, key_bits: int, *more: str) -> DataFrame:
    rows = texts_of(docs, id_col, text_col, *more)
    rows = rows.select("doc_id", *more, F.length("text").alias("points"), no_space(F.col("text")).alias("norm"))
    key = F.xxhash64("norm")
    return rows.withColumn("key", F.shiftrightunsigned(key, 64 - key_bits) if key_bits < 64 else key)


def grow_directory(keys: DataFrame, bucket_capacity: int, key_bits: int) -> tuple[DataFrame, int]:
    """Directory (slot, depth, bucket) of the distinct keys of ``keys`` and its global depth.

    Starts at the depth at which buckets are half full on average and splits overfull buckets level by level;
    only whether there are any comes to the driver.
    """
    n = keys.count()
    depth = min(key_bits, max(0, math.ceil(math.log2(max(1, 2 * n / bucket_capacity)))))
    done, pending = None, keys.select("key")
    while True:
        counts = staged(pending.groupBy(_slot(F.col("key"), depth, key_bits).alias("bucket")).agg(F.count(F.lit(1)).alias("n_keys")), f"buckets{depth}")
        over = counts.filter(F.col("n_keys") > bucket_capacity)
        last = depth >= key_bits or over.isEmpty()
        level = (counts if last else counts.filter(F.col("n_keys") <= bucket_capacity)).select("bucket", F.lit(depth).alias("depth"))
        done = level if done is None else done.unionByName(level)
        if last:
            break
        pending = pending.join(over.select(F.col("bucket").alias("over")), _slot(F.col("key"), depth, key_bits) == F.col("over"), "left_semi")
        depth += 1
    spread = F.pow(F.lit(2.0), F.lit(depth) - F.col("depth")).cast("long")
    directory = done.select(F.explode(F.sequence(F.col("bucket") * spread, (F.col("bucket") + 1) * spread - 1)).alias("slot"), "depth", "bucket")
    return staged(directory, "directory"), depth


def _located(rows: DataFrame, directory: DataFrame, depth: int, key_bits: int) -> DataFrame:
    """``rows`` with a key, and the depth and bucket that the directory has for its slot."""
    slots = F.broadcast(directory) if 1 << depth <= SMALL_DIRECTORY else directory.hint("merge")
    return rows.withColumn("slot", _slot(F.col("key"), depth, key_bits)).join(slots, "slot")


def build_index(docs: DataFrame, keys: DataFrame, directory: DataFrame, depth: int, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """Write the index files and return them as a table: owner, slot, depth, bucket, key, chain_place, chain_length, sha, keep_id, group_size.

    ``keys`` (key, n, chars) are those of ``docs``. ``keep_id`` belongs to the row with most code points in the original
    text, then the smallest id; null ids come last.
    """
    spark = docs.sparkSession
    total, chars = keys.agg(F.sum("n"), F.sum("chars")).first()
    n_owners = max(1, min(1 << depth, max(int(spark.conf.get("spark.sql.shuffle.partitions")), (chars or 0) // OWNER_CHARS)))
    rows = _keyed(docs, id_col, text_col, key_bits).select("key", "norm", "points", "doc_id", F.lit(1).cast("long").alias("n"))
    hot = keys.filter(F.col("n") > max(FEW_ROWS, (total or 0) // MOST_HOT)).select("key")
    if not hot.isEmpty():
        # Fewer than MOST_HOT keys, each with more than that share of the rows.
        combined = rows.join(F.broadcast(hot), "key", "left_semi").groupBy("key", "norm", "points").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
        rows = rows.join(F.broadcast(hot), "key", "left_anti").unionByName(combined)
    slot = _slot(F.col("key"), depth, key_bits)
    placed = rows.withColumns({"slot": slot, "owner": F.floor(slot * n_owners / (1 << depth)).cast("int")}).repartitionById(n_owners, F.col("owner"))
    best = F.max(F.struct("points", F.col("doc_id").isNotNull().alias("has_id"), (-F.col("doc_id")).alias("minus_id"))).alias("best")
    entries = placed.groupBy("owner", "slot", "key", "norm").agg(best, F.sum("n").alias("group_size"))
    entries = entries.select("owner", "slot", "key", F.unhex(F.sha2("norm", 256)).alias("sha"), (-F.col("best.minus_id")).alias("keep_id"), "group_size")
    chain = Window.partitionBy("owner", "slot", "key")
    entries = entries.withColumns({"chain_place": F.row_number().over(chain.orderBy("sha")), "chain_length": F.count(F.lit(1)).over(chain)})
    entries = write_table(entries, new_path(spark, "entries"))
    index = _located(entries.drop("slot"), directory, depth, key_bits)
    index = index.select("owner", "slot", "depth", "bucket", "key", "chain_place", "chain_length", "sha", "keep_id", "group_size")
    out = write_table(index, new_path(spark, "index"))
    discard(entries)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64, bucket_capacity: int = BUCKET_CAPACITY, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, chain_length; with ``row_col`` also points and that column.

    Null texts count as empty; empty and blank texts are equal to one another. Rows with a null id belong to
    their group like others and are kept only if no row of the group with as long a text has an id. Rows
    that repeat id and text are counted each, and ``kept`` holds for all of them if their id is kept. An empty
    table gives an empty result. Extra columns are ignored. Of the index, ``key_bits`` bits of the key are used.
    """
    if not 1 <= key_bits <= 64:
        raise ValueError("key_bits must be 1 to 64")
    more = ["points", row_col] if row_col else []
    rows = staged(_keyed(docs, id_col, text_col, key_bits, *more[1:]).select("doc_id", *more, "key", F.length("norm").alias("chars"), F.unhex(F.sha2("norm", 256)).alias("sha")), "rows")
    keys = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")), "keys")
    directory, depth = grow_directory(keys, bucket_capacity, key_bits)
    index = build_index(docs, keys, directory, depth, id_col, text_col, key_bits)
    total = keys.agg(F.sum("n")).first()[0] or 0
    discard(keys)
    entries = index.select("depth", "bucket", "key", "sha", "keep_id", F.col("group_size"), F.col("group_size").alias("size"), "chain_length")
    found = join_split(_located(rows, directory, depth, key_bits), entries, ["depth", "bucket", "key", "sha"], "size", total)
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("chain_length").cast("long").alias("chain_length"),
        *more,
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
