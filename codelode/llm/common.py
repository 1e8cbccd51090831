"""Shared folder, staged tables and batch helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python operator holds at a time (a longer single text is held alone).
STEP_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; set here only in local mode when unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="codelode-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one table or file set in the shared folder."""
    return f"{shared_dir(spark)}/codelode/{uuid.uuid4().hex}/{label}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back. The write's shuffle files go as soon as the table is complete."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    return write_table(df, new_path(df.sparkSession, label))


#: A key with more than this share of a table's rows (and more than ``FEW_ROWS``) is hot; there are fewer hot keys than this.
MOST_HOT, FEW_ROWS = 10_000, 100


def join_split(many: DataFrame, one: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``many``, ``total`` rows, to ``one``: one row a key, with at least its number of rows of ``many`` in ``size``.

    Rows of hot keys meet a broadcast of at most ``MOST_HOT`` rows where they are, the others meet by an exchange, so no
    task gets all rows of a key. ``many`` is read twice and should be a staged table.
    """
    limit = max(FEW_ROWS, total // MOST_HOT)
    hot, cold = one.filter(F.col(size) > limit).drop(size), one.filter(F.col(size) <= limit).drop(size)
    rest = many.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return many.join(F.broadcast(hot), keys).unionByName(rest.join(cold.hint("merge"), keys))


def discard(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(doc_id, text, *more) of ``docs``: other columns, whatever their names, stay out; null texts become empty."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        *(docs[c] for c in more),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def no_space(text: Column) -> Column:
    """``text`` without the characters ``[\\x20\\x09-\\x0D]``."""
    for c in " \t\n\v\f\r":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def release_memory() -> None:
    """Hand memory that this Python worker has freed back to the machine; its allocators would keep it while the worker idles."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable) -> Callable:
    """An Arrow function after whose last batch the worker keeps no more memory than what is in use."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return whole


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", size_limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size_limit`` bytes of text each, so memory does not follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for k, size in enumerate(sizes):
            if held and held + size > size_limit:
                yield batch.slice(begin, k - begin)
                release_memory()
                begin, held = k, 0
            held += int(size)
        yield batch.slice(begin)
        release_memory()


def quiet_threads() -> None:
    """Keep native libraries of a Python worker on its own core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if pa.cpu_count() != 1:
        pa.set_cpu_count(1)
