"""Lineage cuts in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in ``spark.checkpoint.dir``; a folder is chosen here only in local mode when none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="codelode-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/codelode/{uuid.uuid4().hex}/{label}"


def settled(df: DataFrame, label: str = "settled") -> DataFrame:
    """``df`` as a table in the shared folder, where its lineage ends."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that a task of costly work on each row gets.
TASK_ROWS = 10_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by its keys, ``TASK_ROWS`` rows a task and never fewer tasks than cores.

    A table of few bytes a row lies in one row group, which one task would read, parse and write however many rows it has.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(tasks, *keys)


def discard(*tables: DataFrame) -> None:
    """Delete the files of settled tables that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
