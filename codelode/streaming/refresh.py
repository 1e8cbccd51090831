"""Refresh of the chunk table by content, and from a directory of source files as a stream.

A version of the table is a manifest of files, each with the digest of its source and the version in which its chunks
were written. A refresh compares the folder with the newest manifest and writes chunks of what is new or edited only;
then the next manifest, without what is deleted. The manifest comes last, so a run that is killed changes nothing, and
the next one writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import chunks
from ..operators.shared import discard, settled
from ..sources.code import _exists, read_sources, relative_path

MANIFEST = "file_path string, digest string, version long"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that were written to their end, in order."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [e.getPath().getName() for e in system.listStatus(at)] if system.exists(at) else []
    return sorted(int(n.removeprefix("v=")) for n in names if n.startswith("v=") and _exists(spark, f"{path}/manifest/{n}/_SUCCESS"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(file_path, digest, version) of a version, the newest unless given; before the first there is none."""
    done = versions(spark, path)
    if not done:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v={done[-1] if version is None else version}")


def refresh_folder(spark: SparkSession, folder: str, path: str, recursive: bool = False) -> int:
    """Brings the chunk table up to what the folder's Python files hold now; the newest version, a new one only if something changed.

    New and edited files get new chunks, emptied ones have none, deleted ones go; a file whose time alone changed stays as it is.
    """
    done = versions(spark, path)
    number = (done[-1] if done else -1) + 1
    now = read_sources(spark, folder, recursive).withColumn("digest", F.sha2("source", 256))
    old = manifest(spark, path)
    same = now.select("file_path", "digest").join(old, ["file_path", "digest"])
    changed = now.join(old.select("file_path", "digest"), ["file_path", "digest"], "left_anti")
    gone = old.join(now.select("file_path"), "file_path", "left_anti")
    if done and changed.isEmpty() and gone.isEmpty():
        return done[-1]
    changed = settled(changed, "changed")  # read once, so that chunks and digests are of the same source
    chunks(changed.select("file_path", "source")).write.mode("overwrite").parquet(f"{path}/chunks/v={number}")
    listed = same.unionByName(changed.select("file_path", "digest", F.lit(number).cast("long").alias("version")))
    listed.select("file_path", "digest", "version").write.mode("overwrite").parquet(f"{path}/manifest/v={number}")
    discard(changed)
    return number


def refresh_chunks(spark: SparkSession, folder: str, path: str, checkpoint: str):
    """Start a query that refreshes the table whenever files of the folder are new or have another time."""
    files = spark.readStream.schema("value string").option("wholetext", True).option("pathGlobFilter", "*.py").text(folder)
    named = files.select(relative_path(spark, folder).alias("file_path"))

    def write(batch: DataFrame, number: int) -> None:
        refresh_folder(batch.sparkSession, folder, path)

    return named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_chunks(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The chunks of all files of a version, the newest unless given, with the version that wrote them."""
    listed = manifest(spark, path, version)
    written = [f"{path}/chunks/v={r[0]}" for r in listed.select("version").distinct().collect()]  # a row a version
    if not written:
        return chunks(spark.createDataFrame([], "file_path string, source string")).withColumn("version", F.lit(None).cast("long"))
    every = spark.read.option("basePath", f"{path}/chunks").parquet(*written).withColumn("version", F.col("v").cast("long")).drop("v")
    return every.join(listed.select("file_path", "version"), ["file_path", "version"], "left_semi")
