"""What is known of code bases, kept between questions: facts file by file, tables by the fingerprint of their inputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import graph, retrieval
from .ask import CodeBase


def with_digest(files: DataFrame) -> DataFrame:
    """Files with the digest of their source, a null one being empty."""
    return files.withColumn("digest", F.sha2(F.coalesce("source", F.lit("")), 256))


def fingerprint(rows: DataFrame, *columns: str) -> str:
    """A digest of rows, whatever their order: their number, and sums of two hashes of the columns."""
    hashes = [F.sum(F.xxhash64(F.lit(k), *columns).cast("decimal(38,0)")).cast("string") for k in (1, 2)]
    return rows.agg(F.sha2(F.concat_ws("/", F.count(F.lit(1)).cast("string"), *(F.coalesce(h, F.lit("0")) for h in hashes)), 256)).first()[0]


class Catalog:
    """Tables below a folder that the cluster shares, each complete or not there: a killed run leaves none behind that is read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _system(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def complete(self, name: str) -> list[str]:
        """Folders of the name's tables that were written to their end, the oldest first."""
        system, at = self._system(f"{self.path}/{name}")
        if not system.exists(at):
            return []
        done = []
        for entry in system.listStatus(at):
            ok = self._system(f"{entry.getPath()}/_SUCCESS")[1]
            if system.exists(ok):
                done.append((system.getFileStatus(ok).getModificationTime(), str(entry.getPath())))
        return [p for _, p in sorted(done)]

    def table(self, name: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of that name and key: read if it is there, else made and written."""
        path = f"{self.path}/{name}/{key}"
        system, ok = self._system(f"{path}/_SUCCESS")
        if not system.exists(ok):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def forget(self, name: str, keep: int) -> int:
        """Deletes all but the newest tables of a name; how many went. For facts this forgets what their runs parsed."""
        old = self.complete(name)[: -keep or None]
        for path in old:
            system, at = self._system(path)
            system.delete(at, True)
        return len(old)

    def facts(self, files: DataFrame) -> DataFrame:
        """What the files (file_path, source) say. Only files that no run has parsed with the same source are parsed now."""
        now = with_digest(files).select("file_path", "source", "digest")
        runs = self.complete("facts")
        known = self.spark.read.parquet(*runs).select("file_path", "digest").distinct() if runs else None
        new = now if known is None else now.join(known, ["file_path", "digest"], "left_anti")
        if not new.isEmpty():
            new = self.table("sources", uuid.uuid4().hex, lambda: new)
            parsed = parse.facts(new).join(new.select("file_path", "digest"), "file_path")
            # A file that says nothing is known too.
            silent = new.select("file_path", "digest").join(parsed.select("file_path").distinct(), "file_path", "left_anti").withColumn("what", F.lit("nothing"))
            self.table("facts", uuid.uuid4().hex, lambda: parsed.unionByName(silent, allowMissingColumns=True))
            runs = self.complete("facts")
            self.forget("sources", 0)
        if not runs:
            return parse.facts(files.limit(0))
        every = self.spark.read.parquet(*runs).filter("what <> 'nothing'")
        return every.join(now.select("file_path", "digest"), ["file_path", "digest"], "left_semi").select(*parse.facts(files.limit(0)).columns)

    def code_base(self, files: DataFrame, scope: DataFrame, commits: DataFrame, embed) -> CodeBase:
        """All that questions need, made once for each state of files, scope and commits (stem, commit_count)."""
        facts = self.facts(files)
        of_files = fingerprint(with_digest(files), "file_path", "digest")
        of_risk = f"{of_files[:32]}-{fingerprint(scope, 'stem')[:16]}-{fingerprint(commits, 'stem', 'commit_count')[:16]}"
        classes, imports = parse.classes(facts), parse.imports(facts)
        risk = self.table("risk", of_risk, lambda: graph.risk_scores(graph.import_edges(imports, scope), scope, commits))
        calls = self.table("calls", of_files, lambda: graph.call_graph(parse.call_sites(facts), parse.definitions(facts), classes, imports)[0])
        index = self.table("index", of_files, lambda: retrieval.chunk_index(parse.chunks(files), embed))
        return CodeBase(scope, risk, graph.class_to_file(classes), index, calls)
