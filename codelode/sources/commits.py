"""Commit history as a data source: an exported log, read by byte ranges, filtered by path while it is read."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from ..plans.errors import HistoryUnavailable
from .code import _exists

#: What a line with a commit's number starts with, in a log written with ``--name-only --format='commit %H'``.
MARK = b"commit "
#: Bytes of a range, and of one read.
RANGE_BYTES, READ_BYTES = 64 << 20, 1 << 20


class Range(NamedTuple):
    """A file's commits whose first byte lies in [begin, end)."""

    file: str
    begin: int
    end: int


class Part(InputPartition):
    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


def lines_from(handle, begin: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that start at ``begin`` or later."""
    at = max(0, begin - 1)
    handle.seek(at)
    held, first = b"", begin > 0
    while data := handle.read(READ_BYTES):
        held += data
        *whole, held = held.split(b"\n")
        for line in whole:
            if not first:  # what lies before the first line feed began before the range
                yield at, line
            first = False
            at += len(line) + 1
    if held and not first:
        yield at, held


def commits_in(handle, begin: int, end: int) -> Iterator[tuple[str, str]]:
    """(sha, path) of the commits of a range; the last one's paths may lie behind its end."""
    sha = None
    for at, line in lines_from(handle, begin):
        line = line.rstrip(b"\r")
        if line.startswith(MARK):
            if at >= end:
                return
            sha = line[len(MARK) :].decode("utf-8", "replace").strip()
        elif sha is not None and line:
            yield sha, line.decode("utf-8", "replace")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("a commit log needs a path")
        self.path, self.size = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.wanted: list[tuple[str, tuple[str, ...]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on the path are checked here, while lines are read; others are left to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("path",) and isinstance(f, (EqualTo, In, StringStartsWith)):
                values = tuple(f.value) if isinstance(f, In) else (f.value,)
                self.wanted.append(("starts" if isinstance(f, StringStartsWith) else "is", values))
            else:
                yield f

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = [f for f in found if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", "."))]
        ranges = [Range(f.path, at, min(f.size, at + self.size)) for f in files for at in range(0, f.size, self.size)]
        parts: list[list[Range]] = []
        for r in sorted(ranges):  # small files share a partition
            if parts and sum(x.end - x.begin for x in parts[-1]) + r.end - r.begin <= self.size:
                parts[-1].append(r)
            else:
                parts.append([r])
        return [Part(p) for p in parts]

    def read(self, partition: Part) -> Iterator[tuple[str, str]]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if ":" in self.path else fs.LocalFileSystem()
        exact = [frozenset(v) for kind, v in self.wanted if kind == "is"]
        starts = tuple(v for kind, v in self.wanted if kind == "starts")
        for r in partition.ranges:
            with system.open_input_file(r.file) as handle:
                for sha, path in commits_in(handle, r.begin, r.end):
                    if all(path in e for e in exact) and all(path.startswith(s) for s in starts):
                        yield sha, path


class CommitLog(DataSource):
    """``commit_log``: (sha, path) of an exported log. Options: ``path`` (a file or folder, local or a URI), ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        return "sha string, path string"

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_commits(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(sha, path) of every file that a commit touches. No log at the path is an error: it must not look like a file without changes."""
    if not _exists(spark, path):
        raise HistoryUnavailable(f"no commit log at {path}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CommitLog)
    return spark.read.format("commit_log").option("path", path).option("rangeBytes", range_bytes).load()


def write_commits(commits: DataFrame, path: str) -> None:
    """The log of commits (sha, path) as text, a commit's paths behind its number."""
    from pyspark.sql import functions as F

    paths = F.array_join(F.sort_array(F.collect_set("path")), "\n")
    commits.groupBy("sha").agg(F.concat(F.lit(MARK.decode()), F.col("sha"), F.lit("\n\n"), paths, F.lit("\n")).alias("value")).select("value").write.text(path)
