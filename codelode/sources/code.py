"""Source files, scope, commits and stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.errors import IndexUnavailable

CHUNK_SCHEMA = "file_path string, chunk_type string, name string, start_line int, end_line int, text string, parent_class string"
#: The domain of chunk_type.
CHUNK_TYPES = ("function", "async_function", "class", "method", "module_level", "split")


def scope_table(spark: SparkSession, stems: list[str]) -> DataFrame:
    """(stem, ord) of the files looked at, in the given order; an empty scope is an error."""
    if not stems:
        raise ValueError("the scope names no file")
    return spark.createDataFrame([(s.removesuffix(".py"), k) for k, s in enumerate(dict.fromkeys(stems))], "stem string, ord int")


def relative_path(spark: SparkSession, folder: str):
    """Path of a file read from ``folder``, from the folder on, so that equal names in different folders stay apart."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    top = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    plain = F.try_url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z0-9]+:(?://[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    return F.substring(plain, F.lit(len(top) + 2), F.length(plain))


def read_sources(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(file_path, stem, source) of the Python files in a folder; with ``recursive`` also below it, the stem being the dotted module name."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.py").option("recursiveFileLookup", recursive).text(folder)
    path = relative_path(spark, folder)
    return raw.select(path.alias("file_path"), module_of(path).alias("stem"), F.col("value").alias("source"))


def in_scope(files: DataFrame, scope: DataFrame) -> DataFrame:
    return files.join(scope, "stem", "left_semi")


def with_suffix(name):
    """File name with .py."""
    return F.when(name.endswith(".py"), name).otherwise(F.concat(name, F.lit(".py")))


def module_of(path):
    """Dotted module name of a file path, the one rule for sources, imports and commits."""
    return F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))


def commit_counts(commits: DataFrame, scope: DataFrame, root: str = "") -> DataFrame:
    """(stem, commit_count) for all of scope; commits: (sha, path), paths being whole and those of the code base below ``root``.

    A commit counts for the file at exactly that path, not for one of the same name in another folder. Files without a
    commit count 0; no history at all is an error where it is read.
    """
    own = commits.filter(F.col("path").startswith(root) & F.col("path").endswith(".py"))
    counted = own.groupBy(module_of(F.expr(f"substring(path, {len(root) + 1})")).alias("stem")).agg(F.count_distinct("sha").alias("commit_count"))
    return scope.join(counted.hint("merge"), "stem", "left").select("stem", F.coalesce("commit_count", F.lit(0)).alias("commit_count"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def add_chunks(spark: SparkSession, chunks: DataFrame, path: str, reset: bool = False) -> DataFrame:
    """Write chunks, one row an id, by chunk_id; without ``reset`` ids that are there already stay as they are."""
    once = chunks.dropDuplicates(["chunk_id"])
    if reset or not _exists(spark, path):
        once.write.mode("overwrite").parquet(path)
    else:
        once.join(spark.read.parquet(path).select("chunk_id"), "chunk_id", "left_anti").write.mode("append").parquet(path)
    return spark.read.parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table; without one an error that may pass once it is built."""
    if not _exists(spark, path):
        raise IndexUnavailable(f"no chunk table at {path}")
    return spark.read.parquet(path)


def read_queries(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Labelled queries from JSON lines. A must-mention entry is a term or a list of terms; all become lists."""
    schema = "id string, category string, query string, intent string, gold array<string>, must_mention array<string>, target_files array<string>, expect string"
    rows = spark.read.schema(schema).json(path)
    terms = F.transform("must_mention", lambda m: F.coalesce(F.from_json(m, "array<string>"), F.array(m)))
    rows = rows.withColumn("must_mention", terms)
    return rows.orderBy("id").limit(limit) if limit is not None else rows


def write_rows(df: DataFrame, path: str) -> None:
    """JSON lines, one object a row, in the order of ids."""
    (df.orderBy("id") if "id" in df.columns else df).write.mode("overwrite").json(path)


def write_report(tables: dict[str, DataFrame], path: str) -> str:
    """Small result tables (rates, sums, risk by dependents) as Markdown; the text is returned and written as one text file."""
    out = []
    for title, df in tables.items():
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in df.toLocalIterator()] + [""]
    text = "\n".join(out)
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def resumable(spark: SparkSession, path: str, make) -> DataFrame:
    """A stage's table: read if it was written before, else made and written."""
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
