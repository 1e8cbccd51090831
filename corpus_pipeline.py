"""Corpus pipeline: toxicity filter, exact and near deduplication, benchmark decontamination, packing.

Stages work on rows, not on ids: null and repeated ids are deduplicated like others, and whatever columns the documents
have are kept up to the last stage. Null texts count as empty. An empty table goes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import decontaminate, exact_dedup, jaccard_join, packing, toxicity
from codelode.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones outside the held-out fold, doesn't reject.

    Null and empty texts have the score of the intercept, which rejects them only if most labelled texts are toxic.
    Copies are judged alike. Without labels of both kinds no document stands out and the share of toxic ones decides.
    """
    labels = table(spark, sf_dir, "labels").filter(toxicity.fold() != 2)
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


#: Number of a row in a stage's input.
ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row: its id if no id is null or repeated, else its place in a copy written for that."""
    number = F.col("doc_id").cast("long")
    shared = docs.select(number.alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id IS NULL")
    if shared.isEmpty():
        return docs.withColumn(ROW, number)
    return staged(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _keep(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Rows whose number is in ``numbers``, without it."""
    return rows.join(numbers.hint("merge"), ROW, "left_semi").drop(ROW).select(*(c for c in rows.columns if c != ROW))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest of equal texts, one row each: of as long ones the first, with ids before without, in the order of ids.

    Null, empty and blank texts are equal, so one row of them stays. Rows that repeat id and text leave one row.
    """
    rows = _numbered(docs)
    kept = exact_dedup.exact_dedup(rows, row_col=ROW).filter("kept")
    best = kept.groupBy("text_sha256").agg(F.max(F.struct("points", (-F.col(ROW)).alias("minus_row"))).alias("best"))
    return _keep(rows, best.select((-F.col("best.minus_row")).alias(ROW)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of linked texts, one row each; null ids come last, then rows go first come.

    Links are a Jaccard similarity of 0.8 or more on five-word shingles. Texts without words link with nothing and stay.
    """
    rows = _numbered(docs)
    linked = jaccard_join.jaccard_join(rows, threshold=(80, 100), shingle_words=5, id_col=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    named = linked.join(rows.select(ROW, F.col("doc_id").cast("long").alias("doc_id")).hint("merge"), ROW)
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW)).alias("best"))
    return _keep(rows, best.select(F.col(f"best.{ROW}").alias(ROW)))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, copies go or stay alike."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids; null and empty texts are a piece of the end id alone, every row is packed for itself."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("pack", pack),
]

#: A trained classifier, a tokenizer and best-fit packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as Parquet and reread: the packed pieces of what is left.

    Tables that only earlier stages read stay in the shared folder until the run is thrown away, so that a lost executor
    costs no stage.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
