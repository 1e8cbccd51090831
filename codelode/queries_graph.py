"""Queries of dependents at size and of class hierarchies, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import parse
from .operators import graph
from .operators.shared import settled


def _base():
    from . import queries

    return queries


def risk_levels(spark, sf):
    """Scores of a code base with a file for every part, from counts of dependents alone."""
    q = _base()
    scope = q._scope(spark, sf)
    edges = settled(graph.import_edges(parse.imports(q._facts(spark, sf, "import")), scope), "edges")
    out = graph.risk_table(graph.risk_levels(edges, scope, q._commits(spark, sf)))
    return out.select("file", F.col("dependents").cast("long").alias("dependents"), "commit_count", "risk_level")


def import_walks(spark, sf):
    """The code base with its imports made relative: what the walk for the graph and the one for checks find in it."""
    q = _base()
    relative = F.regexp_replace(F.regexp_replace("source", "(?m)^(\\s*)import m", "$1from . import m"), "from m", "from .m")
    files = settled(q._files(spark, sf).withColumn("source", relative), "relative")
    return graph.import_walks(parse.imports(parse.facts(files, kinds=("import",))), parse.relative_imports(files))


def _supply(spark, sf):
    """Parts of one order as steps from the smaller to the larger key, and back for every hundredth: paths, hubs and cycles."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_orderkey % 20 = 0").select("l_orderkey", F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("n"))
    pairs = li.join(li.select("l_orderkey", F.col("k").alias("to"), (F.col("n") - 1).alias("n")), ["l_orderkey", "n"]).filter("k <> to")
    low, high = F.least("k", "to"), F.greatest("k", "to")
    turned = F.col("l_orderkey") % 2_000 == 0
    return pairs.select(F.when(turned, high).otherwise(low).cast("string").alias("src"), F.when(turned, low).otherwise(high).cast("string").alias("dst")).distinct()


def dependent_counts(spark, sf):
    scope = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").cast("string").alias("stem"))
    return graph.dependent_counts(settled(_supply(spark, sf), "supply"), scope)


def dependents_of(spark, sf):
    """The dependents, by name, of every hundredth part."""
    asked = spark.read.parquet(f"{sf}/part.parquet").filter("p_partkey % 100 = 0").select(F.col("p_partkey").cast("string").alias("stem"))
    found = graph.dependents_of(settled(_supply(spark, sf), "supply"), asked)
    return found.select("stem", F.array_join("dependent_files", ",").alias("dependent_files"))


QUERIES = {f.__name__: f for f in (risk_levels, dependent_counts, dependents_of, import_walks)}


def oracles(risk: str, code: str) -> dict[str, str]:
    """SQL by query; ``code`` and ``risk``: the common tables of the code base, without and with its scores."""
    supply = """RECURSIVE li AS (SELECT l_orderkey AS o, l_partkey AS k, l_linenumber AS n FROM lineitem WHERE l_orderkey % 20 = 0),
p AS (SELECT DISTINCT CASE WHEN a.o % 2000 = 0 THEN greatest(a.k, b.k) ELSE least(a.k, b.k) END AS src, CASE WHEN a.o % 2000 = 0 THEN least(a.k, b.k) ELSE greatest(a.k, b.k) END AS dst FROM li a JOIN li b ON a.o = b.o AND b.n = a.n + 1 WHERE a.k <> b.k),
r AS (SELECT src, dst FROM p UNION SELECT r.src, p.dst FROM r JOIN p ON r.dst = p.src)"""
    return {
        "risk_levels": f"WITH {risk} SELECT 'm' || k AS file, dependents, commits AS commit_count, risk_level FROM lev",
        "import_walks": f"""WITH {code} SELECT 'm' || k AS stem, unnest(['os', 'typing']) AS module, 'first' AS seen_by FROM k UNION ALL SELECT 'm' || k, 'sys', 'first' FROM k WHERE k % 16 <> 0
UNION ALL SELECT 'm' || k, 'm' || 2 * k, 'second' FROM k WHERE k % 16 = 0 UNION ALL SELECT 'm' || k, CASE WHEN k = 1 THEN 'm1' ELSE 'm' || h END, CASE WHEN k = 1 THEN 'second' ELSE 'both' END FROM k""",
        "dependent_counts": f"WITH {supply} SELECT p_partkey::VARCHAR AS stem, coalesce(n, 0) AS dependents FROM part LEFT JOIN (SELECT dst, count(*) AS n FROM r WHERE src <> dst GROUP BY dst) ON dst = p_partkey",
        "dependents_of": f"WITH {supply} SELECT p_partkey::VARCHAR AS stem, coalesce(f, '') AS dependent_files FROM part LEFT JOIN (SELECT dst, string_agg(src::VARCHAR, ',' ORDER BY src::VARCHAR) AS f FROM r WHERE src <> dst GROUP BY dst) ON dst = p_partkey WHERE p_partkey % 100 = 0",
    }
