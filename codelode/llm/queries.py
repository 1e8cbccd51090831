"""Registered queries of the corpus operators, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from . import ball_tree as _ball
from . import chat as _chat
from . import cover_tree as _cover
from . import exact_dedup as _exact
from . import point_in_time as _features
from .common import table


def op1_line_chunks(spark, sf_dir):
    from .line_chunks import drop_repeated_passages

    return drop_repeated_passages(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    from pyspark.sql import functions as F

    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(toxicity.fold() != 2)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", F.coalesce(toxicity.fold() == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_decontaminate(spark, sf_dir):
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_files(spark, sf_dir):
    from .token_files import token_files

    return token_files(table(spark, sf_dir, "documents"))


def op5_chat(spark, sf_dir):
    return _chat.render(table(spark, sf_dir, "conversations"))


def op6_pii(spark, sf_dir):
    from .pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents"), key="corpus")


def op7_exact_dedup(spark, sf_dir):
    return _exact.exact_dedup(table(spark, sf_dir, "documents")).drop("chain_length")


def op8_jaccard_join(spark, sf_dir):
    from .jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_secrets(spark, sf_dir):
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op13_centroids(spark, sf_dir):
    return _ball.cluster(table(spark, sf_dir, "embeddings"))


def op11_features(spark, sf_dir):
    return _features.features(*(table(spark, sf_dir, name) for name in ("sales", "clicks", "sale_lines")))


def op12_embedding_dedup(spark, sf_dir):
    return _cover.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_line_chunks": op1_line_chunks, "op5_chat": op5_chat, "op6_pii": op6_pii, "op10_secrets": op10_secrets, "op2_toxicity": op2_toxicity, "op3_decontaminate": op3_decontaminate, "op4_token_files": op4_token_files, "op7_exact_dedup": op7_exact_dedup, "op8_jaccard_join": op8_jaccard_join, "op9_packing": op9_packing, "op11_features": op11_features, "op12_embedding_dedup": op12_embedding_dedup, "op13_centroids": op13_centroids}
ORACLES = {"op5_chat": _chat.ORACLE, "op7_exact_dedup": _exact.ORACLE, "op11_features": _features.ORACLE, "op12_embedding_dedup": _cover.ORACLE, "op13_centroids": _ball.ORACLE}
