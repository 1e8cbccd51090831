"""Chat formatting after collapsing cumulative snapshots (DataFrame operations only).

Logs often hold a conversation several times, each time with more turns. The hash of the first k turns is the sum
of two 64-bit hashes of each turn with its number, so prefixes roll: sums over blocks of turns are added up first,
then turns within a block, and no task needs a whole conversation. A conversation whose own (k, hash) is that of a
proper prefix of another is a snapshot of it: an anti-join with the proper prefixes of all conversations keeps the
others. Of equal conversations the smallest id stays. What remains is rendered turn by turn, with each turn's place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, staged

#: Turns whose prefixes one window task adds up.
BLOCK_TURNS = 256
#: Text before and after each turn.
BEFORE, AFTER = "<|im_start|>", "<|im_end|>\n"


def _turns(conversations: DataFrame, names: tuple[str, str, str, str]) -> DataFrame:
    conv, turn, role, text = (conversations[n] for n in names)
    return conversations.select(
        conv.cast("long").alias("conv_id"),
        F.coalesce(turn.cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(role.cast("string"), F.lit("")).alias("role"),
        F.coalesce(text.cast("string"), F.lit("")).alias("text"),
    )


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, n, own, h1, h2, total): rows and hash sums of each conversation up to each turn, rows of that turn and of all.

    Turns are added up within blocks and blocks before them, so that a conversation of any length is no one task's.
    """
    known = turns.filter("conv_id IS NOT NULL")
    hashed = known.select("conv_id", "turn", *(F.xxhash64(F.lit(k), "turn", "role", "text").cast("decimal(38,0)").alias(f"h{k}") for k in (1, 2)))
    each = staged(hashed.groupBy("conv_id", "turn").agg(F.sum("h1").alias("h1"), F.sum("h2").alias("h2"), F.count(F.lit(1)).alias("n")), "turn_hashes")
    each = each.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    summed = ("h1", "h2", "n")
    own = Window.partitionBy("conv_id")
    before = own.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = each.groupBy("conv_id", "block").agg(*(F.sum(c).alias(c) for c in summed))
    blocks = blocks.select("conv_id", "block", F.sum("n").over(own).alias("total"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in summed))
    within = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    upto = ((F.sum(c).over(within) + F.col(f"{c}_before")).cast("decimal(38,0)").alias(c) for c in ("h1", "h2"))
    return each.join(blocks.hint("merge"), ["conv_id", "block"]).select("conv_id", "turn", F.col("n").alias("own"), "total", *upto, (F.sum("n").over(within) + F.col("n_before")).alias("n"))


def maximal(known: DataFrame) -> DataFrame:
    """(conv_id) of the conversations, of those whose ``prefixes`` are given, that are neither a prefix of a longer one nor equal to one with a smaller id."""
    key = ["n", "h1", "h2"]
    whole = known.filter("n = total").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    proper = known.filter("n < total").select(*key).distinct()
    return whole.join(proper.hint("merge"), key, "left_anti").select("conv_id")


def render(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn of each maximal conversation: conv_id, turn, place, segment. The segments by place, from 1 on, are the formatted text.

    Null roles and texts count as empty, a null turn stands before all others (as -1); rows that share a turn number
    are one turn for the comparison and each rendered, in the order of role and text. Rows without a conversation id
    are left out. An empty table gives an empty result. Extra columns are ignored.
    """
    turns = _turns(conversations, (conv_col, turn_col, role_col, text_col))
    known = staged(prefixes(turns), "prefixes")
    kept = staged(known.join(maximal(known).hint("merge"), "conv_id", "left_semi").select("conv_id", "turn", (F.col("n") - F.col("own")).alias("before")), "maximal")
    discard(known)
    segment = F.concat(F.lit(BEFORE), F.col("role"), F.lit("\n"), F.col("text"), F.lit(AFTER))
    tied = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    return turns.join(kept.hint("merge"), ["conv_id", "turn"]).select("conv_id", "turn", (F.col("before") + tied).cast("long").alias("place"), segment.alias("segment"))


ORACLE = r"""
WITH t AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, turn, string_agg(concat(turn, chr(1), role, chr(2), text), chr(3)) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prefix, count(*) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
whole AS (SELECT conv_id, prefix, n FROM p WHERE k = n),
kept AS (SELECT min(conv_id) AS conv_id FROM whole WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.prefix = whole.prefix AND p.n > whole.n) GROUP BY prefix)
SELECT t.conv_id, t.turn, row_number() OVER (PARTITION BY t.conv_id ORDER BY turn, role, text) AS place, concat('<|im_start|>', t.role, chr(10), t.text, '<|im_end|>', chr(10)) AS segment FROM t JOIN kept ON t.conv_id = kept.conv_id
"""
