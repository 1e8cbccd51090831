"""N-gram Jaccard join by size: subsets for small sets, inverted lists for large ones.

Sets of distinct word shingles A and B link when ``|A & B| / |A | B|`` reaches the threshold, that is when they
share at least ``o(a, b) = ceil(t / (1 + t) * (a + b))`` shingles. The steps:

1. Texts with equal sets form a class; only its smallest doc_id goes on, copies just take its component.
2. Light: of a set with at most ``boundary`` shingles all subsets of each fixed size ``o(a, m)`` that a partner of
   size ``m <= boundary`` asks for are enumerated. Two sets that share a subset of size o share o shingles, so a
   match is a link. In a list of sets with one subset the smallest set links with whatever any other links with,
   so pairs with it keep the components. Subsets are matched by 64-bit hashes; the pairs are compared as all others.
3. Heavy: pairs with a larger set meet in inverted lists. Under any fixed order of the shingles, linked sets
   share one of the first ``a - ceil(t * a) + 1`` shingles of each, so only those are listed. The order puts
   frequent shingles last, rarest first: each task counts what it sees in several texts, the counts are summed,
   and the ``FREQUENT`` most frequent are known to all tasks (which ones only changes speed, never results).
   A shared shingle counts only if enough shingles follow it in both orders to reach ``o(a, b)``.
4. A list is not expanded into pairs. All its sets are compared with one pivot, the set with fewest rare
   shingles (an original rather than its edited copy). Then components are found. Only lists in which
   several components meet are looked at again: a set outside the pivot's component is paired with the sets of
   other components in its list unless the distances to the pivot rule the pair out (the Jaccard distance is a
   metric), and what is left is compared too. Before that, while it yields links, each such list draws a set by lot
   with which those of other components are compared: in a group of mutual near copies nearly all find the group
   after a few turns, at one pair per set and turn.

Before whole sets of such left-over pairs are compared, the pairs are checked on the first ``2 p`` shingles of each, p being the length listed:
linked sets share at least ``min(p_a, p_b)`` of these, so pairs with fewer are ruled out and their sets never move.

The boundary is the one with the least cost, counted from the number of sets of each size.
Sets are compared as sets of 64-bit shingle hashes, whole. A class is known by its smallest doc_id, so the label of a
component is its smallest doc_id, too. Lists, pivots and classes that hold many rows are split: their rows meet the
one row they need where they are, or copies of it under several salts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, MOST_HOT, discard, join_split, lean, staged, steps, texts_of
from .components import components
from .words import shingle_sets

#: Most frequent shingles that all tasks know: 512 KB.
FREQUENT = 65_536
#: Shingles seen in several texts that one task reports at most (only the order of inverted lists depends on it).
REPORTED = 20_000
#: Largest set that may be light, and the most subsets it may have.
LARGEST_LIGHT, MOST_SUBSETS = 48, 400
#: Cost of one entry of an inverted list, with its share of comparisons, in entries of a subset list.
LIST_COST = 8.0
#: Turns of comparing with sets drawn by lot, and the share of links among a turn's pairs below which no further turn follows.
LOTS, LOT_YIELD = 8, 0.1


def needed(a: int, b: int, num: int, den: int) -> int:
    """Least number of shared shingles of linked sets with ``a`` and ``b`` elements; the threshold is num / den."""
    return -(-num * (a + b) // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def subset_sizes(n: int, boundary: int, num: int, den: int) -> list[int]:
    """Sizes of the subsets that a light set with ``n`` elements lists."""
    return sorted({needed(n, m, num, den) for m in range(-(-num * n // den), min(boundary, n * den // num) + 1)} if n else set())


def choose_boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """Largest light size with the least total cost. sizes: number of sets by number of shingles."""
    costs = {}
    for x in range(LARGEST_LIGHT + 1):
        subsets = {n: sum(comb(n, c) for c in subset_sizes(n, x, num, den)) for n in range(1, x + 1)}
        if max(subsets.values(), default=0) > MOST_SUBSETS:
            break
        light = sum(sizes.get(n, 0) * s for n, s in subsets.items())
        heavy = sum(k * prefix_length(n, num, den) for n, k in sizes.items() if n > 0 and n * den // num > x)
        costs[x] = light + LIST_COST * heavy
    return min(costs, key=lambda x: (costs[x], x))


_FIRST = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def _survey(k: int):
    """Per text: size and digest of its set; per task: shingles seen in several different sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        often: dict[int, int] = {}
        for batch in steps(batches):
            sets = shingle_sets(batch.column("text"), k)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            parts = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            n = len(sets)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(parts[:, 0].copy()), pa.array(parts[:, 1].copy())], schema=_FIRST)
            distinct = list(dict(zip(digests, sets)).values())
            if distinct:
                shingles, count = np.unique(np.concatenate(distinct), return_counts=True)
                some = count > 1
                for s, c in zip(shingles[some].view(np.int64).tolist(), count[some].tolist()):
                    often[s] = often.get(s, 0) + c
                if len(often) > 4 * REPORTED:
                    often = dict(sorted(often.items(), key=lambda x: -x[1])[: 2 * REPORTED])
        if often:
            top = sorted(often.items(), key=lambda x: -x[1])[:REPORTED]
            m = len(top)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.array([s for s, _ in top], pa.int64()), pa.array([c for _, c in top], pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], schema=_FIRST)

    return run


_LISTED = pa.schema([("key", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("n", pa.int64()), ("rare", pa.int64()), ("subsets", pa.list_(pa.int64())), ("subset_sizes", pa.list_(pa.int32())), ("head", pa.list_(pa.int64()))])


def _list(k: int, frequent: np.ndarray, rank: np.ndarray, boundary: int, num: int, den: int):
    """Per text: its set's digest, its subsets if it is light, and its prefix if it may link with a heavy set.

    frequent: sorted hashes of the frequent shingles; rank: their frequency ranks, 0 for the rarest of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in steps(batches):
            rows = []
            for doc_id, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), k)):
                n = len(s)
                if not n or doc_id is None:
                    continue
                at = np.minimum(np.searchsorted(frequent, s), max(0, len(frequent) - 1))
                common = frequent[at] == s if len(frequent) else np.zeros(n, bool)
                rare = int(n - common.sum())
                subsets, sizes, prefix = [], [], []
                if n <= boundary:
                    values = s.tolist()
                    for c in subset_sizes(n, boundary, num, den):
                        for some in combinations(values, c):
                            subsets.append(xxhash.xxh3_64_intdigest(np.array(some, dtype=np.uint64).tobytes(), seed=c))
                            sizes.append(c)
                if n * den // num > boundary:
                    order = np.lexsort((s, np.where(common, rank[at] + 1, 0) if len(frequent) else np.zeros(n)))
                    prefix = s[order[: 2 * prefix_length(n, num, den)]].view(np.int64).tolist()
                low, high = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype="<i8").tolist()
                rows.append((doc_id, low, high, n, rare, np.array(subsets, dtype=np.uint64).view(np.int64).tolist(), sizes, prefix))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LISTED)], schema=_LISTED)

    return run


_SETS = pa.schema([("key", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in steps(batches):
            sets = shingle_sets(batch.column("text"), k)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype="<i8").reshape(-1, 2)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.ListArray.from_arrays(offsets, values)], schema=_SETS)

    return run


def _at_both_ends(pairs: DataFrame, of_key: DataFrame, total: int) -> DataFrame:
    """Pairs (a, b), ``total`` in all, with the columns of ``of_key`` for a (``_a``) and b (``_b``).

    A key in many pairs would gather them in one task: its pairs are dealt over salts, and its row is copied to each.
    """
    limit, out = max(FEW_ROWS, total // MOST_HOT), pairs
    for end, other in (("a", "b"), ("b", "a")):
        degree = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("degree")).filter(F.col("degree") > limit)
        salts = F.broadcast(degree.select(end, F.ceil(F.col("degree") / limit).cast("int").alias("salts")))  # fewer than MOST_HOT rows
        own = of_key.select(F.col("key").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in of_key.columns if c != "key"))
        copies = own.join(salts, end, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        dealt = out.join(salts, end, "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        out = dealt.join(copies.hint("merge"), [end, "salt"]).drop("salt")
    return out


def _near(pairs: DataFrame, total: int, nodes: DataFrame, label: str) -> DataFrame:
    near = _at_both_ends(pairs, nodes.select("key", "head", "listed"), total)
    near = near.filter(F.size(F.array_intersect("head_a", "head_b")) >= F.least("listed_a", "listed_b"))
    return staged(near.select("a", "b"), f"{label}_near")


def _compared(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, several: bool, k: int, label: str, by_heads: bool) -> DataFrame:
    """(a, b, shared, joint) of the pairs of node keys, with ``by_heads`` only of those that their heads don't rule out.

    Only texts in such a pair are shingled again. ``several``: some ids are repeated.
    """
    total = pairs.count()
    given, pairs = pairs, _near(pairs, total, nodes, label) if by_heads else pairs
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = nodes.join(ends, "key", "left_semi").select("key", "low", "high")
    texts = docs.join(wanted.select(F.col("key").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("key"), "text")
    sets = texts.mapInArrow(lean(_sets(k)), "key long, low long, high long, shingles array<long>")
    if several:
        sets = sets.join(wanted, ["key", "low", "high"], "left_semi").dropDuplicates(["key", "low", "high"])
    sets = staged(sets.select("key", "shingles"), f"{label}_sets")
    both = _at_both_ends(pairs, sets, total)
    shared = F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long")
    out = both.select("a", "b", shared.alias("shared"), (F.size("shingles_a") + F.size("shingles_b")).alias("sizes"))
    out = staged(out.select("a", "b", "shared", (F.col("sizes") - F.col("shared")).alias("joint")), f"{label}_compared")
    discard(sets, *([pairs] if by_heads else []))
    return out


def _open_lists(met: DataFrame, label: DataFrame, total: int, staged_as: str) -> DataFrame:
    """Entries, with their component and their pivot's (``home``), of the lists in which several components meet."""
    labelled = met.join(label.withColumnRenamed("node", "key").hint("merge"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    limit, parts = max(FEW_ROWS, total // MOST_HOT), []
    for own, kind in ((F.col("many") > limit, "broadcast"), (F.col("many") <= limit, "merge")):  # fewer than MOST_HOT long lists
        rows = labelled.filter(own)
        spread = rows.groupBy("shingle").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.max(F.when(F.col("key") == F.col("pivot"), F.col("label"))).alias("home"))
        parts.append(rows.join(spread.filter("first < last").select("shingle", "home").hint(kind), "shingle"))
    return staged(parts[0].unionByName(parts[1]), staged_as)


def jaccard_join(docs: DataFrame, threshold: tuple[int, int] = (85, 100), shingle_words: int = 4, id_col: str = "doc_id", text_col: str = "text", boundary: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    The threshold is a fraction num / den, reached by equality too. Null and blank texts have no shingles and
    link with nothing; their component is their own id. A row with a null id gets a null component and links with
    nothing. Rows that repeat an id are all returned; they are one document that links with whatever one of its
    texts links with. An empty table gives an empty result. Extra columns are ignored. ``boundary`` overrides the
    size chosen by cost.
    """
    num, den = threshold
    rows = texts_of(docs, id_col, text_col)
    first = staged(rows.mapInArrow(lean(_survey(shingle_words)), "kind int, doc_id long, n long, low long, high long"), "survey")
    listed = first.filter("kind = 1").drop("kind")
    top = first.filter("kind = 0").groupBy("doc_id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "doc_id").limit(FREQUENT).collect()
    by_hash = sorted((r["doc_id"] % (1 << 64), len(top) - k) for k, r in enumerate(top))
    frequent, rank = np.array([h for h, _ in by_hash], dtype=np.uint64), np.array([r for _, r in by_hash], dtype=np.int64)
    real = listed.filter("n > 0 AND doc_id IS NOT NULL")
    digest = ["n", "low", "high"]
    classes = staged(real.groupBy(*digest).agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("size")), "classes")
    of_id = real.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(*digest)).alias("one"), F.max(F.struct(*digest)).alias("other")).filter("times > 1")
    of_id = staged(of_id.select("doc_id", (F.col("one") < F.col("other")).alias("differ")), "repeated")
    several = not of_id.isEmpty()
    if boundary is None:
        top_size = LARGEST_LIGHT * den // num + 1
        counted = classes.groupBy(F.least("n", F.lit(top_size)).alias("n")).count().collect()  # a row per small size
        boundary = choose_boundary({r[0]: r[1] for r in counted}, num, den)
    marks = rows.mapInArrow(lean(_list(shingle_words, frequent, rank, boundary, num, den)), "key long, low long, high long, n long, rare long, subsets array<long>, subset_sizes array<int>, head array<long>")
    marks = marks.withColumn("listed", F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1)
    nodes = marks.join(classes.select(F.col("class_id").alias("key"), "low", "high"), ["key", "low", "high"])
    nodes = staged(nodes.dropDuplicates(["key", "low", "high"]) if several else nodes, "nodes")
    entry = F.slice("head", F.lit(1), F.col("listed").cast("int"))
    n_subsets, n_entries = (x or 0 for x in nodes.agg(F.sum(F.size("subsets")), F.sum(F.size(entry))).first())

    # Light: sets that share a subset of the size their sizes ask for, each with the smallest.
    sub = nodes.select("key", "n", F.explode(F.arrays_zip("subsets", "subset_sizes")).alias("s")).select("key", F.col("n").cast("long").alias("n"), F.col("s.subsets").alias("subset"), F.col("s.subset_sizes").alias("c"))
    head = sub.groupBy("subset", "c").agg(F.min(F.struct(F.col("n").alias("head_n"), F.col("key").alias("b"))).alias("h"), F.count(F.lit(1)).alias("many")).filter("many > 1").select("subset", "c", "h.*", "many")
    heads = join_split(sub, head, ["subset", "c"], "many", n_subsets)
    fits = F.ceil(F.lit(num) * (F.col("n") + F.col("head_n")) / F.lit(num + den)) <= F.col("c")
    light = heads.filter(fits & (F.col("key") != F.col("b"))).select(F.col("key").alias("a"), "b")

    # Heavy: every set of an inverted list against the list's pivot.
    entries = nodes.select("key", "n", "rare", F.posexplode(entry).alias("at", "shingle"))
    pivots = entries.groupBy("shingle").agg(F.min(F.struct("rare", F.col("key").alias("pivot"), F.col("n").alias("pivot_n"))).alias("p"), F.count(F.lit(1)).alias("many")).filter("many > 1").select("shingle", "p.pivot", "p.pivot_n", "many", F.col("many").alias("size"))
    met = staged(join_split(entries.drop("rare"), pivots, ["shingle"], "size", n_entries), "lists")
    heavy = met.filter((F.col("key") != F.col("pivot")) & (F.least("n", "pivot_n") * den >= F.greatest("n", "pivot_n") * num)).select(F.col("key").alias("a"), F.col("pivot").alias("b"))
    pairs = staged(light.unionByName(heavy).distinct(), "pairs")
    compared = _compared(pairs, rows, nodes, several, shingle_words, "pivot", False)
    linked = F.col("shared") * den >= F.col("joint") * num
    links = compared.filter(linked).select("a", "b")
    if several and not of_id.filter("differ").isEmpty():
        held = real.join(of_id.filter("differ").select("doc_id"), "doc_id", "left_semi").join(classes, digest).select("doc_id", "class_id")
        least = held.groupBy("doc_id").agg(F.min("class_id").alias("b"))
        links = links.unionByName(held.join(least, "doc_id").select(F.col("class_id").alias("a"), "b"))
    label = components(links)

    # A linked pair meets at its first common shingle with enough left behind it in both sets.
    may_link = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) * (num + den) >= (F.col("n_a") + F.col("n_b")) * num

    def joined(found: DataFrame) -> DataFrame:
        """Components after more links: each node with its label, and the new ones."""
        after = components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(found))
        discard(label)
        return after

    # Lists in which components meet, in turns: what is outside a component drawn by lot is compared with the lot's set.
    for turn in range(LOTS):
        open_ = _open_lists(met, label, n_entries, f"open{turn}")
        drawn = open_.groupBy("shingle").agg(F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("lot"), F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("label").alias("label_b"))).alias("d"), F.max("many").alias("size"))
        tried = join_split(open_.withColumnsRenamed({"n": "n_a", "at": "at_a"}), drawn.select("shingle", "d.*", "size"), ["shingle"], "size", n_entries).filter((F.col("label") != F.col("label_b")) & may_link)
        tried = staged(tried.select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b")).distinct(), f"tried{turn}")
        discard(open_)
        n_tried = tried.count()
        if not n_tried:
            break
        found = _compared(tried, rows, nodes, several, shingle_words, f"turn{turn}", True)
        n_found = found.filter(linked).count()
        label = joined(found.filter(linked).select("a", "b"))
        discard(tried, found)
        if n_found < LOT_YIELD * n_tried:
            break

    # What is still apart in a list: compare across components what the distances to the pivot leave open.
    gap = compared.select(F.col("a").alias("key"), F.col("b").alias("pivot"), (1 - F.col("shared") / F.col("joint")).alias("gap"))
    if several:  # a document with several texts has no one distance
        gap = gap.groupBy("key", "pivot").agg(F.when(F.count(F.lit(1)) == 1, F.min("gap")).alias("gap"))
    open_ = _open_lists(met, label, n_entries, "open")
    gapped = open_.join(gap.hint("merge"), ["key", "pivot"], "left").withColumn("gap", F.when(F.col("key") == F.col("pivot"), 0.0).otherwise(F.col("gap")))
    gapped = staged(gapped, "gaps")
    out = gapped.filter("label <> home").select("shingle", F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("label").alias("label_a"), F.col("home").alias("home_a"), F.col("gap").alias("gap_a"))
    every = gapped.filter("key <> pivot").select("shingle", F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("label").alias("label_b"), F.col("gap").alias("gap_b"))
    near = F.coalesce(F.abs(F.col("gap_a") - F.col("gap_b")) <= 1 - num / den + 1e-9, F.lit(True))
    once = (F.col("label_b") == F.col("home_a")) | (F.col("a") < F.col("b"))
    more = out.join(every.hint("merge"), "shingle").filter((F.col("label_a") != F.col("label_b")) & once & may_link & near)
    more = staged(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "more")
    discard(open_, gapped, met, compared)
    if not more.isEmpty():
        found = _compared(more, rows, nodes, several, shingle_words, "across", True)
        label = joined(found.filter(linked).select("a", "b"))
        discard(found)

    named = classes.join(label.withColumnRenamed("node", "class_id").hint("merge"), "class_id", "left")
    named = staged(named.select(*digest, F.coalesce("label", "class_id").alias("component_id"), "size"), "named")
    n_rows = named.agg(F.sum("size")).first()[0] or 0
    discard(classes, of_id, nodes, pairs, more, label)
    linked_rows = join_split(real, named, digest, "size", n_rows).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = listed.filter("NOT (n > 0 AND doc_id IS NOT NULL)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked_rows.unionByName(alone)
