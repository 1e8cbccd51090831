"""Vector search, deduplication by identity, boost, reassembly, expansion and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.metrics import base_name, chunk_id, citation, part_number
from .shared import settled

TOP_K, OVERFETCH = 3, 4


#: Query vectors that one pass over all vectors answers; a block is sent to the tasks.
QUERY_BLOCK = 1_024
#: Distances that a task holds at a time, per dimension.
HELD = 1 << 20


class _Nearest:
    """The k nearest to each of some queries of all vectors that were shown, ties by id: rows (q, d, ids) in the order of query, distance and id."""

    def __init__(self, queries, k: int, held: int):
        import numpy as np

        self.queries, self.k, self.norms = queries, k, (queries * queries).sum(axis=1)
        #: Vectors that are measured at a time.
        self.step = max(1, held // max(1, queries.shape[1]))
        self.q, self.d, self.ids = np.zeros(0, np.int64), np.zeros(0), None
        #: Beyond this distance nothing is among the k nearest any more.
        self.limit = np.full(len(queries), np.inf)

    def measure(self, part, ids) -> None:
        """One product for all queries leaves the few that can be among the k nearest; these are measured exactly."""
        import numpy as np

        norms = (part * part).sum(axis=1)
        rough = self.queries @ part.T
        rough *= -2
        rough += norms
        rough += self.norms[:, None]
        slack = 4e-12 * (self.norms + norms.max(initial=0, where=np.isfinite(norms)))
        near = ~(rough > (self.limit + slack)[:, None])  # what is no number is measured too
        many = np.flatnonzero(near.sum(axis=1) > 4 * self.k)
        if len(many):
            nth = min(self.k, len(part)) - 1
            limit = np.partition(rough[many], nth, axis=1)[:, nth] + slack[many]
            near[many] &= ~(rough[many] > limit[:, None])
        q, row = np.nonzero(near)
        for at in range(0, len(q), self.step):
            some = slice(at, at + self.step)
            self._keep(q[some], ((part[row[some]] - self.queries[q[some]]) ** 2).sum(axis=1), ids[row[some]])

    def _keep(self, q, d, ids) -> None:
        import numpy as np

        asked = np.zeros(len(self.queries), bool)
        asked[q] = True
        old = asked[self.q]
        if self.ids is None:
            self.ids = ids[:0]
        q, d, ids = np.r_[self.q[old], q], np.r_[self.d[old], d], np.r_[self.ids[old], ids]
        order = np.lexsort([ids, d, q])
        q, d, ids = q[order], d[order], ids[order]
        first = np.r_[True, q[1:] != q[:-1]]
        place = np.arange(len(q)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        full = place == self.k - 1
        self.limit[q[full]] = d[full]
        kept = place < self.k
        self.q, self.d, self.ids = np.r_[self.q[~old], q[kept]], np.r_[self.d[~old], d[kept]], np.r_[self.ids[~old], ids[kept]]


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = TOP_K * OVERFETCH, query_id: str = "query_id", id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, id, distance, rank): the k nearest by exact squared L2, ties by id.

    Queries are taken in blocks of a bounded size, each against all vectors: every task keeps the k best of its own
    rows for each query, and these few are ranked. Null vectors, and those of another length than the query, have no distance.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    fields = {f.name: f.dataType.simpleString() for f in (*vectors.schema.fields, *queries.schema.fields)}
    schema = f"`{query_id}` {fields[query_id]}, `{id_col}` {fields[id_col]}, distance double"
    named = queries.filter(F.col(column).isNotNull()).select(query_id, column)
    block: list = []
    out = spark.createDataFrame([], schema)

    def answered(rows: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], [np.asarray(r[1], dtype=np.float64) for r in rows]))

        def run(batches):
            names, wanted = sent.value
            asking = {dim: [j for j, q in enumerate(wanted) if len(q) == dim] for dim in {len(q) for q in wanted}}
            best = {dim: _Nearest(np.stack([wanted[j] for j in of]), k, HELD) for dim, of in asking.items()}
            for batch in batches:
                kept = batch.filter(batch.column(1).is_valid())
                ids, arrays = kept.column(0).to_numpy(zero_copy_only=False), kept.column(1)
                sizes = np.diff(arrays.offsets.to_numpy())
                values = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                starts = np.cumsum(sizes) - sizes
                for dim, nearest in best.items():
                    own = np.flatnonzero(sizes == dim)
                    step = max(1, HELD // max(len(asking[dim]), dim, 1))
                    with np.errstate(invalid="ignore"):
                        for at in range(0, len(own), step):
                            some = own[at : at + step]
                            nearest.measure(values[starts[some][:, None] + np.arange(dim)], ids[some])
            for dim, nearest in best.items():
                if len(nearest.d):
                    said = pa.array([names[asking[dim][j]] for j in nearest.q])
                    yield pa.RecordBatch.from_arrays([said, pa.array(nearest.ids), pa.array(nearest.d, pa.float64())], names=[query_id, id_col, "distance"])

        return vectors.select(id_col, column).mapInArrow(run, schema)

    for row in named.toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            out, block = out.unionByName(answered(block)), []
    if block:
        out = out.unionByName(answered(block))
    w = Window.partitionBy(query_id).orderBy("distance", id_col)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def distinct_topk(queries: DataFrame, vectors: DataFrame, k: int = TOP_K * OVERFETCH, query_id: str = "query_id", id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """What ``vector_topk`` finds, for tables with many equal vectors: these are compared once, on both sides.

    The smallest id stands for its equals. The k nearest of those that stand for others hold the k nearest of all among
    their equals, of whom no more than the k smallest ids count. ``vectors`` are read twice, to be sorted.
    """
    numbered = lambda df, name: df.filter(F.col(column).isNotNull()).select(name, column).withColumn("__n", F.monotonically_increasing_id())
    same = Window.partitionBy(F.xxhash64(column), column).orderBy("__n")
    alone = F.when(F.col("__as") == F.col("__n"), F.col(column)).alias(column)
    # Numbers follow the order of the ids, so that ties by number are ties by id.
    placed = numbered(vectors.orderBy(id_col), id_col).withColumn("__place", F.row_number().over(same)).filter(F.col("__place") <= k)
    held = settled(placed.withColumn("__as", F.first("__n").over(same)).select(id_col, "__n", "__as", alone), "vectors")
    asked = settled(numbered(queries, query_id).withColumn("__as", F.first("__n").over(same)).select(query_id, F.col("__n").alias("__q"), F.col("__as").alias("__asks"), alone), "asked")
    found = vector_topk(asked.filter(F.col(column).isNotNull()), held.filter(F.col(column).isNotNull()), k, "__q", "__n", column)
    members = held.select(F.col("__as").alias("__n"), id_col)
    each = found.select(F.col("__q").alias("__asks"), "__n", "distance").join(members.hint("merge"), "__n").drop("__n")
    nearest = each.withColumn("__r", F.row_number().over(Window.partitionBy("__asks").orderBy("distance", id_col))).filter(F.col("__r") <= k)
    out = asked.select(query_id, "__asks").join(nearest.hint("merge"), "__asks").select(query_id, id_col, "distance")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy("distance", id_col))).filter(F.col("rank") <= k)


def dedupe_then_cut(hits: DataFrame, identity: list[str], k: int = TOP_K, query_id: str = "query_id", rank: str = "rank") -> DataFrame:
    """The best hit of each identity over all hits, then the k best of these, with their place."""
    first = hits.withColumn("__r", F.row_number().over(Window.partitionBy(query_id, *identity).orderBy(rank))).filter("__r = 1").drop("__r")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(query_id).orderBy(rank))).filter(F.col("place") <= k)


def boost(hits: DataFrame, chosen: DataFrame, question: str, identifier: str, identity: list[str], query_id: str = "query_id", rank: str = "rank", whole_words: bool = False) -> DataFrame:
    """The first hit whose identifier the question holds, unless it is chosen already; at most one per question."""
    named = F.col(question).contains(F.col(identifier))
    if whole_words:
        named = named & F.regexp_like(F.col(question), F.concat(F.lit(r"(?<![\w.])\Q"), F.col(identifier), F.lit(r"\E(?!\w)")))
    first = hits.filter(F.col(identifier).isNotNull() & named).withColumn("__r", F.row_number().over(Window.partitionBy(query_id).orderBy(rank))).filter("__r = 1").drop("__r")
    left, right = first.alias("l"), chosen.select(query_id, *identity).alias("r")
    same = F.col(f"l.{query_id}") == F.col(f"r.{query_id}")
    for c in identity:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.join(right, same, "left_anti")


IDENTITY = ["file_path", "parent_class", "base_name"]


def with_parts(chunks: DataFrame) -> DataFrame:
    """Chunks with the identity they are parts of (base_name) and their part's number."""
    return chunks.withColumns({"base_name": base_name(F.col("name")), "part_no": part_number(F.col("name"))})


def chunk_index(chunks: DataFrame, embed=None) -> DataFrame:
    """Chunks with a stable id, counted within their file by place, and a vector of their text; ``embed`` maps a column to one, without it there are none."""
    place = F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "name")) - 1
    parent = F.coalesce("parent_class", F.lit(""))
    return with_parts(chunks).withColumns({"chunk_id": chunk_id(F.col("file_path"), F.col("name"), F.col("start_line"), place), "parent_class": parent, **({"embedding": embed(F.col("text"))} if embed else {})})


def chunks_where(index: DataFrame, file_path: str, parent_class: str | None, name: str) -> DataFrame:
    """The parts of one definition: by equal metadata, then by base name."""
    return index.filter((F.col("file_path") == file_path) & (F.col("parent_class") == (parent_class or ""))).filter(F.col("base_name") == name)


def node_of(file_path: Column, parent_class: Column, name: Column) -> Column:
    return F.concat(file_path, F.lit("::"), F.when(parent_class != "", F.concat(parent_class, F.lit("."))).otherwise(""), name)


def node_parts(node: Column) -> dict[str, Column]:
    """File, class (empty for none) and name of a node: split at the first ``::``, then at the first dot."""
    file, rest = (F.coalesce(F.get(F.split(node, "::", 2), F.lit(k)), F.lit("")) for k in (0, 1))
    dotted = rest.contains(".")
    at = lambda k: F.coalesce(F.get(F.split(rest, r"\.", 2), F.lit(k)), F.lit(""))
    return {"file_path": file, "parent_class": F.when(dotted, at(0)).otherwise(""), "base_name": F.when(dotted, at(1)).otherwise(rest)}


def reassemble(parts: DataFrame, keys: list[str], text: str = "text", part_no: str = "part_no", start: str = "start_line", end: str = "end_line") -> DataFrame:
    """One row per identity: texts joined in part order, first start, last end. Lines that parts share stay repeated."""
    order = F.struct(part_no, start)
    held = F.array_sort(F.collect_list(F.struct(F.col(part_no).alias("p"), F.col(start).alias("s"), F.col(text).alias("t"))))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(held, lambda x: x["t"]), "\n").alias("text"), F.min_by(start, order).alias("start_line"), F.max_by(end, order).alias("end_line"))


def whole_chunks(identities: DataFrame, index: DataFrame) -> DataFrame:
    """Identities (with whatever columns they have) joined to the whole text of their parts; those without chunks drop out."""
    parts = reassemble(index.join(identities.select(*IDENTITY).distinct(), IDENTITY, "left_semi"), IDENTITY)
    return identities.join(parts, IDENTITY)


def expand(primary: DataFrame, call_edges: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query_id, identity, place) of what the primaries call, one step, without the primaries themselves; place is the first caller's."""
    callers = primary.select(query_id, "place", node_of(F.col("file_path"), F.col("parent_class"), F.col("base_name")).alias("caller"))
    called = callers.join(call_edges, "caller").groupBy(query_id, F.col("callee").alias("node")).agg(F.min("place").alias("place"))
    return called.select(query_id, "place", *(c.alias(n) for n, c in node_parts(F.col("node")).items())).join(primary.select(query_id, *IDENTITY), [query_id, *IDENTITY], "left_anti")


def retrieve(questions: DataFrame, index: DataFrame, call_edges: DataFrame, embed, query_id: str = "question_id") -> DataFrame:
    """(query_id, section, place, identity, text, start_line, end_line): primaries (section 0), then what they call (1).

    Nearest chunks, one per identity over the whole window, the best few, the one named in the question besides,
    each put together from its parts.
    """
    asked = questions.select(query_id, "question", embed(F.col("question")).alias("embedding"))
    hits = settled(distinct_topk(asked, index, query_id=query_id, id_col="chunk_id").join(index.select("chunk_id", *IDENTITY), "chunk_id"), "hits")
    chosen = dedupe_then_cut(hits, IDENTITY, query_id=query_id).select(query_id, "place", *IDENTITY)
    named = F.when(F.col("parent_class") != "", F.concat_ws(".", "parent_class", "base_name"))
    put = boost(hits.join(asked.select(query_id, "question"), query_id).withColumn("identifier", named), chosen, "question", "identifier", IDENTITY, query_id)
    primary = chosen.unionByName(put.select(query_id, F.lit(TOP_K + 1).alias("place"), *IDENTITY))
    both = primary.withColumn("section", F.lit(0)).unionByName(expand(primary, call_edges, query_id).withColumn("section", F.lit(1)))
    return whole_chunks(both, index)


def cited(context: DataFrame) -> DataFrame:
    return context.withColumn("citation", citation(F.col("file_path"), F.col("parent_class"), F.col("base_name"), F.col("start_line"), F.col("end_line")))


def context_text(context: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query_id, context, citations): labelled blocks by section and place, and their citations in that order."""
    block = F.concat(F.lit("["), F.concat_ws(".", F.nullif("parent_class", F.lit("")), "base_name"), F.format_string(", lines %d-%d]\n", "start_line", "end_line"), "text")
    held = F.array_sort(F.collect_list(F.struct("section", "place", "file_path", "start_line", block.alias("block"), "citation")))
    return cited(context).groupBy(query_id).agg(held.alias("held")).select(query_id, F.array_join(F.transform("held", lambda x: x["block"]), "\n\n").alias("context"), F.transform("held", lambda x: x["citation"]).alias("citations"))


def risk_notes(primary: DataFrame, risk: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query_id, risk_notes) for files of primaries with a high risk, once a file."""
    stem = F.replace(F.regexp_replace("file_path", r"\.py$", ""), F.lit("/"), F.lit("."))
    files = primary.groupBy(query_id, stem.alias("file")).agg(F.min("place").alias("place"))
    high = files.join(risk.filter("risk_level = 'high'"), "file")
    note = F.concat("file", F.lit(".py: "), "rationale")
    return high.groupBy(query_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", note.alias("n")))), lambda x: x["n"]).alias("risk_notes"))
