import corpus_pipeline as P

from codelode.llm import decontaminate, jaccard_join, packing, toxicity

from .helpers import SF, WIDE, docs_of, rows_of
from .test_exact_dedup import brute as brute_copies
from .test_jaccard_join import brute as _brute_links  # noqa: F401
from .test_jaccard_join import shingles


def near_groups(rows):
    """Smallest id of each component at five words and 0.8, by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, 5) for i, t in rows}
    holders, root = {}, {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            u, v = find(a), find(b)
            root[max(u, v)] = min(u, v)
    return {i: find(i) for i in sets}


def test_run_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").filter(toxicity.fold() != 2))
    import pyarrow as pa

    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    s = model.scores(pa.array([t for _, t in rows]))
    rows = [r for r, x in zip(rows, s) if x < toxicity.THRESHOLD]
    kept = {x[0] for x in brute_copies(rows) if x[3]}
    rows = [r for r in rows if r[0] in kept]
    group = near_groups(rows)
    rows = [r for r in rows if group[r[0]] == r[0]]
    index = decontaminate.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    held = {h[0] for h in index.hits(pa.array([t for _, t in rows]), decontaminate.THRESHOLD, decontaminate.OVERLAP)}
    rows = [r for k, r in enumerate(rows) if k not in held]
    got = rows_of(P.run(spark, SF))
    assert {r["doc_id"] for r in got} == {i for i, _ in rows}
    want = {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows_of(packing.pack(docs_of(spark, rows)))}
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
    assert jaccard_join.needed(10, 10, 80, 100) == 9


WORDS = " ".join(f"w{k}" for k in range(120))
ITEM = "Which river crosses the old town of the northern plain first? It is the long grey river that comes down from the hills"
ODD = [(None, None), (None, ""), (1, None), (2, " \n"), (3, WORDS), (3, WORDS), (None, WORDS), (4, f"{WORDS} more words"), (5, f"begin {ITEM} end of it"), (6, "tied text"), (7, "tied text"), (8, "x" * 200_000), (9, "word " * 40_000), (9, "another text of nine")]


def odd_tables(spark, folder, rows):
    """A folder of tables: odd documents with columns whose names clash with those of results, a benchmark, labels."""
    docs = docs_of(spark, rows, WIDE).coalesce(1)
    docs.write.parquet(f"{folder}/documents.parquet")
    bench = [(1, ITEM), (2, None), (None, "no id"), (3, ""), (4, "word")]
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(None, 1), (3, 0), (6, 0), (99, 1), (8, None)], "doc_id long, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_odd_rows_through_every_stage_and_the_whole(spark, tmp_path):
    folder = str(tmp_path)
    docs = odd_tables(spark, folder, ODD)
    sizes = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        sizes[name] = sorted(((r["doc_id"], r["text"]) for r in rows_of(out)), key=repr)
    every = sorted(ODD, key=repr)
    assert sizes["toxicity"] == every
    left = {(i, t) for i, t in sizes["exact_dedup"]}
    assert len(sizes["exact_dedup"]) == len({(t or "").replace(" ", "").strip() for _, t in ODD}) and (3, WORDS) in left and (6, "tied text") in left and (2, " \n") in left
    near = [t for _, t in sizes["near_dedup"]]
    assert near.count("tied text") == 1 and sum((t or "").startswith("w0 ") for t in near) == 1 and sum(not (t or "").strip() for t in near) == 4
    gone = [i for i, t in every if (i, t) not in sizes["decontaminate"]]
    assert gone == [5]
    got = rows_of(P.run(spark, folder))
    assert {r["doc_id"] for r in got} == {2, 3, 6, 8, 9} and sum(r["piece"] == 0 for r in got) == 6


def test_empty_tables(spark, tmp_path):
    docs = odd_tables(spark, str(tmp_path), [])
    for name, stage in P.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == [], name
    assert P.run(spark, str(tmp_path)).collect() == []


def test_null_and_repeated_ids_leave_one_row(spark):
    words = [f"w{k}" for k in range(200)]
    text, near, other = " ".join(words), " ".join(words[:-1] + ["end"]), " ".join(f"o{k}" for k in range(50))
    rows = [(None, text), (None, text), (7, text), (7, text), (7, text + " "), (3, other), (3, other), (None, "alone here"), (None, "alone here"), (9, "alone"), (9, "another")]
    got = P.drop_copies(spark, docs_of(spark, rows), SF)
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in rows_of(got)))) == sorted(map(repr, [(7, text + " "), (3, other), (None, "alone here"), (9, "alone"), (9, "another")]))
    rows = [(None, near), (7, text), (7, near), (None, text), (3, other), (3, other + " more"), (None, "one two three four five six"), (None, "one two three four five six"), (9, "alone"), (9, "another")]
    got = P.drop_near_copies(spark, docs_of(spark, rows), SF)
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in rows_of(got)))) == sorted(map(repr, [(7, text), (3, other), (None, "one two three four five six"), (9, "alone"), (9, "another")]))
