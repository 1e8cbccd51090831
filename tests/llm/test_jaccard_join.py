import random
import re
from itertools import combinations

import pytest

from codelode.llm.components import components
from codelode.llm.jaccard_join import choose_boundary, jaccard_join

from .helpers import SF, WIDE, docs_of, rows_of


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, num=85, den=100):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    seen = {p for h in holders.values() for p in combinations(sorted(h), 2)}
    for a, b in seen:
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) * den >= max(len(x), len(y)) * num and den * len(x & y) >= num * len(x | y):
            u, v = find(a), find(b)
            root[max(u, v)] = min(u, v)
    return sorted((i is None, i or 0, len(shingles(t)), find(i) if i is not None else -1) for i, t in rows)


def got(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in rows_of(df))


def edited(rnd, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
    return w


def corpus(seed):
    rnd = random.Random(seed)
    rows = [(None, "a b c d"), (1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO "), (6, "one"), (7, "É é"), (8, "é é")]
    n = 10
    passage = [f"p{k}" for k in range(60)]
    for _ in range(14):
        size = rnd.choice([3, 5, 8, 9, 10, 16, 17, 24, 40, 60, 150, 400])
        base = [f"w{rnd.randrange(400)}" for _ in range(size)]
        for _ in range(rnd.choice([2, 3, 14])):
            w = edited(rnd, base, rnd.choice([0, 0, 1, 1, 2, 3, 5]) if size > 5 else 0)
            if rnd.random() < 0.2:
                w = w + [f"x{rnd.randrange(99)}" for _ in range(max(1, len(w) // rnd.choice([8, 12, 20])))]
            rows.append((n, " ".join(w)))
            n += 1
    for _ in range(25):
        rows.append((n, " ".join(passage + [f"q{rnd.randrange(10**6)}" for _ in range(rnd.choice([3, 5, 8, 20]))])))
        n += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,boundary", [(1, None), (2, 0), (3, 30)])
def test_against_brute_force(spark, seed, boundary):
    rows = corpus(seed)
    assert got(jaccard_join(docs_of(spark, rows, WIDE), boundary=boundary)) == brute(rows)


def test_whole_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(jaccard_join(docs)) == brute(rows)


def test_large_and_negative_ids(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [((1 << 62) + 3, text), ((1 << 50), text + " end"), (-(1 << 61), text), (5, "other " * 3)]
    assert got(jaccard_join(docs_of(spark, rows))) == brute(rows)


def test_repeated_ids_are_one_document(spark):
    words = [f"w{k}" for k in range(60)]
    other = [f"o{k}" for k in range(9)]
    near = " ".join([*words[:-1], "end"])
    rows = [(9, " ".join(words)), (9, " ".join(other)), (9, " ".join(words)), (3, near), (4, " ".join(other)), (4, " ".join(other)), (7, " ".join(other)), (8, "alone here"), (9, ""), (2, None)]
    for boundary in (0, 20):
        have = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in rows_of(jaccard_join(docs_of(spark, rows), boundary=boundary))}
        assert have == {(9, 57): 3, (9, 6): 3, (3, 57): 3, (4, 6): 3, (7, 6): 3, (8, 1): 8, (9, 0): 9, (2, 0): 2}
    assert len(rows_of(jaccard_join(docs_of(spark, rows)))) == len(rows)


def test_light_matches_are_compared(spark, monkeypatch):
    """With subset hashes that all collide no false link remains."""
    import codelode.llm.jaccard_join as J

    rows = [(k, " ".join(f"w{k}x{j}" for j in range(9))) for k in range(8)]
    monkeypatch.setattr(J, "_list", lambda *a, real=J._list: _colliding(real(*a)))
    assert [r["component_id"] for r in sorted(rows_of(jaccard_join(docs_of(spark, rows), boundary=20)), key=lambda r: r["doc_id"])] == list(range(8))


def _colliding(run):
    def changed(batches):
        import pyarrow as pa

        for b in run(batches):
            at = b.schema.get_field_index("subsets")
            yield b.set_column(at, b.schema.field(at), pa.array([[1] * len(x) for x in b.column(at).to_pylist()], b.schema.field(at).type))

    return changed


def test_hot_lists_and_classes_are_split(spark, monkeypatch):
    for name in ("codelode.llm.jaccard_join.FEW_ROWS", "codelode.llm.common.FEW_ROWS"):
        monkeypatch.setattr(name, 3)
    rnd = random.Random(5)
    base, small = [f"w{k}" for k in range(80)], [f"s{k}" for k in range(9)]
    rows = [(k, " ".join(edited(rnd, base, k % 3))) for k in range(60)] + [(100 + k, " ".join(small)) for k in range(30)] + [(200 + k, " ".join([*small, f"t{k}"])) for k in range(20)]
    for boundary in (0, 20):
        assert got(jaccard_join(docs_of(spark, rows), boundary=boundary)) == brute(rows)


def test_very_long_text(spark):
    rnd = random.Random(6)
    words = [f"w{rnd.randrange(50_000)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(edited(rnd, words, 200))), (3, " ".join(words[:30_000]))]
    assert got(jaccard_join(docs_of(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert jaccard_join(docs_of(spark, [])).collect() == []


def test_boundary_follows_the_sizes():
    assert choose_boundary({300: 1000}, 85, 100) == 0
    assert choose_boundary({5: 1000, 6: 1000}, 85, 100) >= 6


def test_components_of_paths_and_stars(spark):
    rnd = random.Random(3)
    links = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(501, 560)] + [(k, 7) for k in rnd.sample(range(1000, 2000), 30)]
    label = {r["node"]: r["label"] for r in rows_of(components(spark.createDataFrame(links, "a long, b long")))}
    assert {label[k] for k in range(100, 141)} == {100} and {label[k] for k in range(500, 560)} == {500} and label[7] == 7
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
