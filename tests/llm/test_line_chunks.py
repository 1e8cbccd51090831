import random

from codelode.llm.line_chunks import LONG_WORDS, cut, drop_repeated_chunks, drop_repeated_passages

from .helpers import SF, WIDE, docs_of, rows_of


def brute(rows):
    """First document of every removable chunk, then each text without chunks that belong to another or came before."""
    first = {}
    for i, t in rows:
        if i is not None:
            for c, may in cut(t or ""):
                if may:
                    first[c] = min(i, first.get(c, i))
    out = []
    for i, t in rows:
        kept, seen, n = [], set(), 0
        for c, may in cut(t or ""):
            if may and (c in seen or i is not None and first[c] < i):
                n += c.count("\n") + 1
                continue
            seen.add(c)
            kept.append(c)
        out.append((repr(i), "\n".join(kept), n))
    return sorted(out)


def got(df):
    return sorted((repr(r["doc_id"]), r["text"], r["removed_lines"]) for r in rows_of(df))


def corpus():
    rnd = random.Random(3)
    passage = "\n".join(f"shared line {k} of the passage" for k in range(12))
    long_line = " ".join(f"word{k}" for k in range(60))
    rows = [(None, passage), (1, None), (2, ""), (3, "\n\n\n"), (3, "\n\n\n"), (4, passage + "\n" + passage)]
    for k in range(10, 60):
        own = [f"own {rnd.random()}" for _ in range(rnd.randrange(1, 30))]
        own.insert(rnd.randrange(len(own) + 1), rnd.choice([passage, long_line, "license", "x"]))
        rows.append((k, "\n".join(own)))
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    assert got(drop_repeated_chunks(docs_of(spark, rows, WIDE))) == brute(rows)


def test_cut_joins_to_the_text_and_resists_shifts():
    rnd = random.Random(1)
    lines = [f"line {rnd.random()}" for _ in range(400)]
    a, b = cut("\n".join(lines)), cut("\n".join(["new"] + lines[:200] + ["other"] + lines[200:]))
    assert "\n".join(c for c, _ in a) == "\n".join(lines)
    assert len({c for c, _ in a} - {c for c, _ in b}) <= 4 and len(a) > 100


def test_long_passages_go_and_the_first_stays(spark):
    out = {r["doc_id"]: r["text"] for r in rows_of(drop_repeated_chunks(docs_of(spark, corpus())))}
    long_line = " ".join(f"word{k}" for k in range(60))
    assert sum(long_line in t for i, t in out.items() if i is not None) == 1


def test_empty_and_whole_table(spark):
    assert drop_repeated_chunks(docs_of(spark, [])).collect() == []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(drop_repeated_chunks(docs)) == brute(rows)


def test_short_lined_passages_go_whatever_stands_around_them(spark):
    rnd = random.Random(5)
    passages = ["\n".join(" ".join(f"p{n}w{rnd.random()}" for _ in range(w)) for _ in range(n)) for n, w in ((2, 30), (3, 20), (4, 15), (5, 12))]
    passages.append("\n".join(" ".join(f"m{rnd.random()}" for _ in range(w)) for w in (40, 5, 5, 5, 5)))
    rows = []
    for k in range(100):
        own = [[f"own {rnd.random()} of {k}" for _ in range(rnd.randrange(1, 9))] for _ in range(2)]
        rows.append((k, "\n".join(own[0] + [passages[k % 5]] + own[1]), "\n".join(own[0] + own[1])))
    out = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in rows_of(drop_repeated_passages(docs_of(spark, [(k, t) for k, t, _ in rows])))}
    for k, text, own in rows:
        assert out[k] == ((text, 0) if k < 5 else (own, passages[k % 5].count("\n") + 1)), k


def test_passages_against_all_runs(spark):
    rnd = random.Random(6)
    pool = [" ".join(f"s{k}w{j}" for j in range(rnd.randrange(1, 30))) for k in range(12)]
    rows = [(k, "\n".join(f"own {rnd.random()}" if rnd.random() < 0.2 else rnd.choice(pool) if rnd.random() < 0.2 else pool[j % 12] for j in range(rnd.randrange(2, 25)))) for k in range(40)]
    runs, chunks = {}, {}
    for k, t in rows:
        lines = t.split("\n")
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:b]) >= LONG_WORDS:
                    runs.setdefault("\n".join(lines[a:b]), []).append((k, a, b))
        at = 0
        for c, may in cut(t):
            if may:
                chunks.setdefault(c, []).append((k, at, at + c.count("\n") + 1))
            at += c.count("\n") + 1
    gone = {(k, x) for places in [*runs.values(), *chunks.values()] for k, a, b in places for x in range(a, b) if k > places[0][0] or a >= places[0][2]}
    want = [(repr(k), "\n".join(x for j, x in enumerate(t.split("\n")) if (k, j) not in gone), sum((k, j) in gone for j in range(t.count("\n") + 1))) for k, t in rows]
    assert got(drop_repeated_passages(docs_of(spark, rows, WIDE))) == sorted(want)


def test_passages_of_odd_rows(spark):
    passage = "\n".join(f"shared line {k} of the passage" for k in range(12))
    rows = [(None, passage), (None, passage + "\n" + passage), (1, None), (2, ""), (3, "\n\n\n"), (3, "\n\n\n"), (4, passage), (4, passage), (5, "a b c d e f g h i j\n" * 20 + "end")]
    lines = rows[-1][1].split("\n")
    assert got(drop_repeated_passages(docs_of(spark, rows, WIDE))) == sorted([("None", passage, 0), ("None", passage, 12), ("1", "", 0), ("2", "", 0), ("3", "\n\n\n", 0), ("3", "\n\n\n", 0), ("4", passage, 0), ("4", passage, 0), ("5", "\n".join(lines[:5] + ["end"]), 15)])
    assert drop_repeated_passages(docs_of(spark, [])).collect() == []


def test_repeated_passages_are_compared_by_bytes():
    """Two different passages that share a digest, made here by a weak one, come out with their bytes apart."""
    from codelode.llm import line_chunks as lc

    first, second = (" ".join(f"{w}{k}" for k in range(60)) for w in ("one", "two"))
    step = list(lc._shared_bytes([lc.pa.RecordBatch.from_arrays([lc.pa.array([first, "x\n" + first]), lc.pa.array([[lc.spans(first)[1][0][2]]] * 2)], names=["text", "wanted"])]))
    assert [b.column("lines").to_pylist() for b in step] == [[first]]

    strong = lc.spans
    weak = lambda text: (strong(text)[0], [(a, b, b"same") for a, b, _ in strong(text)[1]])
    lc.spans = weak
    try:
        batch = lc.pa.RecordBatch.from_arrays([lc.pa.array([first, second]), lc.pa.array([[b"same"]] * 2)], names=["text", "wanted"])
        rows = [r for b in lc._shared_bytes([batch]) for r in zip(b.column("digest").to_pylist(), b.column("lines").to_pylist())]
    finally:
        lc.spans = strong
    assert sorted(t for _, t in rows) == sorted([first, second])
