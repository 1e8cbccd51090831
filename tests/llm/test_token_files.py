import random
import zlib

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st

from codelode.llm.packing import best_fit_decreasing, lower_bound, pack
from codelode.llm.token_files import pack as pack_ranks
from codelode.llm.token_files import token_files, unpack
from codelode.llm.tokens import Encoder, default_tokenizer, encoder

from .helpers import WIDE, docs_of, rows_of

ODD = ["", "  a  b ", "Hello's WORLD!! <|endoftext|> x\x1cy z É́ İstanbul ΑΣ. ΟΔΟΣ, ﬁ é 12,3. don't they'll, ñ.  q", "\n", "日本語 テスト。 x", "à. b.́ ...", "x" * 5000, "word " * 9000]
ROWS = [(k * 7 % 5 + k, t) for k, t in enumerate(ODD)] + [(50, None), (50, "twice"), (50, "twice"), (None, "no id")]


def ids_of(text, end):
    return encoder(default_tokenizer()).full.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.integers(0, 70_000)))
def test_coding_round_trip(values):
    control, data = pack_ranks(np.array(values, dtype=np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert unpack(control, data, len(values)).tolist() == values


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abÉéß'’.,!1 \n\t\x1c  İσΣ́語"), max_size=30), max_size=5))
@example(texts=["İ.", "aİ, b"])
def test_memo_gives_the_ids_of_whole_texts(texts):
    import pyarrow as pa

    enc = Encoder(default_tokenizer()) if not texts else encoder(default_tokenizer())
    ids, offsets = enc.encode(pa.array(texts, pa.string()), 1)
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == ids_of(t, 1)


def test_files_against_brute_force(spark):
    got = rows_of(token_files(docs_of(spark, ROWS, WIDE), block_tokens=1000))
    assert len(got) == len(ROWS)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i is None, i or 0, len(ids_of(t, 1)), crc(ids_of(t, 1))) for i, t in ROWS)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ordered = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ordered == sorted((i for i in ordered if i is not None)) + [None]


def test_empty_tables(spark):
    assert token_files(docs_of(spark, [])).collect() == []
    assert pack(docs_of(spark, [])).collect() == []


def test_bound_and_packing_of_known_cases():
    for case, best in (([60, 60, 60], 3), ([50, 50, 50, 50], 2), ([34, 34, 34], 2), ([], 0), ([100], 1)):
        lengths = np.array(case, dtype=np.int64)
        bin_of, _ = best_fit_decreasing(lengths, 100)
        assert lower_bound(lengths, 100) <= best == len(set(bin_of.tolist()))
    assert lower_bound(np.array([60, 60, 60]), 100) == 3


def test_packing_holds_every_piece_without_gaps(spark):
    rnd = random.Random(5)
    rows = ROWS + [(1000 + k, "w " * int(rnd.paretovariate(0.6) * 3 % 300)) for k in range(400)]
    got = rows_of(pack(docs_of(spark, rows, WIDE), capacity=128, pool_pieces=50))
    want = []
    for i, t in rows:
        ids = ids_of(t, 0)
        want += [(repr(i), p, s, len(ids[s : s + 128]), crc(ids[s : s + 128])) for p, s in enumerate(range(0, len(ids), 128))]
    assert sorted((repr(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    lengths = np.array([r["length"] for r in got])
    assert len(by) <= lower_bound(lengths, 128) * 1.03 + 1
