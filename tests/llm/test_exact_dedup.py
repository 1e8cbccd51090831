import hashlib
import random
import re

import pytest

from codelode.llm import exact_dedup as X
from codelode.llm.exact_dedup import exact_dedup

from .helpers import SF, WIDE, docs_of, rows_of


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.drop("chain_length").collect()), key=repr)


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t\n"), (7, "ab "), (8, "ab"), (8, "ab"), (None, "only null"), (None, "xx"), (9, "xx"), (10, "y" * 200_000), (11, "y" * 200_000 + " ")]


@pytest.mark.parametrize("key_bits", [64, 3, 1])
def test_against_brute_force_with_colliding_keys(spark, key_bits):
    rows = ROWS + [(100 + k, random.Random(k).choice("abcdefgh") * (k % 5)) for k in range(200)]
    assert got(exact_dedup(docs_of(spark, rows), key_bits=key_bits, bucket_capacity=2)) == brute(rows)


def test_extra_columns_with_names_of_the_result(spark):
    assert got(exact_dedup(docs_of(spark, ROWS, WIDE))) == brute(ROWS)


def test_empty_table(spark):
    assert exact_dedup(docs_of(spark, [])).collect() == []


def test_whole_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(exact_dedup(docs, bucket_capacity=16)) == brute(rows)


def test_hot_keys_are_combined_before_they_reach_their_owner(spark, monkeypatch):
    monkeypatch.setattr(X, "FEW_ROWS", 5)
    monkeypatch.setattr("codelode.llm.common.FEW_ROWS", 5)
    rows = ROWS + [(1000 + k, "hot text" + " " * (k % 3)) for k in range(90)] + [(2000 + k, f"t{k % 40}") for k in range(80)]
    for key_bits in (64, 4):
        assert got(exact_dedup(docs_of(spark, rows).repartition(5), key_bits=key_bits, bucket_capacity=4)) == brute(rows)


def indexed(spark, rows, key_bits, bucket_capacity):
    docs = docs_of(spark, rows)
    keys = X._keyed(docs, "doc_id", "text", key_bits).groupBy("key").agg(X.F.count(X.F.lit(1)).alias("n"), X.F.sum(X.F.length("norm")).alias("chars"))
    directory, depth = X.grow_directory(keys, bucket_capacity, key_bits)
    return directory, depth, X.build_index(docs, keys, directory, depth, key_bits=key_bits)


def test_directory_covers_all_slots_and_splits_overfull_buckets(spark):
    directory, depth, index = indexed(spark, [(k, f"t{k}") for k in range(300)], 64, 8)
    fill, owners = {}, {}
    for r in rows_of(index):
        fill.setdefault((r["depth"], r["bucket"]), set()).add(r["key"])
        owners.setdefault(r["owner"], set()).add(r["slot"])
        assert r["key"] % (1 << 64) >> (64 - r["depth"]) == r["bucket"] and r["key"] % (1 << 64) >> (64 - depth) == r["slot"]
    assert max(map(len, fill.values())) <= 8 and len({d for d, _ in fill}) > 1
    slots = [r["slot"] for r in rows_of(directory)]
    assert len(slots) == len(set(slots)) and max(slots) < 1 << depth
    ranges = sorted((min(s), max(s)) for s in owners.values())
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_colliding_keys_form_chains(spark):
    rows = [(k, f"t{k % 30}") for k in range(60)]
    _, _, index = indexed(spark, rows, 2, 1)
    chains = {}
    for r in rows_of(index):
        chains.setdefault(r["key"], []).append(r)
    assert sum(map(len, chains.values())) == 30 and len(chains) == 4
    for chain in chains.values():
        assert sorted(r["chain_place"] for r in chain) == list(range(1, len(chain) + 1))
        assert {r["chain_length"] for r in chain} == {len(chain)} and all(r["group_size"] == 2 for r in chain)
    out = rows_of(exact_dedup(docs_of(spark, rows), key_bits=2, bucket_capacity=1))
    assert len(out) == 60 and {r["chain_length"] for r in out} == {len(c) for c in chains.values()}


def test_rows_are_found_through_directory_and_index_only(spark, monkeypatch):
    rows = [(k, f"t{k}") for k in range(100)]
    grow, build = X.grow_directory, X.build_index

    def without_a_slot(*args):
        directory, depth = grow(*args)
        return directory.filter("slot <> 1"), depth

    monkeypatch.setattr(X, "grow_directory", without_a_slot)
    left = len(got(exact_dedup(docs_of(spark, rows), bucket_capacity=8)))
    assert 0 < left < 100
    monkeypatch.setattr(X, "grow_directory", grow)
    monkeypatch.setattr(X, "build_index", lambda *args: build(*args).filter("chain_place = 1"))
    assert len(got(exact_dedup(docs_of(spark, rows), key_bits=3, bucket_capacity=8))) == 8
