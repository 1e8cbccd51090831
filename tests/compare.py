"""Registered queries against their SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.01"


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def compare(spark, name, query, sql, sf=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = sorted([tuple(normal(dict(zip(names, r))[c]) for c in sorted(names)) for r in cur.fetchall()], key=repr)
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(names), name
    got = sorted([tuple(normal(r[c]) for c in sorted(names)) for r in df.collect()], key=repr)
    assert len(got) == len(want), (name, len(got), len(want))
    assert got == want, (name, [x for x in zip(got, want) if x[0] != x[1]][:3])
