import math
import random
import zlib
from datetime import datetime, timedelta, timezone

import pytest

from codelode.llm import point_in_time
from codelode.llm.queries import ORACLES, QUERIES

from ..compare import compare

SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, d string"
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, client_id string"
DAY = timedelta(days=1)


def money(x):
    return 0 if x is None or not math.isfinite(x) else math.floor(100 * x + 0.5)


def brute(sales, clicks, lines, days=(2, 14)):
    out, clicks = [], set(clicks)
    for sale_id, client, _, _, sold_at, _, _, _ in sales:
        if client is None or sold_at is None:
            continue
        t = sold_at + timedelta(seconds=zlib.crc32(str(-1 if sale_id is None else sale_id).encode()) % 259_200)
        label = any(s[1] == client and s[4] is not None and t < s[4] <= t + 7 * DAY for s in sales)
        for d in days:
            known = lambda at, arrived: at is not None and arrived is not None and t - d * DAY < at <= t and arrived + timedelta(minutes=240) <= t  # noqa: B023, E731
            c = [x for x in clicks if x[3] == client and known(x[1], x[2])]
            s = [x for x in sales if x[1] == client and known(x[4], x[5])]
            m = [x for y in s for x in lines if x[0] is not None and x[0] == y[0] and x[8] is not None and x[8] <= t]
            last = max(((x[1], -1 if x[0] is None else x[0]) for x in c), default=(None, -1))[1]
            us = (t.replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
            out.append((sale_id, d, us, label, len(c), sum(x[4] == "purchase" for x in c), sum(money(x[5]) for x in c), None if last == -1 else last, len(s), sum(money(x[3]) for x in s), len(m), len({x[2] for x in m} - {None}), sum(money(x[5]) for x in m)))
    return sorted(out, key=repr)


def shop(seed, n):
    """Few clients, one with most rows; coarse times, so that deltas and probes tie."""
    r = random.Random(seed)
    at = lambda: None if r.random() < 0.03 else datetime(2024, 1, 1) + timedelta(hours=r.randrange(0, 24 * 40))
    late = lambda x: None if x is None or r.random() < 0.03 else x + timedelta(minutes=r.choice([0, 1, 60, 5_000, 30_000]))
    client = lambda: r.choice([7] * 6 + [1, 2, None])
    value = lambda: r.choice([None, 0.005, -3.335, 12.5, float("nan"), float("inf"), 99.99])
    sales = [(k, client(), "done", value(), x := at(), late(x), 1, "x") for k in range(n)]
    sales += [sales[0], (None, 7, None, 1.0, datetime(2024, 1, 9), datetime(2024, 1, 9), None, None)]
    clicks = [(r.choice([None, k, k]), x := at(), late(x), client(), r.choice(["purchase", "view", None]), value(), "{}") for k in range(3 * n)]
    clicks += clicks[:20] + [(*clicks[0][:6], "other")]
    lines = [(r.choice([None, 3, r.randrange(n)]), 1, r.choice([None, 5, 5, r.randrange(6)]), 1, 1, value(), 0.0, "", late(at()), "x") for _ in range(6 * n)]
    return sales, clicks, lines


def frames(spark, sales, clicks, lines):
    return spark.createDataFrame(sales, SALES), spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(lines, LINES)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    """A client and an item over several partitions, nulls, ties, repeats, late and broken rows, extra columns."""
    data = shop(seed, 60)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((tuple(r) for r in point_in_time.features(*frames(spark, *data)).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == brute(*data)


def test_zone_of_the_session_changes_nothing(spark):
    data = shop(3, 20)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = sorted((tuple(r) for r in point_in_time.features(*frames(spark, *data), days=(1, 3, 30)).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == brute(*data, days=(1, 3, 30))


def test_empty_tables(spark):
    sales, clicks, lines = shop(4, 10)
    assert point_in_time.features(*frames(spark, [], clicks, lines)).collect() == []
    got = sorted((tuple(r) for r in point_in_time.features(*frames(spark, sales, [], [])).collect()), key=repr)
    assert got == brute(sales, [], [])


def test_against_sql(spark):
    compare(spark, "op11_features", QUERIES["op11_features"], ORACLES["op11_features"])
