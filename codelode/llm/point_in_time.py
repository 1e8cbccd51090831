"""Point-in-time features of sales: what was known of a client at a moment, in windows of several lengths.

Whatever counts in a window is a pair of deltas of its client: plus where it begins to count (it has happened and has
arrived), minus where the window has passed it. Probes are the moments asked for. Deltas and probes of all clients are
range-partitioned by client and time; a first pass scans each partition in order, segment by segment, with sums since
the segment's or the partition's begin, and yields the state in which it ends. The driver combines the states, one of
fixed size a partition, to what each partition takes over, and a second pass adds that to the probes of its first
segment. So a client may have any share of the rows: its deltas lie in as many partitions as they need.

Distinct items need intervals that don't overlap. Those of a client and item, all of one length, are put in order the
same way (latest first, the earliest begin so far carried along), and each keeps what the one before it doesn't cover.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

MINUTE = 60_000_000
DAY = 1_440 * MINUTE
#: Seconds among which a sale's number chooses how long after the sale it is looked at.
SPREAD = 259_200
#: Stand for no time at all: no click so far, no begin so far.
NEVER, NOT_YET = -(1 << 62), 1 << 62
#: What a delta counts, and the sums that it changes, each a window; ``probe`` comes after all deltas of its moment.
KINDS = {
    "click": ("n_clicks", "click_cents"),
    "purchase": ("n_clicks", "n_purchases", "click_cents"),
    "sale": ("n_sales", "sale_cents"),
    "line": ("n_lines", "line_cents"),
    "item": ("n_items",),
    "line_item": ("n_lines", "line_cents", "n_items"),
    "label": (),
    "probe": (),
}
SUMS = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is UTC, whatever the session's zone."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        since = df[column] - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return (since.cast("interval second").cast("decimal(24,6)") * 1_000_000).cast("long")
    return F.unix_micros(df[column].cast("timestamp"))


def cents(value: Column) -> Column:
    """floor(100 x + 0.5); null, not a number and infinite count 0."""
    x = value.cast("double")
    odd = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(odd, F.lit(0)).otherwise(F.floor(100 * x + 0.5)).cast("long")


def _in_order(rows: DataFrame, keys: list[Column], within: list[Column]) -> DataFrame:
    """Rows dealt to ranges of ``keys`` and sorted there by ``within``, a leading part of them."""
    return rows.repartitionByRange(*keys).sortWithinPartitions(*within)


def _breaks(keys: list[np.ndarray], last: tuple | None) -> np.ndarray:
    """Whether a row begins a segment, that is, has other keys than the row before it (``last`` before the first row)."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    new[0] = last is None or any(k[0] != x for k, x in zip(keys, last))
    return new


# Intervals of an item.

SPANS = "state boolean, pid int, at_first boolean, at_last boolean, client long, item long, has_item boolean, sold long, begin long, cents long, tie long, earliest long, before long"


def _scan_spans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of client and item, latest sale first: each with the earliest begin of its item up to here.

    ``before`` is the sale of the next row of the segment, which ends what this row covers; a partition's last row
    gets it from the next partition. The state: first and last key, earliest begin in the last segment, first sale.
    """
    pid = TaskContext.get().partitionId()
    key = last = None
    earliest, first, first_sold, held, n = NOT_YET, None, 0, None, 0
    for frame in frames:
        if not len(frame):
            continue
        keys = [frame[c].to_numpy() for c in ("client", "has_item", "item")]
        sold, begin = frame["sold"].to_numpy(), frame["begin"].to_numpy()
        new = _breaks(keys, last)
        segment = np.cumsum(new)
        # The least so far of each segment in one pass: by rank, ranks of later segments being lower.
        pool = np.unique(np.r_[begin, earliest])
        rank, step = np.searchsorted(pool, begin), len(pool)
        if not new[0]:
            rank[0] = min(rank[0], np.searchsorted(pool, earliest))
        run = pool[np.minimum.accumulate(rank - segment * step) + segment * step]
        if first is None:
            first, first_sold = tuple(k[0] for k in keys), int(sold[0])
        at_first = np.logical_and.reduce([k == x for k, x in zip(keys, first)])
        before = np.full(len(frame), NEVER)
        same = ~new[1:]
        before[:-1][same] = sold[1:][same]
        frame = frame.assign(state=False, pid=pid, at_first=at_first, at_last=False, tie=np.arange(n, n + len(frame)) + (pid << 40), earliest=run, before=before)
        if held is not None:
            if not new[0]:
                held["before"] = sold[0]
            yield held
        yield frame.iloc[:-1]
        held = frame.iloc[-1:].copy()
        last = tuple(k[-1] for k in keys)
        earliest, n = int(run[-1]), n + len(frame)
    if held is None:
        return
    held["at_last"] = True
    yield held
    # The state's own row: last key, earliest begin of its segment; the first key and sale go along in a second row.
    rows = [(True, pid, True, False, *first, first_sold, 0, 0, 0, NOT_YET, NEVER), (True, pid, False, True, *last, 0, 0, 0, 0, earliest, NEVER)]
    names = ["state", "pid", "at_first", "at_last", "client", "has_item", "item", "sold", "begin", "cents", "tie", "earliest", "before"]
    yield pd.DataFrame(rows, columns=names)


def _lines_in_order(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lines`` (client, item, has_item, sold, begin, cents) with the earliest begin of their item and the sale that follows in its order, and the table behind it."""
    keys = [F.col("client"), F.col("has_item"), F.col("item"), F.col("sold").desc()]
    scanned = staged(_in_order(lines, [*keys, F.col("begin"), F.col("cents")], keys).mapInPandas(_scan_spans, SPANS), "spans")
    states: dict = {}
    for r in scanned.filter("state").collect():
        states.setdefault(r["pid"], {})["first" if r["at_first"] else "last"] = ((r["client"], r["has_item"], r["item"]), r["sold"], r["earliest"])
    order, carried = sorted(states), {}
    for p, q in zip(order, order[1:]):
        if states[q]["first"][0] == states[p]["last"][0]:
            whole = states[p]["first"][0] == states[p]["last"][0]
            carried[q] = min(states[p]["last"][2], carried.get(p, NOT_YET) if whole else NOT_YET)
            states[p]["next"] = states[q]["first"][1]
    taken = [(p, carried.get(p, NOT_YET), states[p].get("next", NEVER)) for p in order]
    carry = F.broadcast(lines.sparkSession.createDataFrame(taken, "pid int, upto long, next long"))  # a row a partition
    both = scanned.filter("NOT state").join(carry, "pid", "left")
    earliest = F.when(F.col("at_first"), F.least("earliest", "upto")).otherwise(F.col("earliest"))
    before = F.when(F.col("at_last"), F.col("next")).otherwise(F.col("before"))
    return both.select("client", "has_item", "sold", "begin", "cents", "tie", earliest.alias("earliest"), before.alias("before")), scanned


# Deltas.


class Codes:
    """A delta's code: its kind and the windows that it is for, as bits."""

    def __init__(self, days: Sequence[int]):
        self.days, self.bits = list(days), len(days)
        self.number = {kind: k << self.bits for k, kind in enumerate(KINDS)}
        self.features = [(k, s) for k in range(self.bits) for s in SUMS]

    def mask(self, counts: Sequence[Column]) -> Column:
        """Bits of the windows whose condition holds."""
        return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(counts)), F.lit(0))

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """How a delta's count and its cents change each sum, by code; the last sum is the label's."""
        n = np.zeros((len(KINDS) << self.bits, len(self.features) + 1), np.int64)
        money = n.copy()
        for kind, at in self.number.items():
            for mask in range(1 << self.bits):
                for j, (k, name) in enumerate(self.features):
                    if mask >> k & 1 and name in KINDS[kind]:
                        (money if name.endswith("cents") else n)[at + mask, j] = 1
            n[at : at + (1 << self.bits), -1] = kind == "label"
        return n, money


ROW = "client long, at long, code int, n long, cents long, ts long, id long"


def _delta(at: Column, code: Column, n: int | Column, money: Column, ts: Column, tie: Column) -> Column:
    of = {"at": (at, "long"), "code": (code, "int"), "n": (n if isinstance(n, Column) else F.lit(n), "long"), "cents": (money, "long"), "ts": (ts, "long"), "id": (tie, "long")}
    return F.struct(*(c.cast(kind).alias(name) for name, (c, kind) in of.items()))


def _rows(df: DataFrame, made: list[Column]) -> DataFrame:
    """The deltas of each row; those that no window counts are left out."""
    return df.select("client", F.inline(F.array(*made))).filter("n <> 0")


def _pair(codes: Codes, kind: Column, happened: Column, begin: Column, money: Column, ts: Column, tie: Column) -> list[Column]:
    """A begin for all windows that are still open then, and an end for each."""
    open_ = [begin < happened + d * DAY for d in codes.days]
    mask = codes.mask(open_)
    made = [_delta(begin, kind + mask, F.when(mask > 0, 1).otherwise(0), money, ts, tie)]
    for k, d in enumerate(codes.days):
        made.append(_delta(happened + d * DAY, kind + (1 << k), F.when(open_[k], -1).otherwise(0), -money, F.lit(NEVER), tie))
    return made


def _line_deltas(codes: Codes, rows: DataFrame) -> DataFrame:
    """Deltas of lines and of what they add to their client's distinct items; where both begin or end together they are one."""
    ends = [F.col("sold") + d * DAY for d in codes.days]
    open_ = [F.col("begin") < e for e in ends]
    starts = [F.greatest(F.col("earliest"), F.col("before") + d * DAY) for d in codes.days]
    adds = [F.col("has_item") & (s < e) for s, e in zip(starts, ends)]
    line, item, both = (F.lit(codes.number[k]) for k in ("line", "item", "line_item"))
    none, tie, money = F.lit(NEVER), F.col("tie"), F.col("cents")
    made = []
    for k, (start, end) in enumerate(zip(starts, ends)):
        bit = 1 << k
        together = adds[k] & open_[k]
        made.append(_delta(end, F.when(together, both).when(open_[k], line).otherwise(item) + bit, F.when(open_[k] | adds[k], -1).otherwise(0), F.when(open_[k], -money).otherwise(0), none, tie))
        made.append(_delta(start, item + bit, F.when(adds[k] & ~(open_[k] & (start == F.col("begin"))), 1).otherwise(0), F.lit(0), none, tie))
    shared = codes.mask([a & o & (s == F.col("begin")) for a, o, s in zip(adds, open_, starts)])
    alone = codes.mask([o & ~(a & (s == F.col("begin"))) for a, o, s in zip(adds, open_, starts)])
    made.append(_delta(F.col("begin"), both + shared, F.when(shared > 0, 1).otherwise(0), money, none, tie))
    made.append(_delta(F.col("begin"), line + alone, F.when(alone > 0, 1).otherwise(0), money, none, tie))
    return _rows(rows, made)


# The scan.


def _scan(codes: Codes):
    """Sums since the segment's or the partition's begin for every probe, and the state at the partition's end."""
    by_n, by_cents = codes.weights()
    probe, clicks = codes.number["probe"], (codes.number["click"], codes.number["purchase"] + (1 << codes.bits))
    names = [*(f"s{k}" for k in range(by_n.shape[1]))]

    def out(state, pid, first, client, at, sale, sums, ts, click) -> pd.DataFrame:
        return pd.DataFrame({"state": state, "pid": pid, "at_first": first, "client": client, "at": at, "sale_id": sale, **{c: sums[:, k] for k, c in enumerate(names)}, "last_ts": ts, "last_id": click})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        first = last = None
        sums, latest = np.zeros(len(names), np.int64), (NEVER, NEVER)
        for frame in frames:
            if not len(frame):
                continue
            client, code = frame["client"].to_numpy(), frame["code"].to_numpy()
            ts, ids = frame["ts"].to_numpy(), frame["id"].to_numpy()
            change = by_n[code] * frame["n"].to_numpy()[:, None] + by_cents[code] * frame["cents"].to_numpy()[:, None]
            new = _breaks([client], None if last is None else (last,))
            segment = np.cumsum(new)
            begins = np.flatnonzero(new)
            total = np.cumsum(change, axis=0)
            base = np.zeros((segment[-1] + 1, len(names)), np.int64)
            base[segment[begins]] = total[begins] - change[begins]
            base[0] = -sums
            if first is None:
                first = client[0]
            # The latest click by (ts, id) of each segment so far: ranks of the batch's clicks, later segments higher.
            counted = np.flatnonzero(ts > NEVER)
            rank = np.zeros(len(frame), np.int64)
            pool_ts, pool_id = np.r_[ts[counted], latest[0]], np.r_[ids[counted], latest[1]]
            order = np.lexsort([pool_id, pool_ts])
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(1, len(order) + 1)
            rank[counted] = place[:-1]
            if not new[0] and latest[0] > NEVER:
                rank[0] = max(rank[0], place[-1])
            step = len(order) + 1
            best = np.maximum.accumulate(segment * step + rank) - segment * step
            asked = np.flatnonzero(code >= probe)
            found = best > 0
            chosen = order[np.maximum(best, 1) - 1]
            last_ts, last_id = np.where(found, pool_ts[chosen], NEVER), np.where(found, pool_id[chosen], NEVER)
            if len(asked):
                yield out(False, pid, client[asked] == first, client[asked], frame["at"].to_numpy()[asked], ids[asked], total[asked] - base[segment[asked]], last_ts[asked], last_id[asked])
            sums, latest, last = total[-1] - base[segment[-1]], (int(last_ts[-1]), int(last_id[-1])), client[-1]
        if last is not None:
            yield out([True], pid, bool(first == last), [last], [first], [0], sums[None, :], [latest[0]], [latest[1]])

    schema = "state boolean, pid int, at_first boolean, client long, at long, sale_id long, " + ", ".join(f"{c} long" for c in names) + ", last_ts long, last_id long"
    return run, schema, names


def _taken_over(states: list, names: list[str]) -> list[tuple]:
    """(pid, sums, last_ts, last_id) that each partition takes over from those before it for its first client."""
    out, client, held = [], None, None
    for r in sorted(states, key=lambda r: r["pid"]):
        if client is not None and r["at"] == client:
            out.append((r["pid"], *held))
        own = [*(r[c] for c in names), r["last_ts"], r["last_id"]]
        if r["at_first"] and r["at"] == client:
            own = [*(a + b for a, b in zip(own[:-2], held[:-2])), *max(tuple(own[-2:]), tuple(held[-2:]))]
        client, held = r["client"], own
    return out


def features(sales: DataFrame, clicks: DataFrame, lines: DataFrame, days: Sequence[int] = (2, 14), delay_minutes: int = 240, label_days: int = 7) -> DataFrame:
    """One row per sale and window: sale_id, d, t_us, label, and what was known of its client at t in the d days up to it.

    A sale with a client and a time is looked at at t: its time plus (crc32 of its number mod 259,200) seconds. Clicks
    and sales count from when they have happened and arrived ``delay_minutes`` ago, lines of such sales from when they
    are shipped besides; all while they lie in the window (t - d days, t]. ``label``: the client buys again within
    ``label_days``. Rows of clicks that are equal in all columns count once; repeated sales count each, as do their
    lines, once a sale row. Rows with a null client, time or arrival (of lines: null sale or shipment) count nowhere;
    null items are no items; null or not finite amounts are 0 cents. Of clicks at one time the largest id is the last,
    a null id the smallest. Sales without a number are looked at as if the number were 0's neighbour -1 and keep null.
    An empty table gives an empty result; extra columns are ignored, but for clicks, where they tell rows apart.
    """
    codes = Codes(days)
    delay, longest = delay_minutes * MINUTE, max(days) * DAY
    told = clicks.filter(clicks["client_id"].isNotNull() & clicks["ts"].isNotNull() & clicks["arrived_at"].isNotNull()).distinct()
    seen = told.select(told["client_id"].cast("long").alias("client"), micros(told, "ts").alias("ts"), micros(told, "arrived_at").alias("arrived"), F.when(told["kind"] == "purchase", codes.number["purchase"]).otherwise(codes.number["click"]).alias("kind"), cents(told["value"]).alias("cents"), F.coalesce(told["click_id"].cast("long"), F.lit(NEVER)).alias("id"))
    begin = F.greatest(F.col("ts"), F.col("arrived") + delay)
    seen = staged(seen.withColumn("begin", begin).drop("arrived").filter(F.col("begin") < F.col("ts") + longest), "clicks")
    sold = sales.filter(sales["client_id"].isNotNull() & sales["sold_at"].isNotNull())
    sold = staged(sold.select(sold["sale_id"].cast("long").alias("sale_id"), sold["client_id"].cast("long").alias("client"), micros(sold, "sold_at").alias("sold"), micros(sold, "arrived_at").alias("arrived"), cents(sold["total"]).alias("cents")), "sales")
    arrived = F.greatest(F.col("sold"), F.col("arrived") + delay)
    counted = sold.filter("arrived IS NOT NULL").withColumn("begin", arrived).filter(F.col("begin") < F.col("sold") + longest)

    shipped = lines.filter(lines["sale_id"].isNotNull() & lines["shipped_at"].isNotNull())
    shipped = shipped.select(shipped["sale_id"].cast("long").alias("sale_id"), shipped["item_id"].cast("long").alias("item"), micros(shipped, "shipped_at").alias("shipped"), cents(shipped["amount"]).alias("cents"))
    joined = shipped.join(counted.select("sale_id", "client", "sold", F.col("begin").alias("arrived")).hint("merge"), "sale_id")
    known = joined.select("client", F.coalesce("item", F.lit(0)).alias("item"), F.col("item").isNotNull().alias("has_item"), "sold", F.greatest("arrived", "shipped").alias("begin"), "cents")
    known = staged(known.filter(F.col("begin") < F.col("sold") + longest), "lines")

    click, sale = F.col("kind"), F.lit(codes.number["sale"])
    asked = F.col("sold") + F.pmod(F.crc32(F.coalesce("sale_id", F.lit(-1)).cast("string").cast("binary")), F.lit(SPREAD)) * 1_000_000
    none, tie = F.lit(NEVER), F.coalesce("sale_id", F.lit(NEVER))
    label = F.lit(codes.number["label"])
    ordered, spans = _lines_in_order(known)
    parts = [
        _rows(seen, _pair(codes, click, F.col("ts"), F.col("begin"), F.col("cents"), F.col("ts"), F.col("id"))),
        _rows(counted, _pair(codes, sale, F.col("sold"), F.col("begin"), F.col("cents"), none, tie)),
        _rows(sold, [_delta(F.col("sold") - label_days * DAY, label, 1, F.lit(0), none, tie), _delta(F.col("sold"), label, -1, F.lit(0), none, tie), _delta(asked, F.lit(codes.number["probe"]), 1, F.lit(0), none, tie)]),
        _line_deltas(codes, ordered),
    ]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    run, schema, names = _scan(codes)
    scanned = _in_order(union, [F.col("client"), F.col("at"), F.col("code"), F.col("id")], [F.col("client"), F.col("at"), F.col("code")]).mapInPandas(run, schema)
    scanned = staged(scanned, "scanned")
    discard(seen, sold, known, spans)
    taken = _taken_over(scanned.filter("state").select("pid", "at_first", "client", "at", *names, "last_ts", "last_id").collect(), names)
    more = scanned.sparkSession.createDataFrame(taken, "pid int, " + ", ".join(f"c_{c} long" for c in names) + ", c_ts long, c_id long")
    both = scanned.filter("NOT state").join(F.broadcast(more.withColumn("at_first", F.lit(True))), ["pid", "at_first"], "left")  # a row a partition
    value = {c: F.col(c) + F.coalesce(f"c_{c}", F.lit(0)) for c in names}
    last = F.greatest(F.struct(F.col("last_ts").alias("ts"), F.col("last_id").alias("id")), F.struct(F.coalesce("c_ts", F.lit(NEVER)).alias("ts"), F.coalesce("c_id", F.lit(NEVER)).alias("id")))
    whole = both.select("sale_id", "at", *(v.alias(c) for c, v in value.items()), last.alias("last"))

    def window(k: int, d: int) -> Column:
        of = dict(zip(SUMS, (F.col(f"s{k * len(SUMS) + j}") for j in range(len(SUMS)))))
        inside = (F.col("last.ts") > F.col("at") - d * DAY) & (F.col("last.id") > NEVER)
        of["last_click_id"] = F.when(inside, F.col("last.id"))
        columns = ("n_clicks", "n_purchases", "click_cents", "last_click_id", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")
        return F.struct(F.lit(d).cast("int").alias("d"), *(of[c].alias(c) for c in columns))

    each = F.inline(F.array(*(window(k, d) for k, d in enumerate(days))))
    out = whole.select(F.when(F.col("sale_id") > NEVER, F.col("sale_id")).alias("sale_id"), F.col("at").alias("t_us"), (F.col(names[-1]) > 0).alias("label"), each)
    return out.select("sale_id", "d", "t_us", "label", "n_clicks", "n_purchases", "click_cents", "last_click_id", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")


#: The same by range joins, client by client; crc32 bit by bit.
ORACLE = """
WITH crc AS (
  SELECT sale_id, client_id, sold_at, arrived_at, total,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
      lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda r, k: xor(r >> 1, (r & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) AS h
  FROM sales),
probe AS (SELECT row_number() OVER () AS p, * FROM (SELECT sale_id, client_id, sold_at + to_seconds(CAST(h % 259200 AS DOUBLE)) AS t, unnest([2, 14]) AS d FROM crc WHERE client_id IS NOT NULL AND sold_at IS NOT NULL)),
c AS (SELECT DISTINCT * FROM clicks),
nc AS (SELECT p, count(*) AS n_clicks, count(*) FILTER (kind = 'purchase') AS n_purchases, sum(coalesce(CAST(floor(100 * value + 0.5) AS BIGINT), 0)) AS click_cents, arg_max(click_id, (ts, click_id)) AS last_click_id
  FROM probe JOIN c USING (client_id) WHERE ts > t - to_days(d) AND ts <= t AND arrived_at + INTERVAL 240 MINUTE <= t GROUP BY p),
s AS (SELECT p, t, s.sale_id, total FROM probe JOIN sales s USING (client_id) WHERE sold_at > t - to_days(d) AND sold_at <= t AND arrived_at + INTERVAL 240 MINUTE <= t),
ns AS (SELECT p, count(*) AS n_sales, sum(coalesce(CAST(floor(100 * total + 0.5) AS BIGINT), 0)) AS sale_cents FROM s GROUP BY p),
nl AS (SELECT p, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, sum(coalesce(CAST(floor(100 * amount + 0.5) AS BIGINT), 0)) AS line_cents FROM s JOIN sale_lines l USING (sale_id) WHERE shipped_at <= t GROUP BY p),
lab AS (SELECT DISTINCT p FROM probe JOIN sales s USING (client_id) WHERE s.sold_at > t AND s.sold_at <= t + INTERVAL 7 DAY)
SELECT sale_id, d, epoch_us(t) AS t_us, lab.p IS NOT NULL AS label, coalesce(n_clicks, 0) AS n_clicks, coalesce(n_purchases, 0) AS n_purchases, CAST(coalesce(click_cents, 0) AS BIGINT) AS click_cents, last_click_id,
  coalesce(n_sales, 0) AS n_sales, CAST(coalesce(sale_cents, 0) AS BIGINT) AS sale_cents, coalesce(n_lines, 0) AS n_lines, coalesce(n_items, 0) AS n_items, CAST(coalesce(line_cents, 0) AS BIGINT) AS line_cents
FROM probe LEFT JOIN nc USING (p) LEFT JOIN ns USING (p) LEFT JOIN nl USING (p) LEFT JOIN lab USING (p)
"""
