"""The tolerant as-of join against a plain search, its carried groups and its stated cases."""

import bisect
import datetime as dt
import math
import random
import zlib

import pyarrow.parquet as pq
import pytest

from barflow.llm.asof import OUT, tolerant_asof

SF = "/root/testdata/sf0.001"


def plain(events, orders, tolerance):
    """events (client, t, id); orders (client, t, id, priority, value)."""
    by = {}
    for client, t, *rest in orders:
        if client is not None and t is not None:
            by.setdefault(client, {}).setdefault(t, []).append(rest)
    times = {c: sorted(x) for c, x in by.items()}
    out = []
    for client, t, own in events:
        row = (own, client, t, None, None, None, 0)
        if client is not None and t is not None and client in by:
            k = bisect.bisect_right(times[client], t)
            if k and t - times[client][k - 1] <= tolerance:
                then = times[client][k - 1]
                group = by[client][then]
                best = min(group, key=lambda o: (o[1] is None, o[1] or 0, o[0] is None, -(o[0] or 0), o[2] is None, o[2] or 0))
                row = (own, client, t, best[0], t - then, best[2], len(group))
        out.append(row)
    return sorted(out, key=str)


def run(spark, events, orders, tolerance):
    from pyspark.sql import functions as F

    clash = [F.lit("x").alias(c) for c in ("width", "data", "part", "lag", "n_tied", "is_last")]
    left = spark.createDataFrame(events, "client long, t long, event_id long").select("*", *clash)
    right = spark.createDataFrame(orders, "client long, t long, order_id long, priority long, value long").select("*", *clash)
    got = tolerant_asof(left, right, tolerance)
    assert got.columns == OUT
    return sorted((tuple(r) for r in got.collect()), key=str)


def some(rng, n, clients, span, nulls=0.05):
    pick = lambda x: None if rng.random() < nulls else x
    return [(pick(rng.choice(clients)), pick(rng.randrange(-span, span))) for _ in range(n)]


@pytest.mark.parametrize("span", [5, 300, 100_000])
def test_random(spark, span):
    rng = random.Random(span)
    clients = [7] * 20 + [-5, 0, 1, 2, (1 << 63) - 1, -(1 << 63)]  # one client holds most rows: its ranges are cut
    events = [(*x, rng.choice([None, k, -k])) for k, x in enumerate(some(rng, 1500, clients, span))]
    orders = [(*x, rng.choice([None, k, -1 - k]), rng.choice([None, 1, 2, 3]), rng.choice([None, 5, -5])) for k, x in enumerate(some(rng, 700, clients, span))]
    for tolerance in (0, span // 10, 10 * span):
        assert run(spark, events, orders, tolerance) == plain(events, orders, tolerance)


def test_group_carried_over_ranges(spark):
    """One early order, then many events: ranges without an order of their own."""
    orders = [(1, 0, 10, 2, 7), (1, 0, 11, 2, 8), (1, 0, 12, None, 9), (2, -4, 1, 1, 1)]
    events = [(c, k, k) for k in range(2000) for c in (0, 1, 2)]
    assert run(spark, events, orders, 1500) == plain(events, orders, 1500)


def test_cases(spark):
    big = (1 << 63) - 1
    events = [(1, 5, 1), (1, 5, 1), (None, 5, 2), (1, None, 3), (None, None, None), (2, 5, 4), (1, big, 5), (1, -big - 1, 6)]
    orders = [(1, 5, 3, 1, 100), (1, 5, 3, 1, 100), (1, 5, None, 1, 1), (None, 5, 4, 1, 1), (2, None, 5, 1, 1), (2, 6, 6, 1, 1), (1, -big - 1, 9, 1, None)]
    for tolerance in (0, 10, big):
        assert run(spark, events, orders, tolerance) == plain(events, orders, tolerance)
    assert run(spark, [], orders, 5) == [] and run(spark, events, [], 5) == plain(events, [], 5)
    assert run(spark, [], [], 5) == []


def crc(x):
    return None if x is None else zlib.crc32(str(x).encode())


def us(t):
    return None if t is None else (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def floored(t, h):
    return t if t is None or not h % 2 else t - t % 3_600_000_000


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_query(spark, zone):
    from barflow.llm.queries import QUERIES

    c, s = pq.read_table(f"{SF}/clicks.parquet").to_pylist(), pq.read_table(f"{SF}/sales.parquet").to_pylist()
    events = sorted({(r["client_id"], floored(us(r["ts"]), crc(r["click_id"])), r["click_id"]) for r in c}, key=str)
    assert len({e[2] for e in events}) == len(events)
    orders = []
    for r in s:
        h, t = crc(r["sale_id"]), floored(us(r["sold_at"]), crc(r["sale_id"]))
        cents = None if r["total"] is None else math.floor(100 * r["total"] + 0.5)
        orders.append((r["client_id"], t, r["sale_id"], r["priority"], cents))
        if h % 3:
            orders.append((r["client_id"], t, -1 - r["sale_id"], None if r["priority"] is None else 6 - r["priority"], cents))
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = QUERIES["op12_tolerant_asof"](spark, SF)
        assert got.columns == ["click_id", "client_id", "ts_us", "sale_id", "lag_us", "total_cents", "n_tied"] and {k for _, k in got.dtypes} == {"bigint"}
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain(events, orders, 240 * 3_600_000_000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_copies_that_differ(spark):
    from barflow.llm.asof import once

    rows = spark.createDataFrame([(1, 5, 9), (1, 5, 3), (1, 4, 8), (2, None, 7), (2, None, None), (3, 6, None), (3, None, 1), (None, 1, 1), (None, 1, 1)], "k long, t long, c long")
    assert sorted((tuple(r) for r in once(rows, "k", "t", "c").collect()), key=str) == sorted([(1, 4, 8), (2, None, 7), (3, 6, None), (None, 1, 1)], key=str)
