"""The point-in-time table against a plain scan, for clients of one chunk and of many."""

import random
import zlib
from datetime import datetime, timedelta

import pytest

from weftline.llm import pointintime

EPOCH = datetime(1970, 1, 1)
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
LINES = "sale_id long, line_no int, item_id long, amount double, shipped_at timestamp_ntz, reach string, chunk string"


def us(t):
    return (t - EPOCH) // timedelta(microseconds=1)


def cent(x):
    return int((100 * x + 0.5) // 1) if x is not None and abs(x) < float("inf") else 0


def plain(clicks, sales, lines, windows=(2, 14)):
    out = []
    late = timedelta(minutes=240)
    for sale in sales:
        sid, client, _, _, sold, _, _ = sale
        if client is None or sold is None:
            continue
        t = sold + timedelta(seconds=zlib.crc32(("" if sid is None else str(sid)).encode()) % 259200)
        label = any(s[1] == client and s[4] is not None and t < s[4] <= t + timedelta(days=7) for s in sales)
        for d in windows:
            since = t - timedelta(days=d)
            seen = [c for c in set(clicks) if c[3] == client and c[1] and c[2] and since < c[1] <= t and c[2] + late <= t]
            own = [s for s in sales if s[1] == client and s[4] and s[5] and since < s[4] <= t and s[5] + late <= t]
            mine = [x for s in own if s[0] is not None for x in lines if x[0] == s[0] and x[4] and x[4] <= t]
            last = max(seen, key=lambda c: (c[1], c[0] is not None, c[0] or 0), default=(None,))[0]
            out.append((
                sid, d, us(t), label, len(seen), sum(c[4] == "purchase" for c in seen), sum(cent(c[5]) for c in seen), len(own), sum(cent(s[3]) for s in own),
                len(mine), sum(cent(x[3]) for x in mine), len({x[2] for x in mine} - {None}), last,
            ))
    return sorted(out, key=str)


def made(seed, clients, n):
    r = random.Random(seed)
    when = lambda: r.choice([None] + [datetime(2024, 1, 1) + timedelta(seconds=r.choice([r.randrange(86400 * 60), 86400 * r.randrange(30), 86400 * 9 + 3600 * r.randrange(9)]), microseconds=r.choice([0, 999999])) for _ in range(25)])
    soon = lambda t: t and r.choice([t, t + timedelta(seconds=r.randrange(7200)), t + timedelta(days=r.randrange(20)), t - timedelta(days=3), None])
    client = lambda: r.choice([None] + [1] * 8 + list(range(clients)))
    money = lambda: r.choice([None, 0.005, 1.115, -2.345, float("nan"), float("inf"), r.random() * 100])
    clicks = [(r.choice([None, k, k // 2]), t := when(), soon(t), client(), r.choice(["purchase", "view", None]), money(), r.choice(["{}", None])) for k in range(3 * n)]
    clicks = [tuple(None if x != x else x for x in c) for c in clicks]  # for the plain version's set
    clicks += clicks[: n // 2]
    sales = [(k, client(), "done", money(), t := when(), soon(t), 1) for k in range(n)] + [(None, 1, "open", 3.0, datetime(2024, 1, 5), datetime(2024, 1, 5), None)]
    lines = [(r.choice([None, 0, 0, 0, r.randrange(n)]), k, r.choice([None, 1, 1, 2, r.randrange(9)]), money(), when(), "x", None) for k in range(5 * n)]
    lines += lines[:n]
    return clicks, sales, lines


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("seed", "chunk", "bucket"), [(1, 20_000, 60_000), (2, 12, 100), (3, 3, 40)])
def test_equals_the_plain_scan(spark, seed, chunk, bucket):
    clicks, sales, lines = made(seed, 6, 70)
    got = pointintime.features(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES), chunk=chunk, bucket=bucket)
    assert got.columns == ["sale_id", "d", "t_us", "label", "n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "line_cents", "n_items", "last_click_id"]
    assert rows(got) == plain(clicks, sales, lines)


def test_sizes_of_chunks_change_nothing(spark):
    sf = "/root/testdata/sf0.001"
    tables = [spark.read.parquet(f"{sf}/{t}.parquet") for t in ("clicks", "sales", "sale_lines")]
    whole, cut = pointintime.features(*tables), pointintime.features(*tables, chunk=100, bucket=1000)
    assert whole.count() and rows(whole) == rows(cut)


def test_other_windows(spark):
    clicks, sales, lines = made(5, 3, 40)
    frames = [spark.createDataFrame(x, s) for x, s in ((clicks, CLICKS), (sales, SALES), (lines, LINES))]
    assert rows(pointintime.features(*frames, windows=(1, 5, 30), chunk=20)) == plain(clicks, sales, lines, (1, 5, 30))


def test_empty_tables(spark):
    clicks, sales, lines = (spark.createDataFrame([], s) for s in (CLICKS, SALES, LINES))
    assert rows(pointintime.features(clicks, sales, lines)) == []
    one = spark.createDataFrame([(7, 1, "done", 2.5, datetime(2024, 1, 1), datetime(2024, 1, 1), 1)], SALES)
    for r in rows(pointintime.features(clicks, one, lines)):
        assert r[3] is False and r[4:] == (0, 0, 0, 1, 250, 0, 0, 0, None)


def test_the_sessions_zone_changes_nothing(spark):
    clicks, sales, lines = made(6, 3, 20)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = rows(pointintime.features(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES), chunk=10))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == plain(clicks, sales, lines)


def test_nothing_is_broadcast(spark):
    tables = [spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("clicks", "sales", "sale_lines")]
    plans = [pointintime.facts(*tables)._jdf.queryExecution().executedPlan().toString(), pointintime.features(*tables, chunk=100)._jdf.queryExecution().executedPlan().toString()]
    assert not any("Broadcast" in p for p in plans)
