"""A point-in-time feature table by push-style difference arrays.

A sale asks at its own time t what was known of its client; each click, sale and
line is known from its start (when it happened, arrived and was shipped) until
it leaves a window of d days. So a row does not look for the probes that see it:
it pushes. In each chunk of a client's time the probes are ranked, a row's first
and last affected probe are found by ``searchsorted``, its value is added at the
one end and taken off at the other (``np.add.at``), and one ``cumsum`` gives all
probes their sums. The last click is a running maximum of the same kind. Items
are counted once: an item's later interval starts where its earlier ones end.

A client of few rows is one chunk. One of many is cut into days and busy days
into equal parts (``CHUNK`` rows each); a row then goes only to the chunks where
an end of one of its intervals or its own probe lies. For all chunks in between,
and after, it counts in the chunk's constant: running sums over the chunks of a
client, by day and then within the day, from sums that are made before anything
moves. Chunks are dealt by hash into bounded buckets, a bucket is one call.

Nothing is broadcast and nothing but the number of rows reaches the driver; the
narrow facts are written once to the shared folder. Times are microseconds since
1970 in UTC; days have 24 hours.

Defined results: sales without a client or a time have no row and are no
history; one with a null sale_id has crc32 of the empty text (zero) as its
delay and no lines; history that lacks a time it needs is never known; rows of
sales or lines that repeat count as often as they occur, fully equal clicks
once; null and non-finite amounts are 0; a null click_id is the smallest; empty
tables give an empty or zero result; extra columns matter only to whether two
clicks are fully equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, stored

#: Days of the windows, days that a label looks ahead, minutes until a row that arrived is known, seconds within which a probe is delayed.
WINDOWS, AHEAD, KNOWN_AFTER, DELAY = (2, 14), 7, 240, 259_200
#: Rows of a client's chunk, and of a bucket of chunks.
CHUNK, BUCKET = 20_000, 60_000
DAY = 86_400_000_000
#: Chunks are numbered day by day, with room for so many parts of a day.
PARTS = 1 << 20
#: The chunk of a client that has one.
WHOLE = -(1 << 62)
CLICK, PURCHASE, SALE, LINE, ITEM = range(5)
SUMS = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "line_cents", "n_items")
#: Which kinds of rows a sum adds up, and whether their numbers or their cents.
ADDS = {
    "n_clicks": ((CLICK, PURCHASE), "n"), "n_purchases": ((PURCHASE,), "n"), "click_cents": ((CLICK, PURCHASE), "cents"), "n_sales": ((SALE,), "n"),
    "sale_cents": ((SALE,), "cents"), "n_lines": ((LINE,), "n"), "line_cents": ((LINE,), "cents"), "n_items": ((ITEM,), "n"),
}


def micros(df: DataFrame, name: str) -> Column:
    """A time as microseconds since 1970, those without a zone read as UTC whatever the session's."""
    c = F.col(f"`{name}`")
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    second = (F.expr(f"extract(SECOND FROM `{name}`)") * 1_000_000).cast("long")
    return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * DAY + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + second


def cents(name: str) -> Column:
    """Whole cents of an amount, rounded half up; 0 of none."""
    c = F.col(f"`{name}`").cast("double")
    return F.when(F.abs(c) < F.lit(float("inf")), F.floor(c * 100 + 0.5).cast("long")).otherwise(F.lit(0).cast("long"))


def facts(clicks: DataFrame, sales: DataFrame, lines: DataFrame, known_after: int = KNOWN_AFTER, delay: int = DELAY) -> DataFrame:
    """client, kind, start, base, item, n, cents, id, t: what pushes, and (kind SALE) what asks.

    ``base`` is the time that windows look at, ``start`` when the row is known,
    ``t`` when a sale asks; lines come summed by sale time and start, items with
    their first start.
    """
    late, none = known_after * 60_000_000, F.lit(None).cast("long")
    c = clicks.where(F.col("client_id").isNotNull() & F.col("ts").isNotNull() & F.col("arrived_at").isNotNull()).distinct()
    c = c.select(
        F.col("client_id").cast("long").alias("client"), F.when(F.col("kind") == "purchase", F.lit(PURCHASE)).otherwise(F.lit(CLICK)).alias("kind"),
        F.greatest(micros(c, "ts"), micros(c, "arrived_at") + late).alias("start"), micros(c, "ts").alias("base"), none.alias("item"), F.lit(1).cast("long").alias("n"),
        cents("value").alias("cents"), F.col("click_id").cast("long").alias("id"), none.alias("t"),
    )
    s = sales.where(F.col("client_id").isNotNull() & F.col("sold_at").isNotNull())
    sold = micros(s, "sold_at")
    after = F.pmod(F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary")), F.lit(delay)) * 1_000_000
    known = F.when(F.col("arrived_at").isNotNull(), F.greatest(sold, micros(s, "arrived_at") + late))
    s = s.select(
        F.col("client_id").cast("long").alias("client"), F.lit(SALE).alias("kind"), known.alias("start"), sold.alias("base"), none.alias("item"), F.lit(1).cast("long").alias("n"),
        cents("total").alias("cents"), F.col("sale_id").cast("long").alias("id"), (sold + after).alias("t"),
    )
    own = lines.where(F.col("sale_id").isNotNull() & F.col("shipped_at").isNotNull())
    own = own.select(F.col("sale_id").cast("long").alias("id"), micros(own, "shipped_at").alias("shipped"), F.col("item_id").cast("long").alias("item"), cents("amount").alias("cents"))
    # of a sale with very many lines, AQE splits the lines
    own = own.join(s.where(F.col("start").isNotNull() & F.col("id").isNotNull()).select("id", "client", "start", "base").hint("merge"), "id")
    first = F.greatest("start", "shipped")
    as_line = F.struct(F.lit(LINE).alias("kind"), none.alias("item"), first.alias("when"), F.lit(1).cast("long").alias("n"), F.col("cents"))
    as_item = F.struct(F.lit(ITEM).alias("kind"), F.col("item"), none.alias("when"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("cents"))
    own = own.select("client", "base", first.alias("start"), F.explode(F.array(as_line, as_item)).alias("r")).where((F.col("r.kind") == LINE) | F.col("r.item").isNotNull())
    own = own.groupBy("client", "base", "r.kind", "r.item", "r.when").agg(F.min("start").alias("start"), F.sum("r.n").alias("n"), F.sum("r.cents").alias("cents"))
    own = own.select("client", "kind", "start", "base", "item", F.greatest("n", F.lit(1).cast("long")).alias("n"), "cents", none.alias("id"), none.alias("t"))
    return c.unionByName(s).unionByName(own)


def bits(windows: tuple[int, ...]) -> dict[str, int]:
    """A bit for each end that a row may have in a chunk."""
    names = [f"{side}{d}" for side in ("lo", "hi") for d in windows] + ["label_lo", "label_hi", "probe"]
    return {name: 1 << k for k, name in enumerate(names)}


def ends(windows: tuple[int, ...], ahead: int) -> dict[str, Column]:
    """When each end lies, null where the row has none; an interval that is over before it starts has no ends."""
    out = {}
    for d in windows:
        hi = F.col("base") + d * DAY
        lo = F.greatest(F.col("start"), F.col("reach") + d * DAY)
        there = F.col("start").isNotNull() & (lo < hi)
        out |= {f"lo{d}": F.when(there, lo), f"hi{d}": F.when(there, hi)}
    sale = F.col("kind") == SALE
    return out | {"label_lo": F.when(sale, F.col("base") - ahead * DAY), "label_hi": F.when(sale, F.col("base")), "probe": F.col("t")}


def day_of(us: Column) -> Column:
    return ((us - F.pmod(us, F.lit(DAY))) / DAY).cast("int")


def chunk_of(us: Column) -> Column:
    """The chunk of a busy client that a time lies in; ``parts`` maps its busy days to their number of parts."""
    parts = F.coalesce(F.element_at("parts", day_of(us)), F.lit(1))
    return day_of(us).cast("long") * PARTS + F.floor(F.pmod(us, F.lit(DAY)) / DAY * parts).cast("long")


def grid(rows: DataFrame, windows: tuple[int, ...], ahead: int, chunk: int) -> DataFrame:
    """client, parts: of each client with more than ``chunk`` rows, the days that have more than one part and how many.

    The days of base, start and t are counted before anything moves, so a client
    comes to no more rows than it has such days.
    """
    each = F.array(*(F.struct(F.lit(k).alias("of"), day_of(F.col(c)).alias("day")) for k, c in enumerate(("base", "start", "t"))))
    daily = rows.select("client", F.explode(each).alias("x")).where("x.day IS NOT NULL").groupBy("client", "x.of", "x.day").count()
    many = daily.groupBy("client").agg(F.sum(F.when(F.col("of") == 0, F.col("count"))).alias("all")).where(F.col("all") > chunk).select("client")
    seen = F.when(F.col("of") == 0, F.array(F.col("day"), F.col("day") - ahead, *(F.col("day") + d for d in windows))).otherwise(F.array("day"))
    days = daily.select("client", "count", F.explode(seen).alias("day")).groupBy("client", "day").agg(F.sum("count").alias("count")).join(many.hint("shuffle_hash"), "client")
    parts = F.least(F.ceil(F.col("count") / chunk), F.lit(PARTS)).cast("int")
    full = F.when(F.col("count") > chunk, F.struct(F.col("day"), parts.alias("n")))
    return days.groupBy("client").agg(F.map_from_entries(F.sort_array(F.collect_list(full))).alias("parts"))


def reached(items: DataFrame, *keys: str) -> DataFrame:
    """``reach``: the latest sale time of the item's earlier starts among rows of the same keys, null if none."""
    w = Window.partitionBy(*keys).orderBy(F.col("start").asc_nulls_first(), "base").rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("reach", F.max("base").over(w))


def running(rows: DataFrame, keys: list[str], sums: dict[str, Column], most: dict[str, Column]) -> DataFrame:
    """For each chunk of some keys, the sums and maxima over the chunks before it.

    In two steps, days and the chunks of a day, so that no task sees all chunks
    of a busy key: what the days before leave stands ahead of a day's chunks.
    """
    names = [*sums, *most]

    def agg(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        return df.agg(*((F.sum(c) if k in sums else F.max(c)).alias(k) for k, c in columns.items()))

    def before(df: DataFrame, by: list[str], order: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({k: F.coalesce(F.sum(k).over(w), F.lit(0).cast("long")) if k in sums else F.max(k).over(w) for k in names})

    day = F.floor(F.col("chunk") / F.lit(float(PARTS))).cast("long")
    chunks = agg(rows.groupBy(*keys, "chunk"), sums | most).withColumn("_day", day)
    days = before(agg(chunks.groupBy(*keys, "_day"), {k: F.col(k) for k in names}), keys, "_day").withColumn("chunk", F.lit(None).cast("long"))
    return before(chunks.unionByName(days), [*keys, "_day"], "chunk").where(F.col("chunk").isNotNull()).drop("_day")


def constants(rows: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """For each chunk of a busy client, what all rows of earlier chunks leave to it."""
    bit = bits(windows)
    has = lambda name: F.col("mask").bitwiseAND(bit[name]) != 0
    sums = {}
    for d in windows:
        sign = F.when(has(f"lo{d}"), 1).when(has(f"hi{d}"), -1).otherwise(0)
        for name, (kinds, what) in ADDS.items():
            sums[f"{name}_{d}"] = F.when(F.col("kind").isin(*kinds), sign * F.col(what)).otherwise(0).cast("long")
    sums["label"] = F.when(has("label_lo"), 1).when(has("label_hi"), -1).otherwise(0).cast("long")
    click = F.col("kind").isin(CLICK, PURCHASE) & has(f"lo{max(windows)}")
    last = F.when(click, F.struct(F.col("base").alias("ts"), F.col("id").isNotNull().alias("named"), F.coalesce("id", F.lit(0).cast("long")).alias("id")))
    out = running(rows, ["client"], sums, {"last": last})
    last = [F.col("last.ts").alias("last_ts"), F.col("last.named").cast("long").alias("last_named"), F.col("last.id").alias("last_id"), F.col("last").isNotNull().cast("long").alias("last_there")]
    return out.select("client", "chunk", *sums, *last)


def numbers(t: pa.Table, name: str, none: int = 0) -> np.ndarray:
    return pc.fill_null(t[name], none).to_numpy().astype(np.int64, copy=False)


def pushed(rows: pa.Table, before: pa.Table, windows: tuple[int, ...], ahead: int) -> dict[str, np.ndarray]:
    """All probes of a bucket's chunks with their sums: difference arrays over ranked probe times.

    One array holds the probes of all chunks, by chunk and time, with a slot
    after each chunk's last for ends that no probe of it sees.
    """
    bit = bits(windows)
    client, chunk, mask, kind, start, base, n, money, ident = (numbers(rows, c) for c in ("client", "chunk", "mask", "kind", "start", "base", "n", "cents", "id"))
    has_reach, named = rows["reach"].is_valid().to_numpy(), rows["id"].is_valid().to_numpy()
    reach, t = numbers(rows, "reach"), numbers(rows, "t")
    # chunks in order, and each row's
    order = np.lexsort((chunk, client))
    new = np.r_[True, (np.diff(client[order]) != 0) | (np.diff(chunk[order]) != 0)] if len(order) else np.zeros(0, bool)
    g = np.empty(len(order), np.int64)
    g[order] = np.cumsum(new) - 1
    groups = int(new.sum())
    # probes ranked by chunk and time
    asks = np.flatnonzero(mask & bit["probe"])
    asks = asks[np.lexsort((ident[asks], t[asks], g[asks]))]
    pg, pt = g[asks], t[asks]
    times, rank = np.unique(pt, return_inverse=True)
    key = pg * (len(times) + 1) + rank
    slots = len(asks) + groups
    probe = np.arange(len(asks)) + pg
    first = np.searchsorted(pg, np.arange(groups)) + np.arange(groups)  # each chunk's first slot

    def slot(some: np.ndarray, when: np.ndarray) -> np.ndarray:
        """The first probe at or after a time in the row's own chunk, or the slot after its last."""
        return np.searchsorted(key, g[some] * (len(times) + 1) + np.searchsorted(times, when)) + g[some]

    def summed(parts: list[tuple[np.ndarray, np.ndarray | int]]) -> np.ndarray:
        diff = np.zeros(slots + 1, np.int64)
        for at, value in parts:
            np.add.at(diff, at + 1, value)
        total = np.cumsum(diff)  # total[s]: all before slot s
        return total[probe + 1] - total[first[pg]]

    # constants of the chunks that have some, zero for the others
    where, held = {k: i for i, k in enumerate(zip(client[order][new].tolist(), chunk[order][new].tolist(), strict=True))}, np.empty(0, np.int64)
    if before.num_rows:  # a side without rows comes without columns
        held = np.array([where[k] for k in zip(before["client"].to_pylist(), before["chunk"].to_pylist(), strict=True)], np.int64)

    def constant(name: str) -> np.ndarray:
        out = np.zeros(groups, np.int64)
        if len(held):
            out[held] = numbers(before, name)
        return out[pg]

    ahead_in, ahead_out = np.flatnonzero(mask & bit["label_lo"]), np.flatnonzero(mask & bit["label_hi"])
    label = summed([(slot(ahead_in, base[ahead_in] - ahead * DAY), 1), (slot(ahead_out, base[ahead_out]), -1)]) + constant("label")
    out = {"ask": asks, "t": pt, "label": label > 0}
    for d in windows:
        lo = np.where(has_reach, np.maximum(start, reach + d * DAY), start)
        into, outof = np.flatnonzero(mask & bit[f"lo{d}"]), np.flatnonzero(mask & bit[f"hi{d}"])
        at_in, at_out = slot(into, lo[into]), slot(outof, base[outof] + d * DAY)
        for name, (kinds, what) in ADDS.items():
            value, a, b = (n if what == "n" else money), np.isin(kind[into], kinds), np.isin(kind[outof], kinds)
            out[f"{name}_{d}"] = summed([(at_in[a], value[into[a]]), (at_out[b], -value[outof[b]])]) + constant(f"{name}_{d}")
    # the last click: a running maximum of ranks, chunk by chunk
    clicks = np.flatnonzero((mask & bit[f"lo{max(windows)}"] != 0) & (kind <= PURCHASE))
    by = clicks[np.lexsort((ident[clicks], named[clicks], base[clicks]))]
    best = np.zeros(slots, np.int64)
    np.maximum.at(best, slot(by, start[by]), np.arange(1, len(by) + 1))
    apart = np.zeros(slots, np.int64)
    apart[first] = 1
    apart = (np.cumsum(apart) - 1) * (len(by) + 1)
    best = (np.maximum.accumulate(best + apart) - apart)[probe] if slots else best
    ts, ok, click = (np.r_[x, y[by]] for x, y in ((np.int64(-1 << 62), base), (False, named), (np.int64(0), ident)))
    ts, ok, click, there = ts[best], ok[best], click[best], best > 0
    ts2, ok2, click2, there2 = constant("last_ts"), constant("last_named") > 0, constant("last_id"), constant("last_there") > 0
    later = there2 & (~there | (ts2 > ts) | ((ts2 == ts) & ((ok2 & ~ok) | ((ok2 == ok) & (click2 > click)))))
    ts, ok, click, there = np.where(later, ts2, ts), np.where(later, ok2, ok), np.where(later, click2, click), there | there2
    for d in windows:
        out[f"last_{d}"], out[f"last_known_{d}"] = click, there & ok & (ts > pt - d * DAY)
    return out


def features(clicks: DataFrame, sales: DataFrame, lines: DataFrame, windows: tuple[int, ...] = WINDOWS, ahead: int = AHEAD, known_after: int = KNOWN_AFTER, delay: int = DELAY, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """A row for each sale and window: sale_id, d, t_us, label, SUMS and last_click_id."""
    all_rows = stored(facts(clicks, sales, lines, known_after, delay), "facts")
    # a table of its own: rows of a busy client can then be split in the join
    spans = stored(grid(all_rows, windows, ahead, chunk), "grid")
    known = stored(all_rows.join(spans.hint("shuffle_hash"), "client", "left").withColumn("busy", F.col("parts").isNotNull()), "spans", "busy")
    few, many = known.where(~F.col("busy")), known.where(F.col("busy"))
    item, no_reach = F.col("kind") == ITEM, F.lit(None).cast("long")
    few = few.where(~item).withColumn("reach", no_reach).unionByName(reached(few.where(item), "client", "item"))
    # items of busy clients: within a chunk of starts; what the chunks before leave stands ahead as a row without a start
    own = many.where(item).withColumn("chunk", chunk_of(F.col("start")))
    far = running(own, ["client", "item"], {}, {"base": F.col("base")}).where(F.col("base").isNotNull())
    own = reached(own.unionByName(far, allowMissingColumns=True), "client", "item", "chunk").where(F.col("start").isNotNull()).drop("chunk")
    many = many.where(~item).withColumn("reach", no_reach).unionByName(own)
    at, bit = ends(windows, ahead), bits(windows)
    forget(all_rows, spans)
    columns = ["client", "chunk", "mask", "kind", "start", "base", "reach", "n", "cents", "id", "t"]
    each = F.filter(F.array(*(F.struct(F.lit(bit[k]).alias("mask"), c.alias("us")) for k, c in at.items())), lambda e: e["us"].isNotNull())
    whole = F.array(F.struct(F.aggregate(each, F.lit(0), lambda a, e: a + e["mask"]).alias("mask"), F.lit(WHOLE).alias("chunk")))
    # all ends of a client of one chunk at once, each end of a busy one where it lies
    places = F.when(F.col("busy"), F.transform(each, lambda e: F.struct(e["mask"].alias("mask"), chunk_of(e["us"]).alias("chunk")))).otherwise(whole)
    sent = few.unionByName(many).withColumn("_at", F.explode(places)).withColumns({"chunk": F.col("_at.chunk"), "mask": F.col("_at.mask")})
    sent = stored(sent.select(*columns, "busy"), "ends", "busy")
    deal = F.pmod(F.xxhash64("client", "chunk"), F.lit(max(1, -(-sent.count() // bucket)))).alias("bucket")
    rows, held = sent.select(deal, *columns), constants(sent.where("busy"), windows).select(deal, "*")
    forget(known)

    def solve(rows: pa.Table, before: pa.Table) -> pa.Table:
        x = pushed(rows, before, windows, ahead)
        sale, size = rows["id"].combine_chunks().take(pa.array(x["ask"])) if rows.num_rows else pa.array([], pa.int64()), len(x["ask"])
        tables = [
            pa.table({"sale_id": sale, "d": pa.array(np.full(size, d, np.int32)), "t_us": pa.array(x["t"]), "label": pa.array(x["label"])} | {k: pa.array(x[f"{k}_{d}"]) for k in SUMS} | {"last_click_id": pa.array(x[f"last_{d}"], mask=~x[f"last_known_{d}"])})
            for d in windows
        ]
        return pa.concat_tables(tables)

    schema = "sale_id long, d int, t_us long, label boolean, " + ", ".join(f"{k} long" for k in SUMS) + ", last_click_id long"
    return rows.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(solve, schema)
