"""Interval overlap join of sales and click sessions: relations of intervals, counted a sale.

Sessions come from clicks without a sort of a client's rows: clicks of one quarter of an hour
always share a session, so they collapse first; quarters chain into runs within a day, and
only the first and last run of each day meet those of other days. Both sides are then
intervals of slots. Sessions of equal client and slots collapse to one weighted interval, so
what a client has of them is bounded by the calendar, not by its clicks. Sales of a client
are salted over units of `unit_sales`; each unit gets the client's session intervals, and
blocks of many units run one IEJoin in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved, ship_package

QUARTER_US = 15 * 60 * 1_000_000
SLOT_US = 6 * 3600 * 1_000_000
DAY_QUARTERS = 96
UNIT_SALES, UNIT_SESSIONS = 8192, 16384  # a unit's sales, and the session intervals it meets at once
BLOCK_ROWS = 1 << 16
# The sale starts earlier, equally, later than the session; within each, it ends earlier, equally, later.
RELATIONS = ("overlaps", "finished_by", "contains", "starts", "equals", "started_by", "during", "finishes", "overlapped_by")
OPEN = 1 << 40  # the slot of an end that is open: later than any, equal to itself


def micros(df: DataFrame, column: str) -> Column:
    """Whole microseconds since 1970 of a timestamp; one without a zone counts as UTC, whatever the session's zone."""
    c = F.col(column)
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        gap = f"(`{column}` - timestamp_ntz'1970-01-01')"
        part = lambda unit: F.expr(f"extract({unit} FROM {gap})")
        return part("day").cast("long") * 86_400_000_000 + part("hour").cast("long") * 3_600_000_000 + part("minute").cast("long") * 60_000_000 + (part("second") * 1_000_000).cast("long")
    return F.unix_micros(c)


def _floor(c: Column, step: int) -> Column:
    return F.call_function("div", c - F.pmod(c, F.lit(step)), F.lit(step))


def _runs(pieces: DataFrame, by: list[str], gap_us: int) -> DataFrame:
    """pieces(client_id, lo, hi, err, ...) with `run`: pieces of one `by` that follow within gap_us share a number."""
    w = Window.partitionBy(*by).orderBy("lo")
    starts = F.coalesce((F.col("lo") - F.lag("hi").over(w) > gap_us).cast("int"), F.lit(1))
    return pieces.withColumn("_starts", starts).withColumn("run", F.sum("_starts").over(w)).drop("_starts")


def click_sessions(clicks: DataFrame) -> DataFrame:
    """(client_id, first_us, last_us, open) of clicks(client_id, ts, kind); rows without a client or time are ignored.

    A click over 15 minutes after the client's previous begins another session. A session is
    open if a click at its last time is an error. Repeated clicks change nothing.
    """
    rows = clicks.select("client_id", micros(clicks, "ts").alias("us"), F.coalesce(F.col("kind") == "error", F.lit(False)).cast("int").alias("err")).filter("client_id IS NOT NULL AND us IS NOT NULL")
    quarter = _floor(F.col("us"), QUARTER_US)
    pieces = rows.withColumn("quarter", quarter).groupBy("client_id", "quarter").agg(F.min("us").alias("lo"), F.max(F.struct("us", "err")).alias("top"))
    pieces = pieces.select("client_id", _floor(F.col("quarter"), DAY_QUARTERS).alias("day"), "lo", F.col("top.us").alias("hi"), F.col("top.err").alias("err"))
    merged = [F.min("lo").alias("lo"), F.max(F.struct("hi", "err")).alias("top")]
    daily = _runs(pieces, ["client_id", "day"], QUARTER_US).groupBy("client_id", "day", "run").agg(*merged)
    daily = daily.withColumn("runs", F.max("run").over(Window.partitionBy("client_id", "day"))).select("client_id", "lo", F.col("top.hi").alias("hi"), F.col("top.err").alias("err"), ((F.col("run") > 1) & (F.col("run") < F.col("runs"))).alias("whole"))
    daily = saved(daily, "session-runs")  # read twice
    # at most two rows a client and day meet here, whatever the clicks
    edges = _runs(daily.filter("NOT whole"), ["client_id"], QUARTER_US).groupBy("client_id", "run").agg(*merged).select("client_id", "lo", "top.hi", "top.err")
    both = daily.filter("whole").select("client_id", "lo", "hi", "err").union(edges)
    return both.select("client_id", F.col("lo").alias("first_us"), F.col("hi").alias("last_us"), (F.col("err") == 1).alias("open"))


def sale_intervals(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """(sale_id, client_id, first_us, last_us, open, times): from sold_at to the latest of it and the lines' shipped_at.

    Rows without a client or sold_at are ignored; lines without a sale or time count for
    nothing. Rows of a sale that are equal in all this become one, counted in `times`.
    """
    shipped = lines.select("sale_id", micros(lines, "shipped_at").alias("shipped")).filter("sale_id IS NOT NULL AND shipped IS NOT NULL").groupBy("sale_id").agg(F.max("shipped").alias("shipped"))
    rows = sales.select("sale_id", "client_id", micros(sales, "sold_at").alias("first_us"), F.coalesce(F.col("status") == "open", F.lit(False)).alias("open")).filter("client_id IS NOT NULL AND first_us IS NOT NULL")
    ends = rows.join(shipped, "sale_id", "left").withColumn("last_us", F.greatest("first_us", "shipped"))
    return ends.groupBy("sale_id", "client_id", "first_us", "last_us", "open").agg(F.count("*").alias("times"))


def overlapping(unit_r: np.ndarray, s: np.ndarray, e: np.ndarray, unit_q: np.ndarray, a: np.ndarray, b: np.ndarray, *, at_once: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (r, q) of equal unit with s[r] <= b[q] and e[r] >= a[q], r ascending over all chunks.

    IEJoin. One order of the q goes by end, one by start; a permutation leads from the second
    to places in the first. A row r needs the places from its offset in the order of ends on
    that hold a q whose start its end has reached. Places stand in bitmaps of 64, and for each
    bitmap its states are kept as starts are passed one by one, so the state at r is looked
    up by an offset in the order of starts, and set bits are read off.
    """
    if not len(s) or not len(a):
        return
    low = min(s.min(), a.min())
    span = int(max(e.max(), b.max()) - low) + 2
    by_end = np.lexsort((b, unit_q))
    units, n = unit_q[by_end], len(a)
    first_of_unit = np.flatnonzero(np.r_[True, units[1:] != units[:-1]])
    place_in_unit = np.arange(n) - np.repeat(first_of_unit, np.diff(np.r_[first_of_unit, n]))
    word = np.cumsum(place_in_unit % 64 == 0) - 1
    bit = (place_in_unit % 64).astype(np.uint64)
    first_place = np.flatnonzero(place_in_unit % 64 == 0)  # of each bitmap
    end_key = units * span + (b[by_end] - low)
    by_start = np.lexsort((a[by_end], word))  # place in the order of starts -> place in the order of ends
    start_key = word * span + (a[by_end][by_start] - low)
    passed = np.r_[np.uint64(0), np.cumsum(np.uint64(1) << bit[by_start], dtype=np.uint64)]
    offset = np.searchsorted(end_key, unit_r * span + (s - low))
    end_of_unit = np.searchsorted(units, unit_r, side="right")
    live = np.flatnonzero(offset < end_of_unit)
    w_from, w_to = word[offset[live]], word[end_of_unit[live] - 1]
    todo = np.cumsum(w_to - w_from + 1)
    at = 0
    while at < len(live):
        done = todo[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(todo, done + at_once, side="right")))
        counts = (w_to - w_from + 1)[at:upto]
        r = np.repeat(live[at:upto], counts)
        k = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
        w = np.repeat(w_from[at:upto], counts) + k
        state = passed[np.searchsorted(start_key, w * span + (e[r] - low), side="right")] - passed[first_place[w]]
        cut = np.where(k == 0, offset[r] - first_place[w], 0).astype(np.uint64)
        state = (state >> cut) << cut
        some = np.flatnonzero(state)
        bits = np.unpackbits(state[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, j = np.nonzero(bits)
        yield r[some[i]], by_end[first_place[w[some[i]]] + j]
        at = upto


def _count_relations(table: pa.Table) -> pa.Table:
    """Sums a sale and relation over one block of units."""
    lo, hi, weight, crc, salt, cut, sale = (table[c].to_numpy(zero_copy_only=False) for c in ("lo", "hi", "weight", "crc", "salt", "cut", "is_sale"))
    client = table["client_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, unit = np.unique((client * (1 + salt.max(initial=0)) + salt) * (1 + cut.max(initial=0)) + cut, return_inverse=True)
    r, q = np.flatnonzero(sale), np.flatnonzero(~sale)
    s, e, times, a, b, many, crc = lo[r], hi[r], weight[r], lo[q], hi[q], weight[q], crc[q]
    n, slots, sums = (np.zeros(9 * len(r), np.int64) for _ in range(3))
    for i, j in overlapping(unit[r], s, e, unit[q], a, b):
        code = 9 * i + 3 * (1 + np.sign(s[i] - a[j])) + 1 + np.sign(e[i] - b[j])
        pairs = times[i] * many[j]
        np.add.at(n, code, pairs)
        np.add.at(slots, code, pairs * (np.minimum(e[i], b[j]) - np.maximum(s[i], a[j]) + 1))
        np.add.at(sums, code, times[i] * crc[j])
    at = np.flatnonzero(n)
    kind = at % 9
    both_open = (e[at // 9] == OPEN) & (kind % 3 == 1)
    return pa.table({"sale_id": table["sale_id"].take(pa.array(r[at // 9])), "relation": pa.array(RELATIONS, pa.string()).take(pa.array(kind)), "n_pairs": pa.array(n[at]), "overlap_slots": pa.array(slots[at], mask=both_open), "sessions_crc": pa.array(sums[at])})


def relate_intervals(sales: DataFrame, sessions: DataFrame, *, slot_us: int = SLOT_US, unit_sales: int = UNIT_SALES, unit_sessions: int = UNIT_SESSIONS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(sale_id, relation, n_pairs, overlap_slots, sessions_crc) of sale_intervals and click_sessions that share a slot.

    Starts and ends are floored to slots, both inclusive, and only slots are compared; open
    ends are later than any and equal each other. overlap_slots is null where both are open.
    sessions_crc sums the crc32 of the sessions' exact first times as decimal text. Rows
    that share a sale_id are summed, rows without one too. Sales and sessions without
    partners give no row; empty tables give none.

    No client is one task: its sales go to units of about unit_sales by a hash of their id,
    and its session intervals, where the calendar allows more than unit_sessions, are cut
    too; sent session rows are at most the client's intervals times its units.
    """
    spark = sales.sparkSession
    ship_package(spark)
    kind = sales.schema["sale_id"].dataType.simpleString()
    slot = lambda c: _floor(F.col(c), slot_us)
    ends = F.when(F.col("open"), F.lit(OPEN)).otherwise(slot("last_us")).alias("hi")
    r = saved(sales.groupBy("sale_id", "client_id", slot("first_us").alias("lo"), ends).agg(F.sum("times").alias("weight")), "sale-slots")
    crc = F.crc32(F.col("first_us").cast("string").cast("binary"))
    q = saved(sessions.groupBy("client_id", slot("first_us").alias("lo"), ends).agg(F.count("*").alias("weight"), F.sum(crc).alias("crc")), "session-slots")
    count = lambda df, name: df.groupBy("client_id").agg(F.count("*").alias(name))
    pieces = lambda n, size, name: F.ceil(F.col(n) / size).cast("int").alias(name)
    cuts = saved(count(r, "n_sales").join(count(q, "n_sessions"), "client_id").select("client_id", "n_sales", "n_sessions", pieces("n_sales", unit_sales, "salts"), pieces("n_sessions", unit_sessions, "cuts")), "client-cuts")
    rows = int(cuts.agg(F.sum(F.col("n_sales") * F.col("cuts") + F.col("n_sessions") * F.col("salts"))).first()[0] or 0)
    blocks = max(1, -(-rows // block_rows))
    cuts = cuts.select("client_id", "salts", "cuts").hint("merge")  # a row a client: never broadcast
    deal = lambda by, n: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = r.join(cuts, "client_id").withColumn("salt", deal(["sale_id", "lo", "hi"], "salts")).withColumn("cut", each("cuts")).withColumns({"is_sale": F.lit(True), "crc": F.lit(0).cast("long")})
    right = q.join(cuts, "client_id").withColumn("cut", deal(["lo", "hi"], "cuts")).withColumn("salt", each("salts")).withColumns({"is_sale": F.lit(False), "sale_id": F.lit(None).cast(kind)})
    columns = ["client_id", "salt", "cut", "is_sale", "sale_id", "lo", "hi", "weight", "crc"]
    both = left.select(*columns).union(right.select(*columns))
    both = both.withColumn("block", F.pmod(F.xxhash64("client_id", "salt", "cut"), F.lit(blocks)).cast("int"))
    counted = both.groupBy("block").applyInArrow(_count_relations, f"sale_id {kind}, relation string, n_pairs long, overlap_slots long, sessions_crc long")
    sums = [F.sum(c).alias(c) for c in ("n_pairs", "overlap_slots", "sessions_crc")]
    return counted.groupBy("sale_id", "relation").agg(*sums)
