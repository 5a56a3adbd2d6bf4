"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for each dimension, set where the value is above zero. Codes are
cut into m segments of `segment_bits`, and each segment has a table of its values. By the
pigeonhole principle, codes within distance m * (r + 1) - 1 of a query agree with it up to r
bits in some segment. So the search looks up the values at distance 0, then 1, 2, ... from
the query's in every table, verifies each candidate by its full Hamming distance, and stops
a query at radius r once its kth verified distance is at most m * (r + 1) - 1: nothing unseen
can be nearer.

The tables are one for all codes. Each is dealt over parts by the leading bits of its values
(and by a hash of the code, where many codes share those), which are stored once. In every
round the queries not yet covered go to the parts that values at the round's radius can lie
in; parts answer with their k + 1 nearest, these are merged, and covered queries are done. As
many radii make a round as are cheaper than a round of their own; within it a part stops a
query as soon as its own kth distance covers it. A code is a candidate once: at the radius of
its nearest segment, in the first such segment's table.

Equal vectors are one code with its k + 1 smallest ids, cut before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .shared import saved

PART_CODES = 16_000  # codes of a part of a table, about
LOOKUPS = 32 << 20  # values looked up in the first round, at most, over all queries
CELLS = 1 << 20  # looked up at a time


def binary_codes(vectors: np.ndarray) -> np.ndarray:
    """(n, d) values to (n, ceil(d / 64)) words; bit set where the value is above 0."""
    bits = np.zeros((len(vectors), -(-vectors.shape[1] // 64) * 64), np.uint8)
    bits[:, : vectors.shape[1]] = vectors > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def segment(codes: np.ndarray, j: int, bits: int) -> np.ndarray:
    """Values of segment j of codes (n, words)."""
    word, shift = divmod(j * bits, 64)
    return ((codes[:, word] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def masks(bits: int, radius: int) -> np.ndarray:
    """All numbers of so many bits with `radius` bits set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), radius)], np.int64)


class Part:
    """A part of segment j's table: codes (n, words) whose values have the leading bits `prefix`."""

    def __init__(self, codes: np.ndarray, j: int, prefix: int, *, bits: int, low_bits: int, count: int):
        self.j, self.prefix, self.bits, self.low_bits, self.count = j, prefix, bits, low_bits, count
        low = segment(codes, j, bits) & ((1 << low_bits) - 1)
        self.order = np.argsort(low, kind="stable")
        self.codes = codes[self.order]
        self.values, self.starts = np.unique(low[self.order], return_index=True)
        self.sizes = np.diff(np.append(self.starts, len(low)))

    def at_radius(self, queries: np.ndarray, radius: int, among: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query numbers, code numbers, distances), some at a time, of the candidates that these queries first meet here at this radius."""
        own = segment(queries, self.j, self.bits)
        apart = np.bitwise_count((own >> self.low_bits) ^ self.prefix).astype(np.int64)
        low = own & ((1 << self.low_bits) - 1)
        for lead in np.unique(apart):
            left = radius - int(lead)
            if not 0 <= left <= self.low_bits or not len(self.values):
                continue
            rows = among[apart[among] == lead]
            wanted = masks(self.low_bits, left) if radius <= 4 else None
            step = max(1, CELLS // min(len(self.values), len(wanted) if wanted is not None else len(self.values)))
            for some in (rows[a : a + step] for a in range(0, len(rows), step)):
                if wanted is not None and len(wanted) < len(self.values):
                    near = low[some][:, None] ^ wanted
                    at = np.minimum(np.searchsorted(self.values, near), len(self.values) - 1)
                    which, cell = np.nonzero(self.values[at] == near)
                    at = at[which, cell]
                else:  # fewer values than masks: measure the values
                    which, at = np.nonzero(np.bitwise_count(self.values ^ low[some][:, None]) == left)
                total = np.cumsum(self.sizes[at])
                cut = np.unique(np.searchsorted(total, np.arange(CELLS, int(total[-1]) + CELLS, CELLS), side="left") + 1) if len(total) else []
                begin = 0
                for end in cut:
                    q, v = some[which[begin:end]], at[begin:end]
                    size = self.sizes[v]
                    first = np.concatenate([[0], np.cumsum(size)[:-1]])
                    code = np.repeat(self.starts[v] - first, size) + np.arange(int(size.sum()))
                    begin = end
                    yield self._verified(queries, np.repeat(q, size), code, radius)

    def _verified(self, queries: np.ndarray, q: np.ndarray, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        apart = queries[q] ^ self.codes[code]
        ok = np.ones(len(q), bool)
        for j in range(self.count):
            if j != self.j:
                ok &= np.bitwise_count(segment(apart, j, self.bits)) >= radius + (j < self.j)
        return q[ok], self.order[code[ok]], np.bitwise_count(apart[ok]).sum(1).astype(np.int64)


def _segments(code: str, count: int, bits: int) -> Column:
    """array<long> of a code's segment values, from its words."""
    place = lambda j: divmod(j * bits, 64)
    return F.array(*[F.shiftrightunsigned(F.col(code)[place(j)[0]], place(j)[1]).bitwiseAND(F.lit((1 << bits) - 1)) for j in range(count)])


def _nearest(q: np.ndarray, away: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Places of the `keep` smallest (distance, id) of each query, in order."""
    order = np.lexsort((ids, away, q))
    head = np.flatnonzero(np.append(len(q) > 0, q[order[1:]] != q[order[:-1]]))
    rank = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order)))) if len(order) else order
    return order[rank < keep]


def nearest_by_hamming(
    vectors: DataFrame,
    *,
    k: int = 10,
    dims: int = 64,
    every: int = 50,
    segment_bits: int = 16,
    part_codes: int = PART_CODES,
) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest other rows of each query, by Hamming distance.

    vectors(vec_id, embedding); queries are the rows whose vec_id is divisible by `every`,
    searched among all rows. Equal distances go by vec_id; ranks start at 1. segment_bits must
    divide 32; about the logarithm of the number of codes is best.

    Rows with a null id or embedding, or with another number of values than dims, are neither
    indexed nor asked; a null or NaN value is an unset bit. A repeated vec_id counts once a
    distinct vector. With fewer than k other rows, all are returned. Other columns are ignored; an
    empty table gives an empty result.
    """
    if 32 % segment_bits:
        raise ValueError("segment_bits must divide 32")
    ship_package(vectors.sparkSession)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") == dims))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch["embedding"].flatten()
            values = flat.fill_null(0).to_numpy(zero_copy_only=False) if flat.null_count else flat.to_numpy()
            codes = binary_codes(values.reshape(-1, dims))
            words = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * codes.shape[1], pa.int32()), pa.array(codes.reshape(-1).view(np.int64)))
            yield pa.record_batch([batch["vec_id"], words], names=["vec_id", "code"])

    coded = saved(usable.mapInArrow(encode, "vec_id long, code array<long>").distinct(), "codes")
    # the k + 1 smallest ids of each code; the limit is applied before the shuffle too
    low = coded.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    codes = saved(low.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "distinct-codes")
    asked = coded.filter(F.pmod("vec_id", F.lit(every)) == 0)

    count = -(-dims // segment_bits)
    prefix_bits = min(segment_bits, max(0, -(-codes.count() // part_codes) - 1).bit_length())
    low_bits = segment_bits - prefix_bits
    prefixed = lambda df: df.select("*", F.posexplode(_segments("code", count, segment_bits)).alias("j", "v")).withColumn("prefix", F.shiftright("v", low_bits).cast("int"))
    entries = prefixed(codes)
    slots = entries.groupBy("j", "prefix").agg(F.ceil(F.count("*") / (4 * part_codes)).cast("int").alias("salts"))

    def stored(table: pa.Table) -> pa.Table:
        words = table["code"].combine_chunks().flatten().to_numpy()
        ids = table["ids"].combine_chunks()
        sizes = np.diff(ids.offsets.to_numpy()).astype(np.int32)
        one = {c: table[c].slice(0, 1) for c in ("j", "prefix", "salt")}
        return pa.table(one | {"codes": pa.array([words.tobytes()], pa.binary()), "ids": pa.array([ids.flatten().to_numpy().tobytes()], pa.binary()), "sizes": pa.array([sizes.tobytes()], pa.binary())})

    salted = entries.join(slots, ["j", "prefix"]).withColumn("salt", F.pmod(F.xxhash64("code", F.lit(1)), F.col("salts")).cast("int"))
    tables = salted.select("j", "prefix", "salt", "code", "ids").groupBy("j", "prefix", "salt").applyInArrow(stored, "j int, prefix int, salt int, codes binary, ids binary, sizes binary")
    tables = saved(tables, "segment-tables")
    kind = pa.list_(pa.struct([("distance", pa.int32()), ("id", pa.int64())]))
    out = pa.schema([("code", pa.list_(pa.int64())), ("near", kind)])

    def answers(radii: range):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return out.empty_table()
            row = left.to_pylist()[0]
            n_words = -(-dims // 64)
            held = np.frombuffer(row["codes"], np.uint64).reshape(-1, n_words)
            sizes, ids = np.frombuffer(row["sizes"], np.int32).astype(np.int64), np.frombuffer(row["ids"], np.int64)
            first = np.concatenate([[0], np.cumsum(sizes)])
            part = Part(held, row["j"], row["prefix"], bits=segment_bits, low_bits=low_bits, count=count)
            queries = right["code"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, n_words)
            limit = right["limit"].to_numpy().astype(np.int64)
            best = tuple(np.zeros(0, np.int64) for _ in range(3))
            for radius in radii:
                for q, code, away in part.at_radius(queries, radius, np.flatnonzero(limit // count >= radius)):
                    ok = away <= limit[q]
                    q, code, away = q[ok], code[ok], away[ok]
                    n = sizes[code]
                    at = np.repeat(first[code] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(n) else n
                    best = tuple(np.concatenate(x) for x in zip(best, (np.repeat(q, n), np.repeat(away, n), ids[at]), strict=True))
                    top = _nearest(*best, k + 1)
                    best = tuple(x[top] for x in best)
                some, size = np.unique(best[0], return_counts=True)
                full = size > k
                limit[some[full]] = np.minimum(limit[some[full]], best[1][np.cumsum(size)[full] - 1])
            some, start = np.unique(best[0], return_index=True)
            near = pa.StructArray.from_arrays([pa.array(best[1], pa.int32()), pa.array(best[2], pa.int64())], ["distance", "id"])
            return pa.table([right["code"].take(pa.array(some)).cast(out.field("code").type), pa.ListArray.from_arrays(pa.array(np.append(start, len(best[0])), pa.int32()), near).cast(kind)], schema=out)

        return run

    nothing = F.array().cast("array<struct<distance:int,id:long>>")
    open_ = asked.select("code").distinct().select("code", nothing.alias("near"), F.lit(64 * (-(-dims // 64))).alias("limit"))
    n_open = open_.count()
    ways_in = [n_open * count * sum(comb(segment_bits, r) for r in range(top + 1)) for top in range(segment_bits + 1)]
    first_radius = sum(w <= LOOKUPS for w in ways_in[1:])
    done: DataFrame | None = None
    radius = -1
    while radius < segment_bits:
        radii = range(radius + 1, min(segment_bits, max(first_radius, radius + 2)) + 1)
        radius = radii[-1]
        ways = [int(m) for r in range(min(radius, prefix_bits) + 1) for m in masks(prefix_bits, r)]
        sent = prefixed(open_.select("code", "limit")).withColumn("prefix", F.explode(F.transform(F.array(*map(F.lit, ways)), lambda m: F.col("prefix").bitwiseXOR(m))))
        sent = sent.join(tables.select("j", "prefix", F.col("salt").alias("s")), ["j", "prefix"]).select("j", "prefix", F.col("s").alias("salt"), "code", "limit")
        found = tables.groupBy("j", "prefix", "salt").cogroup(sent.groupBy("j", "prefix", "salt")).applyInArrow(answers(radii), "code array<long>, near array<struct<distance:int,id:long>>")
        merged = open_.select("code", "near").union(found).groupBy("code").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
        full = F.size("near") > k
        limit = F.when(full, F.element_at("near", -1)["distance"]).otherwise(F.lit(64 * (-(-dims // 64))))
        state = saved(merged.select("code", "near", limit.alias("limit"), (full & (limit <= count * (radius + 1) - 1)).alias("covered")), "top-k")
        finished = state.filter("covered") if radius < segment_bits else state
        done = finished.select("code", "near") if done is None else done.union(finished.select("code", "near"))
        open_ = state.filter("NOT covered").select("code", "near", "limit")
        if not open_.limit(1).count():
            break
    mine = asked.join(done, "code").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("near", lambda x: x["id"] != F.col("vec_id")), 1, k).alias("near"))
    return mine.select("query_id", F.posexplode("near").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias("neighbor_id"), F.col("x.distance").alias("distance"))


def sql(k: int = 10, every: int = 50, dims: int = 64, table: str = "embeddings") -> str:
    """DuckDB SQL for the same rows, for unique ids: every query against every row."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS code FROM {table} WHERE vec_id IS NOT NULL AND len(embedding) = {dims}),
d AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, CAST(len(list_filter(list_zip(q.code, r.code), lambda p: p[1] <> p[2])) AS INTEGER) AS distance
      FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % {every} = 0),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, neighbor_id, distance FROM n WHERE rank <= {k}"""
