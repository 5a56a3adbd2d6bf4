"""Substring dedup: level-wise doubling over word windows.

A window is `min_words` consecutive words of one document. A word goes when some window
over it also starts earlier: in a smaller doc_id, or earlier in the same document. Windows
are judged on the input, never on what other removals left.

Levels run base_words, 2 * base_words, ... min_words: 5, 10 and 20. At the first, each chunk of
documents sends the hashes of its distinct windows (their first `bits`, gap-coded) to hash
buckets, which answer with those that occur twice. A window of twice the length is a candidate
only where both of its halves were repeated; the others are never hashed again. A chunk without
candidates takes no part in any further level, and with none anywhere a level is empty. Levels
end at min_words, as a longer repeat is the union of its own windows of min_words. At that last
level the hash has all 64 bits and each chunk sends its earliest place of it; buckets answer
every chunk but the one with the earliest place. A hash of few bits may let a window through
that isn't repeated: it costs a candidate, never a word.

A hot passage is one entry a chunk at every level, however many documents hold it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import chunked, exchange_sizes, text_bytes
from .wordcols import BLANK, Words, pack, unpack, whole_window, windows

_NO_ID = np.iinfo(np.int64).max  # null ids come after all others


def level_bits(n_bytes: int) -> int:
    """Bits of a hash that tell most windows of so many bytes of text apart."""
    return min(48, max(24, int(n_bytes).bit_length() + 4))


def _bounds(n_buckets: int, bits: int) -> np.ndarray:
    """First value of each bucket after the first."""
    return np.array([(i << bits) // n_buckets for i in range(1, n_buckets)], np.uint64)


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _sent(values: np.ndarray, keys: np.ndarray, chunk: int, bounds: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """Rows (bucket, chunk, blob) of ascending values; keys, ascending too, choose the bucket."""
    cut = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
    full = np.flatnonzero(np.diff(cut))
    return pa.table({
        "bucket": pa.array(full, pa.int32()),
        "chunk": pa.array(np.full(len(full), chunk), pa.int32()),
        "blob": pa.array([pack(values[cut[b] : cut[b + 1]], *(c[cut[b] : cut[b + 1]] for c in columns)) for b in full], pa.binary()),
    })


def _first_level(width: int, n_buckets: int, bits: int):
    bounds = _bounds(n_buckets, bits)

    def run(table: pa.Table) -> pa.Table:
        words = Words(table["text"], separators=BLANK, lower=False)
        values = windows(words.hashes(), width)[whole_window(words.first, width)] >> np.uint64(64 - bits)
        values, counts = np.unique(values, return_counts=True)
        return _sent(values, values, table["chunk"][0].as_py(), bounds, np.minimum(counts, 2).astype(np.uint8))

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """For each chunk: its windows that occur twice or more in all."""
    got = [unpack(b.as_py(), "u8", "u1") for b in table["blob"]]
    unique, inverse = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([g[1] for g in got]))
    out, at = [], 0
    for v, _ in got:
        twice = total[inverse[at : at + len(v)]] > 1
        at += len(v)
        out.append(pack(v[twice]) if twice.any() else None)
    return pa.table({"chunk": table["chunk"], "blob": pa.array(out, pa.binary())}).filter(pa.array([b is not None for b in out]))


def _members(values: np.ndarray, blobs: pa.ChunkedArray) -> np.ndarray:
    if not len(blobs) or not len(values):
        return np.zeros(len(values), bool)
    known = np.sort(np.concatenate([unpack(b.as_py(), "u8")[0] for b in blobs]))
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _candidates(words: Words, width: int, blobs: pa.ChunkedArray, bits: int) -> np.ndarray:
    """Starts of windows of 2 * width words whose halves were both repeated."""
    hashes = words.hashes()
    half = windows(hashes, width)
    hit = np.zeros(len(hashes) + width, bool)
    hit[: len(half)] = _members(half >> np.uint64(64 - bits), blobs) & whole_window(words.first, width)
    whole = whole_window(words.first, 2 * width)
    n = len(whole)
    return np.flatnonzero(whole & hit[:n] & hit[width : width + n])


def _next_level(width: int, n_buckets: int, bits: int, last: bool):
    """Sends windows of 2 * width words; at the last level with the chunk's earliest place."""
    bounds = _bounds(n_buckets, bits)
    empty = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("blob", pa.binary())]).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        left = _ordered(left)
        words = Words(left["text"], separators=BLANK, lower=False)
        at = _candidates(words, width, right["blob"], bits)
        if not len(at):
            return empty
        chunk = left["chunk"][0].as_py()
        values = windows(words.hashes(), 2 * width)[at]
        if not last:
            values, counts = np.unique(values >> np.uint64(64 - bits), return_counts=True)
            return _sent(values, values, chunk, bounds, np.minimum(counts, 2).astype(np.uint8))
        values, first = np.unique(values, return_index=True)  # the first in order is the earliest
        owner = np.searchsorted(words.first, at[first], side="right") - 1
        ids = left["doc_id"].fill_null(_NO_ID).to_numpy()[owner].astype(np.int64)
        return _sent(values, values >> np.uint64(64 - bits), chunk, bounds, ids, (at[first] - words.first[owner]).astype(np.uint32))

    return run


def _later(table: pa.Table) -> pa.Table:
    """For each chunk: the windows whose earliest place is in another chunk."""
    got = [unpack(b.as_py(), "u8", "i8", "u4") for b in table["blob"]]
    values = np.concatenate([g[0] for g in got])
    ids, places = np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])
    sender = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
    order = np.lexsort((sender, places, ids, values))
    later = np.zeros(len(values), bool)
    later[order[1:]] = values[order[1:]] == values[order[:-1]]
    out, at = [], 0
    for g in got:
        lost = later[at : at + len(g[0])]
        at += len(g[0])
        out.append(pack(g[0][lost]) if lost.any() else None)
    return pa.table({"chunk": table["chunk"], "blob": pa.array(out, pa.binary())}).filter(pa.array([b is not None for b in out]))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
_OUT_DDL = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>"


def _removed(width: int, keep_untouched: bool, out: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out.empty_table()
        left = _ordered(left)
        words = Words(left["text"], separators=BLANK, lower=False)
        values, whole = windows(words.hashes(), width), whole_window(words.first, width)
        at = np.flatnonzero(whole)
        values = values[at]
        _, first = np.unique(values, return_index=True)
        late = np.ones(len(at), bool)
        late[first] = False
        late |= _members(values, right["blob"])
        n = len(words.start)
        depth = np.zeros(n + 1, np.int64)
        np.add.at(depth, at[late], 1)
        np.add.at(depth, at[late] + width, -1)
        gone = np.cumsum(depth)[:n] > 0
        # kept words, a blank after each, then texts cut without their last blank
        keep = np.flatnonzero(~gone)
        size = words.end[keep] - words.start[keep] + 1
        begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        flat = words.raw[np.minimum(np.repeat(words.start[keep] - begin[:-1], size) + np.arange(begin[-1]), len(words.raw) - 1)]
        flat[begin[1:] - 1] = 0x20
        kept_before = np.searchsorted(keep, words.first)
        lo, hi = begin[kept_before[:-1]], begin[kept_before[1:]]
        buffer = flat.tobytes()
        texts = [buffer[a : b - 1].decode() if b > a else "" for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        # a span never runs over the end of a text
        edge = np.zeros(n + 1, bool)
        edge[words.first[:-1]] = True
        prev = np.concatenate([[False], gone[:-1]]) & ~edge[:n]
        begins = np.flatnonzero(gone & ~prev)
        ends = np.flatnonzero(gone & ~np.concatenate([gone[1:] & ~edge[1:n], [False]])) + 1 if n else begins
        owner = np.searchsorted(words.first, begins, side="right") - 1
        spans: list[list] = [[] for _ in range(left.num_rows)]
        for o, b, e in zip(owner.tolist(), begins.tolist(), ends.tolist(), strict=True):
            f = int(words.first[o])
            spans[o].append({"start": b - f, "end": e - f})
        taken = np.concatenate([[0], np.cumsum(gone)])
        n_removed = taken[words.first[1:]] - taken[words.first[:-1]]
        if keep_untouched:
            own = left["text"].to_pylist()
            texts = [t if n else o for t, n, o in zip(texts, n_removed.tolist(), own, strict=True)]
        columns = [left["doc_id"], pa.array(words.counts), pa.array(n_removed), pa.array(texts, pa.string()), pa.array(spans, _OUT.field(4).type)]
        return pa.table(columns + [left[name] for name in out.names[len(_OUT) :]], schema=out)

    return run


def dedup_substrings(
    docs: DataFrame,
    *,
    min_words: int = 20,
    base_words: int = 5,
    carry: bool = False,
    keep_untouched: bool = False,
    chunk_bytes: int | None = None,
    bucket_bytes: int | None = None,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, removed) for each row of docs(doc_id, text).

    min_words   length of a window; base_words times a power of two
    kept_text   the kept words, joined by one space
    removed     word spans [start, end) that went, in order
    carry       with a column `carried` more: a struct of the row's other columns
    keep_untouched  kept_text is the text itself (null for null) where nothing went

    Null and blank texts have no words: kept_text is empty. Texts of fewer than min_words
    words are kept whole. Rows with one doc_id count as successive documents, in the order of
    their text; rows with a null doc_id come after all others. Other columns are ignored; an
    empty table gives an empty result.
    """
    width, levels = base_words, 0
    while width < min_words:
        width, levels = width * 2, levels + 1
    if width != min_words or not levels:
        raise ValueError("min_words must be base_words times a power of two, 2 at least")
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("doc_id", "text")] if carry else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*others).alias("carried")] if others else []))
    schema, ddl = _OUT, _OUT_DDL
    if others:
        schema = _OUT.append(pa.field("carried", to_arrow_type(docs.schema["carried"].dataType)))
        ddl = T.StructType([*T.StructType.fromDDL(_OUT_DDL).fields, docs.schema["carried"]])
    n_bytes = text_bytes(docs)
    chunk_bytes, bucket_bytes = exchange_sizes(n_bytes, chunk_bytes, bucket_bytes)
    n_buckets = max(24, -(-n_bytes // bucket_bytes))
    parts = chunked(docs, n_bytes, chunk_bytes=chunk_bytes)
    by_chunk, bits = parts.groupBy("chunk"), level_bits(n_bytes)
    asked = by_chunk.applyInArrow(_first_level(base_words, n_buckets, bits), "bucket int, chunk int, blob binary")
    width = base_words
    for level in range(levels):
        told = asked.groupBy("bucket").applyInArrow(_repeated, "chunk int, blob binary")
        asked = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(_next_level(width, n_buckets, bits, level == levels - 1), "bucket int, chunk int, blob binary")
        width *= 2
    told = asked.groupBy("bucket").applyInArrow(_later, "chunk int, blob binary")
    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(_removed(min_words, keep_untouched, schema), ddl)
