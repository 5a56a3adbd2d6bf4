"""Benchmark decontamination over a distributed positional inverted index.

`build_index` stores, for each segment of the training documents, every term with its
ascending word positions. A segment is a bounded run of whole documents, so the index grows
row by row and no posting list is ever held whole in one place.

A phrase is looked up in every segment on its own: the positions of its rarest term (by
counts over the whole index), moved back by that term's offset, are the candidate starts;
they are intersected with the offset-adjusted lists of the other terms, rarest first, by
binary search in those lists, until all terms stand. What stays is an exact occurrence.
Proximity asks for all terms within a span, in any order.

Test items become phrases of `window` words. They are a stated query set: up to
`query_bytes` of their text is sent to the executors at once, as some 20 bytes a word; a
larger set is worked off in blocks of that size, whose hits are merged segment by segment.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .shared import saved
from .wordcols import NOT_ALNUM, Words, pack, unpack, whole_window, windows

SEGMENT_BYTES = 2 << 20
QUERY_BYTES = 8 << 20

_INDEX = pa.schema([("segment", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("doc_first", pa.list_(pa.int64())), ("terms", pa.binary()), ("places", pa.binary())])


def _segments(batches: Iterator[pa.RecordBatch], segment_bytes: int) -> Iterator[pa.Table]:
    """Whole rows, gathered or cut to about segment_bytes of text."""
    held, size = [], 0
    for batch in batches:
        texts = batch["text"]
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        ends, begin = np.cumsum(lengths) + size, 0
        while begin < len(lengths):
            stop = int(np.searchsorted(ends, segment_bytes)) + 1
            stop = min(max(stop, begin + 1), len(lengths))
            held.append(batch.slice(begin, stop - begin))
            size = int(ends[stop - 1])
            begin = stop
            if size >= segment_bytes:
                yield pa.Table.from_batches(held)
                ends = ends - size
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _indexed(segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _segments(batches, segment_bytes):
            words = Words(table["text"], separators=NOT_ALNUM, lower=True)
            hashes = words.hashes()
            places = np.argsort(hashes, kind="stable")
            ordered = hashes[places]
            new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
            counts = np.diff(np.append(new, len(ordered))).astype(np.uint32)
            gaps = np.diff(places, prepend=0)
            gaps[new] = places[new]  # each list starts at its own first place
            yield pa.record_batch([
                pa.array([uuid.uuid4().hex]),
                pa.array([table["doc_id"].to_numpy(zero_copy_only=False)] if not table["doc_id"].null_count else [table["doc_id"].to_pylist()], pa.list_(pa.int64())),
                pa.array([words.first], pa.list_(pa.int64())),
                pa.array([pack(ordered[new], counts)], pa.binary()),
                pa.array([pack(np.zeros(len(gaps), np.uint64), gaps.astype(np.uint32))], pa.binary()),
            ], schema=_INDEX)

    return run


def build_index(docs: DataFrame, *, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of docs(doc_id, text), stored in the shared folder: a row a segment.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased. A null
    text has no words; its document is in the index all the same.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved(docs.mapInArrow(_indexed(segment_bytes), "segment string, doc_ids array<long>, doc_first array<long>, terms binary, places binary"), "positional-index")


@dataclass
class Phrases:
    """Phrases as runs of a word sequence.

    terms   distinct term hashes, ascending, with their counts over the index
    words   the word sequence, each word as its place among the terms
    groups  (length, starts) of the distinct phrases of each length
    owners  for each group, ascending (phrase number, text number) pairs
    """

    terms: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    groups: list[tuple[int, np.ndarray]]
    owners: list[np.ndarray]

    @classmethod
    def of(cls, texts: list[str | None], window: int) -> Phrases:
        """The runs of `window` words of each text, or all of a text of fewer words; without counts."""
        found = Words(pa.array(texts, pa.string()), separators=NOT_ALNUM, lower=True)
        hashes, first = found.hashes(), found.first
        sizes = np.diff(first)
        terms, words = np.unique(hashes, return_inverse=True)
        groups, owners = [], []
        for length in [*np.unique(sizes[(sizes > 0) & (sizes < window)]).tolist(), window]:
            if length < window:
                texts_of = np.flatnonzero(sizes == length)
                starts = first[:-1][texts_of]
            else:
                starts = np.flatnonzero(whole_window(first, window))
                texts_of = np.searchsorted(first, starts, side="right") - 1
            if len(starts):
                _, one, number = np.unique(windows(hashes, length)[starts], return_index=True, return_inverse=True)
                groups.append((length, starts[one].astype(np.int32)))
                pairs = np.unique(number.astype(np.uint64) << np.uint64(32) | texts_of.astype(np.uint64))
                owners.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.int32))
        return cls(terms, np.zeros(len(terms), np.int32), words.astype(np.int32), groups, owners)

    def counted(self, index: DataFrame) -> Phrases:
        """With the counts of the terms over the whole index."""
        if len(self.terms):
            known, counts = term_counts(index, self.terms)
            self.counts = np.zeros(len(self.terms), np.int32)
            self.counts[np.searchsorted(self.terms, known)] = np.minimum(counts, np.iinfo(np.int32).max)  # they only rank terms
        return self


class Segment:
    """One row of the index, unpacked."""

    def __init__(self, row: dict):
        self.doc_ids, self.first = row["doc_ids"], np.asarray(row["doc_first"], np.int64)
        self.terms, counts = unpack(row["terms"], "u8", "u4")
        self.ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        gaps = unpack(row["places"], "u8", "u4")[1].astype(np.int64)
        total = np.cumsum(gaps)
        base = np.concatenate([[0], total])[self.ends[:-1]]
        self.places = total - np.repeat(base, counts)
        self.size = len(self.places)
        # the lists one after another, each moved past the one before: ascending as a whole
        self.lists = np.repeat(np.arange(len(self.terms)) * (self.size + 1), counts) + self.places

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for terms that the segment lacks."""
        if not len(self.terms):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def holds(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """True where a term's list has the place; both arrays are of one length."""
        wanted = terms * (self.size + 1) + places
        at = np.minimum(np.searchsorted(self.lists, wanted), max(0, self.size - 1))
        return self.lists[at] == wanted if self.size else np.zeros(len(wanted), bool)

    def phrases(self, query: Phrases) -> list[tuple[np.ndarray, np.ndarray]]:
        """(phrase numbers, starts) of the occurrences, for each group of equal-length phrases."""
        numbers = self.find(query.terms)
        lacking = np.concatenate([[0], np.cumsum(numbers[query.words] < 0)])
        out = []
        for length, starts in query.groups:
            rows = np.flatnonzero(lacking[starts + length] == lacking[starts])  # all terms are here
            words = query.words[starts[rows, None] + np.arange(length)]
            order = np.argsort(query.counts[words], axis=1, kind="stable")  # rarest first
            lists = numbers[words]
            every = np.arange(len(rows))
            lead = lists[every, order[:, 0]] if len(rows) else np.zeros(0, np.int64)
            size = self.ends[lead + 1] - self.ends[lead]
            which = np.repeat(every, size)
            begin = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
            at = self.places[np.repeat(self.ends[lead] - begin, size) + np.arange(int(size.sum()))] - order[which, 0]
            ok = (at >= 0) & (at + length <= self.size)
            which, at = which[ok], at[ok]
            for k in range(1, length):
                offset = order[which, k]
                ok = self.holds(lists[which, offset], at + offset)
                which, at = which[ok], at[ok]
            doc = np.searchsorted(self.first, at, side="right")
            ok = at + length <= self.first[np.minimum(doc, len(self.first) - 1)]
            out.append((rows[which[ok]], at[ok]))
        return out

    def near(self, terms: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(first place, last place) of the shortest runs of at most span words with all terms."""
        numbers = self.find(terms)
        if (numbers < 0).any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lists = [self.places[self.ends[t] : self.ends[t + 1]] for t in numbers]
        last = np.sort(np.concatenate(lists))
        begin = last.copy()
        ok = np.ones(len(last), bool)
        for one in sorted(lists, key=len):  # rarest first
            at = np.searchsorted(one, last, side="right") - 1
            ok &= at >= 0
            begin = np.minimum(begin, one[np.maximum(at, 0)])
        doc = np.searchsorted(self.first, begin, side="right")
        ok &= (last - begin < span) & (last < self.first[np.minimum(doc, len(self.first) - 1)])
        begin, last = begin[ok], last[ok]
        shortest = np.ones(len(begin), bool)  # the first end for each begin
        shortest[1:] = begin[1:] != begin[:-1]
        return begin[shortest], last[shortest]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def term_counts(index: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the given distinct ascending term hashes that the index has, and their occurrences in all of it."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        wanted = sent.value
        for batch in batches:
            for blob in batch["terms"]:
                have, counts = unpack(blob.as_py(), "u8", "u4")
                if len(have):
                    at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
                    ok = have[at] == wanted
                    yield pa.record_batch([pa.array(wanted[ok].view(np.int64)), pa.array(counts[at[ok]].astype(np.int64))], names=["t", "n"])

    rows = index.select("terms").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
    found = rows.toArrow()  # at most the terms asked for
    return found["t"].to_numpy().view(np.uint64), found["n"].to_numpy()


def phrase_matches(index: DataFrame, phrase: str) -> DataFrame:
    """(doc_id, start): the word offset of every occurrence of the phrase. A phrase without words occurs nowhere."""
    query = Phrases.of([phrase], max(1, len(phrase))).counted(index)

    def run(batches):
        for row in _rows(batches):
            s = Segment(row)
            for _, start in s.phrases(query):
                doc = np.searchsorted(s.first, start, side="right") - 1
                yield pa.record_batch([pa.array([s.doc_ids[d] for d in doc], pa.int64()), pa.array(start - s.first[doc], pa.int64())], names=["doc_id", "start"])

    return index.mapInArrow(run, "doc_id long, start long")


def proximity_matches(index: DataFrame, terms: str, *, span: int) -> DataFrame:
    """(doc_id, start, end): the shortest runs of at most span words that hold all the terms, in any order."""
    hashes = Phrases.of([terms], 1).terms

    def run(batches):
        for row in _rows(batches):
            if len(hashes):
                s = Segment(row)
                begin, last = s.near(hashes, span)
                doc = np.searchsorted(s.first, begin, side="right") - 1
                yield pa.record_batch([pa.array([s.doc_ids[d] for d in doc], pa.int64()), pa.array(begin - s.first[doc], pa.int64()), pa.array(last + 1 - s.first[doc], pa.int64())], names=["doc_id", "start", "end"])

    return index.mapInArrow(run, "doc_id long, start long, end long")


_HITS = pa.schema([("segment", pa.string()), ("row", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
_HITS_DDL = "segment string, row int, doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def _hits(query, ids: list[str | None], every: bool):
    """A row for each document, or, unless `every`, for each with hits."""

    def run(batches):
        asked = query.value
        for row in _rows(batches):
            s = Segment(row)
            n, n_docs = s.size, len(s.doc_ids)
            depth = np.zeros(n + 1, np.int64)
            pairs = []
            for (which, start), (length, _), own in zip(s.phrases(asked), asked.groups, asked.owners, strict=True):
                np.add.at(depth, start, 1)
                np.add.at(depth, start + length, -1)
                doc = np.searchsorted(s.first, start, side="right") - 1
                seen = np.unique(np.stack([doc, which], 1), axis=0)
                lo, hi = np.searchsorted(own[:, 0], seen[:, 1]), np.searchsorted(own[:, 0], seen[:, 1], side="right")
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(int((hi - lo).sum())) if len(lo) else lo
                pairs.append(np.stack([np.repeat(seen[:, 0], hi - lo), own[at, 1]], 1))
            hit = np.cumsum(depth)[:n] > 0
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[s.first[1:]] - total[s.first[:-1]]
            items: list[set] = [set() for _ in range(n_docs)]
            for doc, item in np.concatenate(pairs).tolist() if pairs else []:
                if ids[item] is not None:
                    items[doc].add(ids[item])
            spans: list[list] = [[] for _ in range(n_docs)]
            edge = np.zeros(n + 1, bool)
            edge[s.first] = True
            begins = np.flatnonzero(hit & (edge[:n] | ~np.concatenate([[False], hit[:-1]]))) if n else []
            ends = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]]))) + 1 if n else []
            for b, e in zip(begins, ends, strict=True):
                doc = int(np.searchsorted(s.first, b, side="right")) - 1
                spans[doc].append({"start": int(b - s.first[doc]), "end": int(e - s.first[doc])})
            out = pa.table([
                pa.array([row["segment"]] * n_docs, pa.string()), pa.array(np.arange(n_docs, dtype=np.int32)), pa.array(s.doc_ids, pa.int64()), pa.array(np.diff(s.first)),
                pa.array(n_hit), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, _HITS.field("spans").type),
            ], schema=_HITS)
            yield from (out if every else out.filter(pa.array(n_hit > 0))).to_batches()

    return run


def _merged(table: pa.Table) -> pa.Table:
    """The rows of one segment, one a document: hits of all blocks together."""
    rows: dict[int, dict] = {}
    for r in table.to_pylist():
        if one := rows.get(r["row"]):
            one["items"] = one["items"] + r["items"]
            one["spans"] = one["spans"] + r["spans"]
        else:
            rows[r["row"]] = r
    for r in rows.values():
        r["items"] = sorted(set(r["items"]))
        spans: list[dict] = []
        for x in sorted(r["spans"], key=lambda x: x["start"]):
            if spans and x["start"] <= spans[-1]["end"]:
                spans[-1]["end"] = max(spans[-1]["end"], x["end"])
            else:
                spans.append(dict(x))
        r["spans"], r["n_hit"] = spans, sum(x["end"] - x["start"] for x in spans)
    return pa.Table.from_pylist(list(rows.values()), schema=_HITS)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    window: int = 13,
    segment_bytes: int = SEGMENT_BYTES,
    query_bytes: int = QUERY_BYTES,
    index: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) for each row of docs(doc_id, text).

    items(item_id, text) gives the phrases: runs of `window` words, or the whole of an item
    of fewer words. n_hit counts the document's words inside any occurrence; items are the ids
    (as strings, sorted) whose phrases occur; spans are the hit word runs [start, end).

    Null texts and texts without words have no words and no hits; items without words give no
    phrase. A null item_id marks hits but is not listed. Equal rows are judged each on its
    own; other columns are ignored; with no documents the result is empty, with no items
    nothing is hit. `index` is a result of build_index for the same documents.
    """
    spark = docs.sparkSession
    index = build_index(docs, segment_bytes=segment_bytes) if index is None else index
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n_blocks = max(1, -(-size // query_bytes))
    parts = []
    for block in range(n_blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).filter("text is not null").collect()  # about query_bytes
        query = spark.sparkContext.broadcast(Phrases.of([r["text"] for r in rows], window).counted(index))
        parts.append(index.mapInArrow(_hits(query, [r["item_id"] for r in rows], not block), _HITS_DDL))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    if n_blocks > 1:
        whole = whole.groupBy("segment").applyInArrow(_merged, _HITS_DDL)
    return whole.drop("segment", "row")
